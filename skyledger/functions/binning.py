"""Values to bin indices, bin indices to cell codes and back."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digitize(c: Column | str, edges: Sequence) -> Column:
    """How many edges are at or below the value; NULL stays NULL."""
    c = _c(c)
    return reduce(lambda a, b: a + b, [(c >= e).cast("int") for e in edges])


def bin_index(c: Column | str, edges: Sequence, closed_last: bool = False) -> Column:
    """Index of the half-open bin ``[e_i, e_i+1)``; NULL outside the edges."""
    c = _c(c)
    last = len(edges) - 2
    i = digitize(c, edges) - 1
    if closed_last:
        i = F.when(c == edges[-1], last).otherwise(i)
    return F.when((i >= 0) & (i <= last), i)


def clamped_index(c: Column | str, edges: Sequence) -> Column:
    """Bin index with out-of-range values moved into the outer bins; NULL becomes -1."""
    c = _c(c)
    i = F.greatest(F.lit(0), F.least(digitize(c, edges) - 1, F.lit(len(edges) - 2)))
    return F.when(c.isNull(), -1).otherwise(i)


def edge_value(index: Column | str, edges: Sequence) -> Column:
    """``edges[index]`` for a non-negative index."""
    return F.get(F.array(*[F.lit(float(e)) for e in edges]), _c(index))


def labelled(c: Column | str, edges: Sequence, labels: Sequence[str], missing: str | None = None) -> Column:
    """Label of the open-ended bin a value falls in (one more label than edges)."""
    c = _c(c)
    out = F.lit(labels[-1])
    for e, name in list(zip(edges, labels))[::-1]:
        out = F.when(c < e, F.lit(name)).otherwise(out)
    return F.when(c.isNull(), F.lit(missing)).otherwise(out)


def named_ranges(c: Column | str, ranges: Sequence[tuple[float, float, str]]) -> Column:
    """First range ``[lo, hi)`` holding the value."""
    c = _c(c)
    return F.coalesce(*[F.when((c >= lo) & (c < hi), F.lit(name)) for lo, hi, name in ranges])


def cell_code(indices: Sequence[Column | str], sizes: Sequence[int]) -> Column:
    """Mixed-radix code of several bin indices."""
    return reduce(lambda code, part: code * part[1] + part[0], [(_c(i), n) for i, n in zip(indices, sizes)], F.lit(0))


def cell_decode(code: Column | str, sizes: Sequence[int]) -> list[Column]:
    """Bin indices back from a mixed-radix code."""
    out, rest = [], _c(code)
    for n in reversed(sizes):
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return out[::-1]


def grid_table(spark: SparkSession, **axes: Sequence[float]) -> DataFrame:
    """Every cell of a grid of bin edges: index, lower and upper edge per axis.

    The size is the product of the bin counts, fixed by the edges and not by the data.
    """
    sizes = [len(e) - 1 for e in axes.values()]
    total = reduce(lambda a, b: a * b, sizes)
    df = spark.range(total)
    for (name, edges), i in zip(axes.items(), cell_decode("id", sizes)):
        df = df.withColumn(f"i_{name}", i)
        df = df.withColumn(f"{name}_lo", edge_value(f"i_{name}", edges[:-1]))
        df = df.withColumn(f"{name}_hi", edge_value(f"i_{name}", edges[1:]))
    return df.drop("id")


def linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + step * i for i in range(n - 1)] + [hi]
