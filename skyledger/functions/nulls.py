"""Missing-value policy: NaN and infinities become NULL at the scan, gates fail closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATS = (T.FloatType, T.DoubleType)
INF = float("inf")


def finite(c: Column | str) -> Column:
    """``c`` where it is a finite number, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def is_finite(c: Column | str) -> Column:
    return finite(c).isNotNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities into NULL in every floating column, arrays included."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOATS):
            out[f.name] = finite(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, FLOATS):
            out[f.name] = F.transform(f.name, finite)
    return df.withColumns(out) if out else df


def all_present(*cols: str) -> Column:
    return ~any_missing(*cols)


def any_missing(*cols: str) -> Column:
    if len(cols) > 12:  # a long chain of ORs is slow to plan
        return F.exists(F.array(*[F.col(c) for c in cols]), lambda x: x.isNull())
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def fail_closed(condition: Column) -> Column:
    """A gate that counts an unknown condition as tripped."""
    return F.coalesce(condition, F.lit(True))


def fail_open(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def coerce_flag(df: DataFrame, name: str) -> Column:
    """Boolean, integer or float flag, missing means not flagged."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, FLOATS):
        c = finite(c)
    if isinstance(kind, T.StringType):
        c = F.lower(c).isin("true", "1", "1.0")
    return F.coalesce(c.cast("boolean"), F.lit(False))


def ensure_flags(df: DataFrame, names: list[str], kind: str = "boolean") -> DataFrame:
    """Add absent flag columns as missing."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [is_finite(F.col(c).cast("double")) for c in cols]))
