"""Exact order statistics and ranks that never gather a group into one task.

A group may hold a third of all rows. Each operator therefore first shrinks the
group with combinable aggregates, cuts it into slots of bounded share, counts the
slots, and only ranks inside one (group, slot).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.functions.hashing import hash_slot, seeded_hash

SLOTS = 2048
SAMPLE = SLOTS * 8
# largest k for which Spark plans a row_number filter as a map-side group limit
GROUP_LIMIT = 1000


def one_row(stats: DataFrame, *cols: str) -> Column:
    """A one-row table as a struct column: an uncorrelated scalar subquery."""
    return stats.select(F.struct(*(cols or stats.columns)).alias("row")).scalar()


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches NULL keys and keeps one copy of them."""
    if not keys:
        raise ValueError("join_on_keys needs keys")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def _value_slots(counted: DataFrame, value: str) -> DataFrame:
    """Add ``__slot``: a monotone code of the value, balanced over all distinct values.

    The cut points come from the rows with the smallest hashes, so every
    evaluation, retries included, finds the same cut points.
    """
    sample = (
        counted.select(F.col(value).alias("v"), F.xxhash64(value).alias("h"))
        .orderBy("h", "v")
        .limit(SAMPLE)
        .agg(F.sort_array(F.collect_list("v")).alias("s"))
        .select(
            F.transform(
                F.sequence(F.lit(1), F.lit(SLOTS - 1)),
                lambda i: F.get("s", F.floor(i * F.size("s") / SLOTS).cast("int")),
            ).alias("cuts")
        )
    )
    steps = F.array(*[F.lit(SLOTS >> i) for i in range(1, SLOTS.bit_length())])
    slot = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.col(value) >= F.get("__cuts", at + step - 1), step).otherwise(F.lit(0)),
    )
    return counted.withColumn("__cuts", sample.scalar()).withColumn("__slot", slot).drop("__cuts")


def _counted_slots(df: DataFrame, keys: Sequence[str], value: Column) -> tuple[DataFrame, DataFrame]:
    counted = (
        df.where(value.isNotNull())
        .groupBy(*keys, value.alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    slotted = _value_slots(counted, "__v")
    sizes = slotted.groupBy(*keys, "__slot").agg(F.sum("__c").alias("__sc"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    per_group = W.partitionBy(*keys)
    running = per_group.orderBy("__slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = sizes.select(
        *keys,
        "__slot",
        "__sc",
        "__least",
        "__most",
        (F.sum("__sc").over(running) - F.col("__sc")).alias("__before"),
        F.sum("__sc").over(per_group).alias("n"),
    )
    return slotted, sizes


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("__all", F.lit(0)), ["__all"])


def _picked(near: DataFrame, keys: Sequence[str], inside: Sequence[str], order: str, names: Sequence[str]) -> DataFrame:
    """Values of ``order`` at the 0-based ranks in the array ``__want``; ``__before`` rows of the group precede those of ``inside``."""
    window = W.partitionBy(*keys, *inside).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = near.withColumn("__hi", F.col("__before") + F.sum("__c").over(window))
    at = lambda i: (F.get("__want", F.lit(i)) >= F.col("__hi") - F.col("__c")) & (F.get("__want", F.lit(i)) < F.col("__hi"))
    picks = [F.max(F.when(at(i), F.col(order))).alias(name) for i, name in enumerate(names)]
    return near.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """Values at 0-based ranks of each group's sorted values.

    ``ranks`` maps an output name to a function of the group size. Rows with a
    NULL value are left out; ``n`` counts the others.
    """
    df, ks = _keyed(df, keys)
    slotted, sizes = _counted_slots(df, ks, F.col(value).cast("double"))
    n = F.col("n")
    wanted = F.array(*[f(n).cast("long") for f in ranks.values()])
    first, size = F.col("__before"), F.col("__sc")
    targets = sizes.withColumn("__want", wanted).where(
        F.exists("__want", lambda r: (r >= first) & (r < first + size))
    )
    near = join_on_keys(slotted, targets, [*ks, "__slot"])
    return _picked(near, ks, ["__slot"], "__v", list(ranks)).drop("__all")


def median_deviation(df: DataFrame, keys: Sequence[str], value: str, median: str, deviation: str) -> DataFrame:
    """Exact median of each group and exact median of the absolute deviations from it.

    The deviations are never made for all rows. Seen from the median every slot
    covers a range of deviations, so the slot counts alone bound the wanted one
    from both sides; the values of the few slots that reach into those bounds
    are taken from the shuffle that served the median, and ordered by deviation.
    """
    df, ks = _keyed(df, keys)
    slotted, sizes = _counted_slots(df, ks, F.col(value).cast("double"))
    n = F.col("n")
    halves = F.array(F.floor(0.5 * (n - 1)).cast("long"), F.ceil(0.5 * (n - 1)).cast("long"))
    sizes = sizes.withColumn("__want", halves)
    first, size = F.col("__before"), F.col("__sc")
    targets = sizes.where(F.exists("__want", lambda r: (r >= first) & (r < first + size)))
    centre = _picked(join_on_keys(slotted, targets, [*ks, "__slot"]), ks, ["__slot"], "__v", ["__a", "__b"])
    centre = centre.select(*ks, (F.col("__a") + 0.5 * (F.col("__b") - F.col("__a"))).alias("__mid"))
    # interpolated as the other quantiles are: half way between two ranks, or the one there is
    seen = join_on_keys(sizes, centre, ks)
    low, high = F.abs(F.col("__least") - F.col("__mid")), F.abs(F.col("__most") - F.col("__mid"))
    within = (F.col("__least") <= F.col("__mid")) & (F.col("__mid") <= F.col("__most"))
    seen = seen.withColumns({"__near": F.when(within, 0.0).otherwise(F.least(low, high)), "__far": F.greatest(low, high)})
    group = W.partitionBy(*ks)
    upto = lambda c: group.orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = seen.withColumns({
        "__starts": F.sum("__sc").over(upto("__near")) - F.sum("__sc").over(W.partitionBy(*ks, "__near")),
        "__ends": F.sum("__sc").over(upto("__far")),
    })
    seen = seen.withColumns({
        "__from": F.max(F.when(F.col("__starts") <= F.get("__want", F.lit(0)), F.col("__near"))).over(group),
        "__to": F.min(F.when(F.col("__ends") > F.get("__want", F.lit(1)), F.col("__far"))).over(group),
    })
    below = F.sum(F.when(F.col("__far") < F.col("__from"), F.col("__sc")).otherwise(0)).over(group)
    marks = seen.withColumn("__before", below).where("__far >= __from and __near <= __to").select(*ks, "__slot", "n", "__want", "__before", "__mid")
    near = join_on_keys(slotted, marks, [*ks, "__slot"]).withColumn("__dev", F.abs(F.col("__v") - F.col("__mid")))
    spread = _picked(near, ks, [], "__dev", ["__a", "__b"])
    spread = spread.select(*ks, (F.col("__a") + 0.5 * (F.col("__b") - F.col("__a"))).alias(deviation))
    return join_on_keys(centre.withColumnRenamed("__mid", median), spread, ks).drop("__all")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], count: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any group size."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"__lo_{name}"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        ranks[f"__up_{name}"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    picked = order_statistics(df, keys, value, ranks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, up = F.col(f"__lo_{name}"), F.col(f"__up_{name}")
        out.append((lo + (up - lo) * (at - F.floor(at))).alias(name))
    kept = [F.col("n").alias(count)] if count else []
    return picked.select(*keys, *kept, *out)


def exact_quantiles_of(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles of several columns in one pass, as columns ``<column>_<name>``."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    ks = list(keys)
    if not ks:
        long, ks = long.withColumn("__one", F.lit(0)), ["__one"]
    long = long.unpivot(ks, list(columns), "__var", "__val")
    q = exact_quantiles(long, [*ks, "__var"], "__val", probs)
    picks = [
        F.max(F.when(F.col("__var") == c, F.col(p))).alias(f"{c}_{p}") for c in columns for p in probs
    ]
    return q.groupBy(*ks).agg(*picks).drop("__one")


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every distinct value of each group with its count, the count at or below it, and the group size.

    Values keep their type, so 64-bit keys stay apart.
    """
    df, ks = _keyed(df, keys)
    slotted, sizes = _counted_slots(df, ks, F.col(value))
    inside = W.partitionBy(*ks, "__slot").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = join_on_keys(slotted, sizes, [*ks, "__slot"])
    return out.select(
        *keys,
        F.col("__v").alias(value),
        F.col("__c").alias("n_equal"),
        (F.col("__before") + F.sum("__c").over(inside)).alias("n_le"),
        "n",
    )


def sort_by_key(df: DataFrame, key: str, ties: Sequence[str] = (), position: str = "position") -> DataFrame:
    """Rows with their 1-based place in the global order of ``key``, NULL first.

    The key keeps its type. Slots cut from a hash sample spread the sort, and
    slot counts give each slot its first place.
    """
    slotted = _value_slots(df.withColumn("__v", F.col(key)), "__v")
    sizes = slotted.groupBy("__slot").agg(F.count(F.lit(1)).alias("__sc"))
    running = W.orderBy("__slot").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row a slot
    sizes = sizes.select("__slot", (F.sum("__sc").over(running) - F.col("__sc")).alias("__before"))
    inside = W.partitionBy("__slot").orderBy(F.col("__v").asc_nulls_first(), *ties)
    out = join_on_keys(slotted, sizes, ["__slot"]).withColumn(position, F.col("__before") + F.row_number().over(inside))
    return out.drop("__v", "__slot", "__before")


def hash_rank(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int | str, rank: str = "rank", size: str | None = None) -> DataFrame:
    """1-based rank of each row inside its group in seeded hash order.

    The leading digits of the hash cut each group into 4096 even slots, so a
    group of any size is ranked by many tasks.
    """
    df, ks = _keyed(df, keys)
    digest = seeded_hash(seed, *ids)
    # as bytes, which sort as the digits do and take half the room in the shuffle
    hashed = df.withColumns({"__h": F.unhex(digest), "__slot": hash_slot(digest)})
    counts = hashed.groupBy(*ks, "__slot").agg(F.count(F.lit(1)).alias("__sc"))
    per_group = W.partitionBy(*ks)
    running = per_group.orderBy("__slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.select(
        *ks,
        "__slot",
        (F.sum("__sc").over(running) - F.col("__sc")).alias("__before"),
        F.sum("__sc").over(per_group).alias("__n"),
    )
    inside = W.partitionBy(*ks, "__slot").orderBy("__h", *ids)
    out = join_on_keys(hashed, counts, [*ks, "__slot"])
    out = out.withColumn(rank, F.col("__before") + F.row_number().over(inside))
    if size:
        out = out.withColumn(size, F.col("__n"))
    return out.drop("__h", "__slot", "__before", "__n", "__all")


def hash_cut(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int | str, cuts: Callable[[DataFrame], DataFrame], part: str = "part"
) -> DataFrame:
    """Divide each group at given ranks of its seeded hash order, without ranking or moving its rows.

    ``cuts`` takes one row per group (keys and ``n``) and returns those groups
    that are wanted with an array ``cuts`` of rising ranks; a row at or before
    the first is in part 0, at or before the second in part 1, and so on. Slot
    counts tell in which slot a cut falls; only the hashes of those slots are
    ordered, and their values at the cuts are compared with every row where it
    is. ``ids`` must identify a row: rows that share them are not separated.
    """
    df, ks = _keyed(df, keys)
    hashed = df.withColumn("__h", seeded_hash(seed, *ids)).withColumn("__slot", hash_slot(F.col("__h")))
    counts = hashed.groupBy(*ks, "__slot").agg(F.count(F.lit(1)).alias("__sc"))
    wanted = cuts(counts.groupBy(*ks).agg(F.sum("__sc").alias("n"))).select(*ks, F.transform("cuts", lambda c: F.least(c.cast("long"), F.col("n"))).alias("__cuts"))
    running = W.partitionBy(*ks).orderBy("__slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("__before", F.sum("__sc").over(running) - F.col("__sc"))
    edges = join_on_keys(counts, wanted, ks).select(*ks, "__slot", "__sc", "__before", F.posexplode("__cuts").alias("__i", "__c"))
    edges = edges.where((F.col("__c") > F.col("__before")) & (F.col("__c") <= F.col("__before") + F.col("__sc")))
    near = join_on_keys(hashed.select(*ks, "__slot", "__h"), edges, [*ks, "__slot"])
    place = F.row_number().over(W.partitionBy(*ks, "__slot", "__i").orderBy("__h"))
    found = near.withColumn("__r", place).where(F.col("__r") == F.col("__c") - F.col("__before"))
    found = found.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("__i", "__h"))).alias("__at"))  # one entry a cut
    points = join_on_keys(wanted, found, ks, "left").select(*ks, F.transform("__cuts", lambda c, i: F.element_at("__at", i)).alias("__points"))
    if keys:
        met = join_on_keys(hashed, points, ks)
    else:
        met = hashed.withColumn("__points", one_row(points.select("__points"))["__points"]).where(F.col("__points").isNotNull())
    later = F.filter("__points", lambda p: F.coalesce(F.col("__h") > p, F.lit(True)))
    return met.withColumn(part, F.size(later)).drop("__h", "__slot", "__points", "__all")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    The row_number filter is planned as a group limit on the map side, so a hot
    key sends one row per task to the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") == 1).drop("__rn")


def hash_top_k(df: DataFrame, keys: Sequence[str], ids: Sequence[str], k: int, seed: int | str) -> DataFrame:
    """At most ``k`` rows per group in seeded hash order, all of the group when it is smaller."""
    if k > GROUP_LIMIT:
        return hash_cut(df, keys, ids, seed, lambda g: g.withColumn("cuts", F.array(F.lit(k))), "__part").where("__part = 0").drop("__part")
    df, ks = _keyed(df, keys)
    order = [seeded_hash(seed, *ids), *[F.col(i) for i in ids]]
    rank = F.row_number().over(W.partitionBy(*ks).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= k).drop("__rn", "__all")


def with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Attach the row count of each group: combinable count, then a key join AQE may split."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return join_on_keys(df, sizes, keys)
