"""Removal of repeated byte strings through hash-compared suffix sorting.

A string of ``width`` bytes is found by the suffix that starts it. Suffixes are
sorted where equal ones must meet: neighbouring windows share the leftmost
smallest of their gram hashes (their anchor), so a document is described by few
runs (anchor, windows around it), and equal windows have equal anchors at equal
offsets, wherever they are. Anchors are counted first; runs whose anchor occurs
once cannot repeat and end there. The bytes of all others are dealt by anchor,
and each task sorts its suffixes: a mergesort over all (anchor, offset) classes
at once, in which two suffixes are compared by the length of their common
extension, found by binary search over prefix polynomial hashes. Neighbours in
the sorted order are then compared byte by byte, and a class that a hash
collision left out of order is sorted anew by its bytes.

An anchor of more than ``HOT`` runs is not gathered: its equal runs are first
merged by their bytes, on the side that reads them; if more than ``HOT``
different ones remain, their windows are dealt one by one by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import BLOCK_BYTES, blocks, gram_hashes, mix, powers, table
from skyledger.session import cut_lineage

WIDTH = 100
GRAM = 24
#: runs of one anchor that may be sorted together as they come
HOT = 2048
#: runs of a task
TASK_RUNS = 40_000
#: suffixes whose bytes are compared at once
_VERIFY_ROWS = 1 << 15

_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BASE = 0xC2B2AE3D27D4EB4F
_HIGH = np.uint64(0xFFFFFFFF00000000)


def leftmost_smallest(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of every ``span`` consecutive hashes by their upper half, the first of equal ones."""
    low = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return (low & ~_HIGH).astype(np.int64)


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM, step: int = BLOCK_BYTES) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, first window, last window, place of the anchor after the first window's start) of every run.

    Works on ``step`` windows at a time, so a long text takes no more memory than a short one.
    """
    found = []
    for c in range(0, len(data) - width + 1, step):
        part = data[c : c + step + width - 1]
        h = gram_hashes(_BYTE_VALUES[part], gram, _BASE)
        place = leftmost_smallest(h, width - gram + 1)
        row = np.searchsorted(offsets, np.arange(c, c + len(place)), side="right") - 1
        at = np.flatnonzero(offsets[row + 1] - np.arange(c, c + len(place)) >= width)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (place[at[1:]] != place[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
        head = np.flatnonzero(new)
        first, last = at[head], at[np.append(head[1:], len(at)) - 1]
        rows = row[first]
        found.append((rows, h[place[first]], first + c - offsets[rows], last + c - offsets[rows], place[first] - first))
    if not found:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def anchor_counts(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(rep, n): anchors that more than one run has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                rep, n = np.unique(runs_of(data, offsets, width, gram)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rep.view(np.int64)), pa.array(n.astype(np.int64))], ["rep", "n"])

    return docs.select("text").mapInArrow(run, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n")).where("n > 1")


def anchors_of(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc_id, rep) of every document, once for each block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in blocks(batch.column(1)):
                row, rep, *_ = runs_of(data, offsets, width, gram)
                order = np.lexsort((rep, row))
                row, rep = row[order], rep[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (rep[1:] != rep[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + row[new]].astype(np.int64)), pa.array(rep[new].view(np.int64))], ["doc_id", "rep"])

    return docs.mapInArrow(run, "doc_id bigint, rep bigint")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, body): texts as compressed UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], ["doc_id", "body"])

    return docs.mapInArrow(run, "doc_id bigint, body binary")


RUN_SCHEMA = "rep bigint, at int, row bigint, doc_id bigint, head bigint, bytes binary"
RUN_NAMES = ["rep", "at", "row", "doc_id", "head", "bytes"]


def run_bytes(bodies: DataFrame, wanted: str, width: int, gram: int) -> DataFrame:
    """The runs of ``bodies`` (row, doc_id, body, arrays of anchors) whose anchor the array ``wanted`` names, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, held, first = [], 0, 0
            for k in range(batch.num_rows):
                texts.append(expand(batch.column(2)[k].as_py()))
                held += len(texts[-1])
                if held >= BLOCK_BYTES or k + 1 == batch.num_rows:
                    yield from block(batch.slice(first, k + 1 - first), texts)
                    texts, held, first = [], 0, k + 1

    def block(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        joined = b"".join(texts)
        offsets = np.cumsum([0, *map(len, texts)])
        row, rep, head, tail, at = runs_of(np.frombuffer(joined, np.uint8), offsets, width, gram)
        names = batch.column(3)
        salt = mix(np.arange(batch.num_rows, dtype=np.uint64))
        # a chance agreement only adds a run that will equal no other
        asked = names.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.repeat(salt, names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        keep = np.flatnonzero(np.isin(rep ^ salt[row], asked))
        row, rep, head, tail, at = row[keep], rep[keep], head[keep], tail[keep], at[keep]
        starts, ends = (offsets[row] + head).tolist(), (offsets[row] + tail + width).tolist()
        pick = pa.array(row)
        cols = [pa.array(rep.view(np.int64)), pa.array(at.astype(np.int32)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(head), pa.array([joined[s:e] for s, e in zip(starts, ends)], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, RUN_NAMES)

    return bodies.where(F.size(wanted) > 0).select("row", "doc_id", "body", wanted).mapInArrow(run, RUN_SCHEMA)


class Suffixes:
    """Suffixes of one text, compared by at most ``width`` bytes through prefix hashes."""

    def __init__(self, text: bytes, width: int) -> None:
        self.width = width
        self.text = np.frombuffer(text, np.uint8)
        up, down = powers(len(text) + 1, _BASE)
        self.down = down
        self.prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.text] * up[: len(text)], out=self.prefix[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, up to the width, by binary search."""
        down_a, down_b, from_a, from_b = self.down[a], self.down[b], self.prefix[a], self.prefix[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        mid = high
        for _ in range(self.width.bit_length() + 1):
            same = (self.prefix[a + mid] - from_a) * down_a == (self.prefix[b + mid] - from_b) * down_b
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
            mid = (low + high + 1) >> 1
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each two suffixes."""
        n = self.common(a, b)
        inside = n < self.width
        n = np.minimum(n, self.width - 1)
        x, y = self.text[a + n].astype(np.int16), self.text[b + n].astype(np.int16)
        return np.where(inside, np.sign(x - y), 0)

    def sort(self, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, group by group, and which equal the one before them in that order.

        ``group`` ascends. The runs of all groups are merged level by level: every
        suffix finds its place in the neighbouring run by binary search.
        """
        order = np.arange(len(starts))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.append(first, len(group)))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        r = 1
        while len(sizes) and r < sizes.max():
            here = np.flatnonzero(size > r)
            place = here - base[here]
            block = place // r
            other = (block ^ 1) * r
            paired = other < size[here]
            here, place, block, other = here[paired], place[paired], block[paired], other[paired]
            low, high = other.copy(), np.minimum(other + r, size[here])
            left = block % 2 == 0
            suffix, offset = starts[order[here]], base[here]
            open_ = np.arange(len(here))
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                c = self.compare(suffix[open_], starts[order[offset[open_] + mid]])
                # of equal suffixes those of the left run stay first
                after = np.where(left[open_], c > 0, c >= 0)
                low[open_] = np.where(after, mid + 1, low[open_])
                high[open_] = np.where(after, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            target = offset + (block - block % 2) * r + (place - block * r) + (low - other)
            moved = order.copy()
            moved[target] = order[here]
            order = moved
            r *= 2
        return self.verify(order, starts, group, first, sizes)

    def verify(self, order: np.ndarray, starts: np.ndarray, group: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours compared byte by byte; groups found out of order are sorted by their bytes."""
        equal, wrong = np.zeros(len(order), bool), []
        rows = np.lib.stride_tricks.sliding_window_view(self.text, self.width) if len(self.text) >= self.width else np.empty((0, self.width), np.uint8)
        inner = np.flatnonzero(np.append(False, group[1:] == group[:-1])) if len(group) else np.empty(0, np.int64)
        for k in range(0, len(inner), _VERIFY_ROWS):
            at = inner[k : k + _VERIFY_ROWS]
            x, y = rows[starts[order[at - 1]]], rows[starts[order[at]]]
            differ = x != y
            place = differ.argmax(1)
            nth = np.arange(len(at))
            some = differ[nth, place]
            equal[at] = ~some
            wrong.append(group[at[some & (x[nth, place] > y[nth, place])]])
        for g in np.unique(np.concatenate(wrong)).tolist() if wrong else ():
            k = int(np.searchsorted(group, g))
            lo, hi = k, k + int(np.searchsorted(group[k:], g, side="right"))
            order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda e: rows[starts[e]].tobytes())
            for e in range(lo + 1, hi):
                equal[e] = bool((rows[starts[order[e - 1]]] == rows[starts[order[e]]]).all())
        return order, equal


def repeated(rep: np.ndarray, at: np.ndarray, doc: np.ndarray, head: np.ndarray, seg: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(run, first, last): windows of the given runs that also start earlier, by document and then start. All runs of an anchor must be here."""
    known: dict[tuple[int, bytes], int] = {}
    which = np.array([known.setdefault(k, len(known)) for k in zip(rep.tolist(), seg)], np.int64)
    order = np.lexsort((head, doc, which))
    new = np.ones(len(order), bool)
    new[1:] = which[order[1:]] != which[order[:-1]]
    lead = order[new]  # by number of the distinct run
    windows = np.array([len(k[1]) - width + 1 for k in known], np.int64)
    copy = (doc != doc[lead[which]]) | (head != head[lead[which]])
    # of the distinct runs, those that share their anchor with others are sorted
    anchor = rep[lead]
    _, back, n = np.unique(anchor, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(n[back] > 1)
    texts = list(known)
    size = windows[mixed] + width - 1
    begin = np.cumsum(size) - size
    count = windows[mixed]
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    run = np.repeat(mixed, count)
    starts = np.repeat(begin, count) + k
    group = back[run] * (1 << 20) + (at[lead[run]] - k)
    by_group = np.argsort(group, kind="stable")
    run, k, starts, group = run[by_group], k[by_group], starts[by_group], group[by_group]
    sorted_, equal = Suffixes(b"".join(texts[m][1] for m in mixed.tolist()), width).sort(starts, group)
    run, k = run[sorted_], k[sorted_]
    label = np.cumsum(~equal)
    d, s = doc[lead[run]], head[lead[run]] + k
    rank = np.lexsort((s, d, label))
    top = np.ones(len(rank), bool)
    top[1:] = label[rank[1:]] != label[rank[:-1]]
    least = rank[top][np.cumsum(top) - 1]
    late = rank[(d[rank] != d[least]) | (s[rank] != s[least])]
    run, k = run[late], k[late]
    o = np.lexsort((k, run))
    run, k = run[o], k[o]
    cut = np.ones(len(run), bool)
    cut[1:] = (run[1:] != run[:-1]) | (k[1:] != k[:-1] + 1)
    begin_at = np.flatnonzero(cut)
    end_at = np.append(begin_at[1:], len(run)) - 1 if len(begin_at) else begin_at
    part_run, part_first, part_last = run[begin_at], k[begin_at], k[end_at]
    # every occurrence that is as early as its lead loses what the lead loses
    same = np.flatnonzero(~copy)
    lo, hi = np.searchsorted(part_run, which[same]), np.searchsorted(part_run, which[same], side="right")
    each = hi - lo
    pick = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)
    whole = np.flatnonzero(copy)
    owner = np.concatenate([whole, np.repeat(same, each)])
    first = np.concatenate([np.zeros(len(whole), np.int64), part_first[pick]])
    last = np.concatenate([windows[which[whole]] - 1, part_last[pick]])
    return owner, first, last


GONE = "row bigint, first bigint, last bigint"


def _sorting(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rep, at, row, doc, head = (np.concatenate([b.column(c).to_numpy() for b in got]).astype(np.int64) for c in range(5))
        seg = [s for b in got for s in b.column(5).to_pylist()]
        owner, first, last = repeated(rep, at, doc, head, seg, width)
        yield pa.RecordBatch.from_arrays([pa.array(row[owner]), pa.array(head[owner] + first), pa.array(head[owner] + last)], ["row", "first", "last"])

    return run


def _single_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, n = [], []
            for seg in batch.column(3).to_pylist():
                n.append(len(seg) - width + 1)
                digests += [hashlib.blake2b(seg[k : k + width], digest_size=16).digest() for k in range(n[-1])]
            n = np.array(n, np.int64)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pick = pa.array(np.repeat(np.arange(len(n)), n))
            head = batch.column(2).to_numpy()[pick.to_numpy()] + k
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(head)], ["digest", "row", "doc_id", "head"])

    return run


def earlier(found: DataFrame, key: list[str], places: str) -> tuple[DataFrame, DataFrame]:
    """For rows (key, row, doc_id, head): the ``places`` of each key, in lists; and a row for each key with its earliest place ``low``.

    Places are gathered for a sixteenth of one partition of the stored documents
    at a time (the upper bits of ``row`` name it), so a list stays short, the
    many places of one key travel as few rows, and tasks get even shares.
    """
    place = F.struct("doc_id", "head", "row")
    lists = cut_lineage(found.groupBy(*key, (F.shiftright("row", 33) * 16 + F.pmod("row", F.lit(16))).alias("part")).agg(F.collect_list(place).alias(places)))
    low = cut_lineage(lists.groupBy(*key).agg(F.min(F.array_min(places)).alias("low"), F.sum(F.size(places)).alias("n")))
    return lists, low


def late(lists: DataFrame, low: DataFrame, key: list[str], places: str) -> tuple[DataFrame, DataFrame]:
    """Places of each key after the earliest one, and those at it."""
    met = cut_lineage(lists.join(low, key))
    # lists of one key lie together: dealt out evenly before they are opened
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = lambda x: (x["doc_id"] > F.col("low.doc_id")) | ((x["doc_id"] == F.col("low.doc_id")) & (x["head"] > F.col("low.head")))
    rest = [c for c in met.columns if c != places]
    return tuple(met.select(*rest, F.inline(F.filter(places, f))) for f in (before, lambda x: ~before(x)))


def split_hot(runs: DataFrame, width: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """For runs of crowded anchors: the runs that are left to sort, and the windows already found repeated."""
    key = ["rep", "at", "bytes"]
    lists, low = earlier(runs, key, "run_places")
    crowded = low.groupBy("rep").agg(F.count("*").alias("n")).select("rep", (F.col("n") > hot).alias("crowded"))
    copies, leads = late(lists, low.join(crowded, "rep").drop("n"), key, "run_places")
    copies = copies.select("row", F.col("head").alias("first"), (F.col("head") + F.length("bytes") - width).alias("last"))
    single = leads.where("crowded").select("row", "doc_id", "head", "bytes").mapInArrow(_single_windows(width), "digest binary, row bigint, doc_id bigint, head bigint")
    lists, first = earlier(single, ["digest"], "window_places")
    again, _ = late(lists, first.where("n > 1").drop("n"), ["digest"], "window_places")
    again = again.select("row", F.col("head").alias("first"), F.col("head").alias("last"))
    return leads.where("not crowded").select(*RUN_NAMES), copies.unionAll(again)


def _removal(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                data = expand(batch.column(1)[k].as_py())
                first, last = (np.asarray(batch.column(c)[k].values.to_numpy() if batch.column(c)[k].is_valid else [], np.int64) for c in (2, 3))
                if not len(first):
                    out.append((len(data), 0, 0, data))
                    continue
                spread = np.zeros(len(data) + 1, np.int64)
                np.add.at(spread, first, 1)
                np.add.at(spread, last + width, -1)
                gone = np.cumsum(spread)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``; ``kept`` are the remaining bytes.

    A byte goes if a string of ``width`` bytes over it also starts earlier: in a
    document with a smaller id, or in its own before. Null and empty texts have
    no bytes; texts shorter than the width stay whole, and so do rows with a
    null key, which come neither before nor after others. Rows that share an id
    count as one document: of equal strings in them the smaller start comes
    first, and strings at the same start do not remove each other. An empty
    table gives no rows; further columns are ignored.
    """
    if not 0 < gram <= width:
        raise ValueError("a gram is at most as wide as the strings")
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = narrow.where("doc_id is not null")
    often = cut_lineage(anchor_counts(keyed, width, gram).select("rep", "n", (F.col("n") > hot).alias("hot")))
    totals = often.agg(F.sum("n"), F.count(F.when(F.col("hot"), 1))).first()
    pick = lambda flag: F.collect_list(F.when(flag, F.col("rep")))
    lists = anchors_of(keyed, width, gram).join(often, "rep").groupBy("doc_id").agg(pick(~F.col("hot")).alias("calm"), pick(F.col("hot")).alias("crowded"))
    bodies = packed(keyed).join(lists, "doc_id", "left")
    unkeyed = packed(narrow.where("doc_id is null")).select("doc_id", "body", *(F.lit(None).cast("array<bigint>").alias(c) for c in ("calm", "crowded")))
    bodies = cut_lineage(bodies.unionAll(unkeyed).withColumn("row", F.monotonically_increasing_id()))
    runs = run_bytes(bodies, "calm", width, gram)
    gone = None
    if totals[1]:
        rest, gone = split_hot(run_bytes(bodies, "crowded", width, gram), width, hot)
        runs = runs.unionAll(rest)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((totals[0] or 0) / TASK_RUNS))
    found = runs.repartition(tasks, "rep").mapInArrow(_sorting(width), GONE)
    gone = found if gone is None else found.unionAll(gone)
    gone = gone.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    gone = cut_lineage(gone.select("row", F.col("gone.first").alias("first"), F.col("gone.last").alias("last")))
    out = bodies.select("row", "doc_id", "body").join(gone, "row", "left").select("doc_id", "body", "first", "last")
    return out.mapInArrow(_removal(width), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op13_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(hex(text), '') AS h FROM documents),
chunk AS (SELECT rid, doc_id, c, substr(h, 2 * c + 1, {2 * (WIDTH + 999)}) AS x FROM d, unnest(range(0, len(h) // 2 - {WIDTH - 1}, 1000)) u(c)),
many AS (SELECT rid, doc_id, c, [substr(x, 2 * k + 1, {2 * WIDTH}) for k in range(0, len(x) // 2 - {WIDTH - 1})] AS gs FROM chunk),
win AS (SELECT rid, doc_id, unnest(range(c, c + len(gs))) AS i, unnest(gs) AS g FROM many),
low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
start AS (SELECT g, lo, min(i) AS fi FROM win JOIN low USING (g) WHERE doc_id = lo GROUP BY g, lo),
hit AS (SELECT DISTINCT rid, i FROM win JOIN start USING (g) WHERE doc_id > lo OR i > fi),
edge AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {WIDTH} THEN 1 ELSE 0 END AS new FROM hit),
part AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS span FROM edge),
gone AS (SELECT rid, min(i) AS s, max(i) + {WIDTH} AS e FROM part GROUP BY rid, span),
stop AS (SELECT rid, s, e FROM gone UNION ALL SELECT rid, len(h) // 2, len(h) // 2 FROM d),
piece AS (SELECT rid, s, e, coalesce(max(e) OVER (PARTITION BY rid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM stop),
kept AS (SELECT rid, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s, e) AS body FROM piece JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(body)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN (SELECT rid, sum(e - s) AS n, count(*) AS spans FROM gone GROUP BY rid) USING (rid)
"""
