"""Removal of repeated passages with a count-min prefilter.

A window is ``width`` consecutive words. Neighbouring windows share their
smallest gram hash (their representative), so a document is described by few
runs (representative, first window, last window), and equal windows have equal
representatives wherever they are. A count-min sketch over representatives is
built in each partition and merged by cell, over as many cells as the corpus
needs; no window occurs more often than its representative's cells say. Runs
whose cells are all at one cannot repeat and end there. The others are grouped
exactly: first whole runs (representative and a hash of all their words, 128
bits), of which the one with the smallest id stands for all; then, where
different runs share a representative, as at the ends of a passage, their
windows one by one (128 bits). Nothing is lost, and the sketch, spread over the
cluster, is never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import SPACES, blocks, byte_table, gram_hashes, mix, powers, rows_of, span_hashes, spans, table
from skyledger.session import cut_lineage

WIDTH = 50
GRAM = 8
#: rows of the sketch, and cells of a row for each run
DEPTH = 2
CELLS_PER_RUN = 4

_INSIDE = ~byte_table(SPACES)


def _hashed_words(data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = spans(_INSIDE[data], offsets)
    return span_hashes(data, starts, ends, salt), first


def representatives(words: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Smallest gram hash of every window (crossing rows or not)."""
    low = gram_hashes(words, gram)
    span, reach = width - gram + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return low


def runs_of(words: np.ndarray, first: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, representative, first window, last window) of every run; windows are numbered in their row."""
    none = np.empty(0, np.int64)
    if len(words) < width:
        return none, none.astype(np.uint64), none, none
    low = representatives(words, width, gram)
    row = rows_of(first)
    whole = row[: len(low)] == row[width - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(at), bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    rows = row[at[head]]
    return rows, low[at[head]], at[head] - first[rows], at[tail] - first[rows]


def run_hashes(words: np.ndarray, first: np.ndarray, row: np.ndarray, head: np.ndarray, tail: np.ndarray, width: int) -> np.ndarray:
    """A hash of all words of each run."""
    up, down = powers(len(words) + 1, 0xA0761D6478BD642F)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    start, end = first[row] + head, first[row] + tail + width
    return mix((total[end] - total[start]) * down[start] + (tail - head).astype(np.uint64))


def _text_id(column: pa.Array) -> np.ndarray:
    """A 64-bit name of each text, so that rows that share a key but not a text stay apart."""
    out = []
    for _, _, data, offsets in blocks(column):
        h = span_hashes(np.append(data, np.uint8(0)), offsets[:-1], offsets[1:], 7) if len(data) else np.zeros(len(offsets) - 1, np.uint64)
        out.append(np.where(np.diff(offsets) > 0, h, np.uint64(0)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, text_id, rep, body, head, tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            names = _text_id(batch.column(1)).view(np.int64)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                words, first = _hashed_words(data, offsets, 0)
                row, rep, head, tail = runs_of(words, first, width, gram)
                body = run_hashes(words, first, row, head, tail, width)
                cols = [ids[lo:hi][row].astype(np.int64), names[lo:hi][row], rep.view(np.int64), body.view(np.int64), head.astype(np.int32), tail.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "text_id", "rep", "body", "head", "tail"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id bigint, text_id bigint, rep bigint, body bigint, head int, tail int")


def suspects(found: DataFrame, depth: int = DEPTH, cells_per_run: int = CELLS_PER_RUN) -> DataFrame:
    """The runs of the stored table ``found`` whose representative the merged sketch counts at least twice."""
    cells = max(1024, cells_per_run * found.count())
    cell = lambda d: F.pmod(F.xxhash64("rep", F.lit(d)), F.lit(cells)) * depth + d
    every = found.select(F.explode(F.array(*(cell(d) for d in range(depth)))).alias("cell"))
    often = cut_lineage(every.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    for d in range(depth):
        found = found.withColumn("cell", cell(d)).join(often, "cell", "left_semi").drop("cell")
    return found


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, body): texts compressed, since they travel twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            names = pa.array(_text_id(batch.column(1)).view(np.int64))
            body = pa.array([squeeze((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, body], ["doc_id", "text_id", "body"])

    return docs.mapInArrow(run, "doc_id bigint, text_id bigint, body binary")


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(expand(batch.column(2)[k].as_py()), np.uint8)
                spread = np.zeros(len(data) + 2, np.int32)
                heads, tails = (np.asarray(batch.column(c)[k].as_py(), np.int64) for c in (3, 4))
                np.add.at(spread, heads, 1)
                np.add.at(spread, tails + 1, -1)
                at = np.flatnonzero(np.cumsum(spread) > 0)
                offsets = np.array([0, len(data)])
                starts, ends, _ = spans(_INSIDE[data], offsets)
                h = [gram_hashes(span_hashes(data, starts, ends, salt), width)[at] for salt in (0, 1)]
                cols = [h[0].view(np.int64), h[1].view(np.int64), np.full(len(at), batch.column(0)[k].as_py()), np.full(len(at), batch.column(1)[k].as_py()), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "doc_id", "text_id", "at"])

    return run


def kept_words(text: bytes, heads: np.ndarray, tails: np.ndarray, width: int) -> tuple[int, int, bytes]:
    """Words, words under a window that starts at any place from a head to its tail, and the other words, joined by one space."""
    words = text.split()
    if not len(heads):
        return len(words), 0, b" ".join(words)
    spread = np.zeros(len(words) + 1, np.int64)
    np.add.at(spread, heads, 1)
    np.add.at(spread, np.minimum(tails + width, len(words)), -1)
    gone = np.cumsum(spread)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join(words[i] for i in np.flatnonzero(~gone))


def _removal(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            places = [[np.asarray(batch.column(c)[k].as_py() or [], np.int64) for c in (2, 3)] for k in range(batch.num_rows)]
            got = [kept_words(expand(batch.column(1)[k].as_py()), *places[k], width) for k in range(batch.num_rows)]
            cols = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].decode() for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs``.

    A word goes if a window over it also starts in a document with a smaller
    id. Null and empty texts have no words; texts shorter than a window stay
    whole, and so do rows with a null key, which is smaller or larger than
    none. Repeated rows share an id, so they do not remove each other, and each
    comes back. An empty table gives no rows; further columns are ignored.
    """
    if not 0 < gram <= width:
        raise ValueError("a gram is at most as wide as a window")
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = cut_lineage(suspects(cut_lineage(runs(narrow, width, gram))))
    equal = cut_lineage(found.groupBy("rep", "body").agg(F.min("doc_id").alias("low")))
    # different runs with one representative may share some windows
    mixed = equal.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    # runs that an equal run with a smaller id precedes are gone as a whole, and need not stand for their windows
    named = cut_lineage(found.join(equal, ["rep", "body"]).select("doc_id", "text_id", "rep", "head", "tail", (F.col("doc_id") > F.col("low")).alias("gone")))
    whole = named.where("gone").select("doc_id", "text_id", "head", "tail")
    by_doc = named.where("not gone").join(mixed, "rep", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_list("head").alias("heads"), F.collect_list("tail").alias("tails"))
    bodies = _packed(narrow)
    marked = bodies.join(by_doc, ["doc_id", "text_id"]).mapInArrow(_windows(width), "h1 bigint, h2 bigint, doc_id bigint, text_id bigint, at int")
    marked = cut_lineage(marked)
    first = marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    single = marked.join(first, ["h1", "h2"]).where("doc_id > low").select("doc_id", "text_id", F.col("at").alias("head"), F.col("at").alias("tail"))
    again = whole.unionAll(single).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("head", "tail")).alias("gone"))
    again = again.select("doc_id", "text_id", F.col("gone.head").alias("heads"), F.col("gone.tail").alias("tails"))
    return bodies.join(cut_lineage(again), ["doc_id", "text_id"], "left").select("doc_id", "body", "heads", "tails").mapInArrow(_removal(width), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS g FROM w, unnest(range(1, len(ws) - {WIDTH - 2})) u(i)),
low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
hit AS (SELECT rid, i FROM win JOIN low USING (g) WHERE doc_id > lo),
gone AS (SELECT DISTINCT rid, i + k AS p FROM hit, range({WIDTH}) r(k)),
word AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS body FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT rid, count(*) AS n FROM gone GROUP BY rid) USING (rid) LEFT JOIN kept USING (rid)
"""
