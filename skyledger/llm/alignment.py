"""Alignment of two tokenizers' tokens by diagonal run skipping, and how often tokens meet.

Both tokenizations of a text spell the same bytes, so tokens are compared by
their end offsets. While the two end arrays agree at one index shift, every
token has exactly one partner; such a stretch is measured by exponential
probing (slices of 4, 8, 16, ... ends compared at the current shift) and a
binary search in the last slice, and jumped over. Where the ends part, the
group is closed by two pointers at the next common end, and the shift updated.

A first pass tokenizes, aligns and stores for each document its id pairs and how
often each is linked, compressed. How many documents hold a pair is counted in
each partition first and then merged. The second pass reads the stored pairs:
counts of the ``HEAD`` most frequent pairs travel to the tasks (a fixed number),
all other pairs meet their counts in a join, so both give the same sums.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.common import process_cache, table
from skyledger.llm.packing import default_vocabulary, encoder
from skyledger.session import cut_lineage

#: pairs whose counts are sent to every task (12 bytes each); the others are joined
HEAD = 1 << 17
#: pairs of a partition counted together before they are handed on
COUNT_BLOCK = 1 << 21


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    vocab = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    out = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        out[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of every id of a sentencepiece model."""
    return [bytes([int(model.id_to_piece(k)[1:-1], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in range(model.vocab_size())]


class Pair:
    """Both tokenizers with the bytes and byte lengths of their ids, and what each id adds to a description, inside a group and at its end."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_a = encoder(a_path, special=False)
        self.encode_b = lambda text: model.encode(text, num_threads=1)
        self.bytes_a, self.bytes_b = byte_level_tokens(a_path), piece_tokens(model)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        names = [f"{k}{end}" for size, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for k in range(size) for end in (",", last)]
        self.names, self.start_b = np.array(names, dtype=np.bytes_), 2 * len(self.bytes_a)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A (of space and text) and of B; none if the text is null or empty, or the bytes of either differ from space and text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        spelled = f" {text}"
        want = spelled.encode()
        b = self.encode_b(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return none, none
        if buffer := getattr(self.encode_a, "buffer", None):
            a = np.frombuffer(buffer(spelled), np.uint32).astype(np.int64)
            same = int(self.size_a[a].sum()) == len(want)
        else:
            a = np.array(self.encode_a(spelled), np.int64)
            same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want
        return (a, np.array(b, np.int64)) if same else (none, none)


def pair_of(a_path: str, b_path: str) -> Pair:
    """Built once in each Python worker."""
    known = process_cache().setdefault("aligned", {})
    if (a_path, b_path) not in known:
        known[a_path, b_path] = Pair(a_path, b_path)
    return known[a_path, b_path]


def run_length(x: list[int], y: list[int], i: int, j: int) -> int:
    """How many ends agree from x[i] and y[j] on: slices of 4, 8, ... ends, then a binary search in the last."""
    most = min(len(x) - i, len(y) - j)
    done, probe = 0, 4
    while done < most:
        step = min(probe, most - done)
        if x[i + done : i + done + step] != y[j + done : j + done + step]:
            break
        done += step
        probe *= 2
    else:
        return most
    # ends differ somewhere in this slice: halve it, and walk through the last four
    low, high = 0, step - 1
    while high - low > 3:
        mid = (low + high + 1) // 2
        if x[i + done : i + done + mid] == y[j + done : j + done + mid]:
            low = mid
        else:
            high = mid - 1
    done += low
    while x[i + done] == y[j + done]:
        done += 1
    return done


def align(x: list[int], y: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Groups of two ascending end arrays with one last end: (first of x, first of y, one-to-one groups from there).

    An entry with 0 groups is irregular and reaches to the next entry; all
    others stand for that many groups of one token each.
    """
    at_x, at_y, runs = [], [], []
    i = j = 0
    n, m = len(x), len(y)
    while i < n:
        if x[i] == y[j]:
            k = run_length(x, y, i, j)
            at_x.append(i)
            at_y.append(j)
            runs.append(k)
            i += k
            j += k
            if i == n:
                break
        at_x.append(i)
        at_y.append(j)
        runs.append(0)
        p, q = x[i], y[j]
        while p != q:
            if p < q:
                i += 1
                p = x[i]
            else:
                j += 1
                q = y[j]
        i += 1
        j += 1
    return at_x, at_y, runs


def links_of(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Packed (A id, B id) of every linked occurrence."""
    one = runs > 0
    step = np.arange(int(runs[one].sum())) - np.repeat(np.cumsum(runs[one]) - runs[one], runs[one])
    regular = (a[np.repeat(at_a[one], runs[one]) + step] << 32) | b[np.repeat(at_b[one], runs[one]) + step]
    n_a = (np.append(at_a[1:], len(a)) - at_a)[~one]
    n_b = (np.append(at_b[1:], len(b)) - at_b)[~one]
    each = n_a * n_b
    nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    width = np.repeat(n_b, each)
    crossed = (a[np.repeat(at_a[~one], each) + nth // width] << 32) | b[np.repeat(at_b[~one], each) + nth % width]
    return np.concatenate([regular, crossed])


def pair_counts(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, runs: np.ndarray, crowd: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct id pairs, ascending, how often each is linked, and the number of links.

    A group with more than ``crowd`` links is reduced to its distinct ids and
    their counts first, so no group is spread out into all its pairs.
    """
    n_a, n_b = np.append(at_a[1:], len(a)) - at_a, np.append(at_b[1:], len(b)) - at_b
    large = np.flatnonzero((runs == 0) & (n_a * n_b > crowd))
    keys, times = [], []
    for g in large.tolist():
        ua, ca = np.unique(a[at_a[g] : at_a[g] + n_a[g]], return_counts=True)
        ub, cb = np.unique(b[at_b[g] : at_b[g] + n_b[g]], return_counts=True)
        keys.append(((ua[:, None] << 32) | ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
    if len(large):
        # what is left: the stretches between the large groups, moved together
        keep = np.ones(len(at_a), bool)
        keep[large] = False
        in_a = np.repeat(keep, n_a)
        in_b = np.repeat(keep, n_b)
        move_a, move_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        at_a, at_b, runs = move_a[at_a[keep]], move_b[at_b[keep]], runs[keep]
        a, b = a[in_a], b[in_b]
    pairs, n = np.unique(links_of(a, b, at_a, at_b, runs), return_counts=True)
    keys.append(pairs)
    times.append(n)
    if len(large):
        pairs, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, back, np.concatenate(times))
    return pairs, n, int(n.sum())


def described(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, runs: np.ndarray, names: np.ndarray, start_b: int) -> tuple[int, str]:
    """Number of groups, and SHA-256 of ``a1,a2|b1;a3|b2,b3``."""
    each = np.maximum(runs, 1)
    n = int(each.sum())
    step = np.arange(n) - np.repeat(np.cumsum(each) - each, each)
    first_a, first_b = np.repeat(at_a, each) + step, np.repeat(at_b, each) + step
    n_a, n_b = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[first_a + n_a - 1] = last_b[first_b + n_b - 1] = 1
    # an A token follows the B tokens of the groups before its own, a B token also the A tokens of its own
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.repeat(first_b, n_a)] = 2 * a + last_a
    code[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = 2 * b + last_b + start_b
    spelled = names[code].view(np.uint8)
    return n, hashlib.sha256(spelled[spelled != 0][:-1].tobytes()).hexdigest()


def _aligned(a_path: str, b_path: str):
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a_path, b_path)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for text in batch.column(2):
                a, b = both.tokens(text.as_py())
                if not len(a):
                    rows.append((0, 0, 0, 0, "", b""))
                    continue
                cut = align(both.size_a[a].cumsum().tolist(), both.size_b[b].cumsum().tolist())
                cut = [np.array(v, np.int64) for v in cut]
                n_groups, sha = described(a, b, *cut, both.names, both.start_b)
                keys, times, n_links = pair_counts(a, b, *cut)
                packed = np.concatenate([(keys >> 32).astype(np.int32).view(np.uint8), keys.astype(np.uint32).view(np.uint8), times.view(np.uint8)])
                rows.append((len(a), len(b), n_groups, n_links, sha, squeeze(packed.tobytes())))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return run


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(packed pair, times linked) of a stored document."""
    if not blob:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 16
    high, low = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint32, n, 4 * n)
    return (high.astype(np.int64) << 32) | low, np.frombuffer(raw, np.int64, n, 8 * n)


def document_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many of the stored documents a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty((0, 2), np.int64)
        held, waiting = 0, []

        def merged() -> np.ndarray:
            pairs, back = np.unique(np.concatenate([known[:, 0], *waiting]), return_inverse=True)
            weight = np.ones(len(back), np.int64)
            weight[: len(known)] = known[:, 1]
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, back, weight)
            return np.stack([pairs, total], 1)

        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["pair", "n"])

        for batch in batches:
            for blob in batch.column(0):
                waiting.append(unpack(blob.as_py())[0])
                held += len(waiting[-1])
                if held > COUNT_BLOCK:
                    known, held, waiting = merged(), 0, []
                    if len(known) > COUNT_BLOCK:
                        yield out(known)
                        known = np.empty((0, 2), np.int64)
        yield out(merged())

    part = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint")
    return part.groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, pieces: str | None = None, head: int = HEAD) -> DataFrame:
    """For every row of ``docs`` its tokens, groups and links under two tokenizers, and how common its links are.

    A link is an occurrence of an A and a B token in one group; the count of an
    id pair is the number of rows of ``docs`` that link it, ``n_best`` the links
    whose count is the highest of their A id, ties included, ``count_sum`` the
    counts summed over the links. Null and empty texts, and texts that a
    tokenizer does not give back byte by byte, have no tokens: zeros and an
    empty string. Repeated rows are documents of their own and come back as
    often as they come, a null key stays null, an empty table gives no rows,
    further columns are ignored.
    """
    a_path, b_path = vocabulary or default_vocabulary(), pieces or default_pieces()
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary"
    aligned = cut_lineage(narrow.mapInArrow(_aligned(a_path, b_path), schema))
    counts = cut_lineage(document_counts(aligned))
    # at most one row for each id of A
    best = counts.groupBy(F.shiftright("pair", 32).cast("int").alias("a")).agg(F.max("n").alias("n")).toPandas()
    top = counts.orderBy(F.desc("n"), "pair").limit(head).toPandas().sort_values("pair")
    top_pair, top_n = top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    best_n = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    best_n[best["a"].to_numpy(np.int64)] = best["n"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((top_pair, top_n, best_n))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, highest = sent.value
        for batch in batches:
            best_links, sums, tails = [], [], []
            for blob in batch.column(6):
                keys, times = unpack(blob.as_py())
                at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
                known = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                count = np.where(known, n[at] if len(pair) else 0, 0)
                best_links.append(int(times[known & (count == highest[keys >> 32])].sum()))
                sums.append(int((count * times).sum()))
                tails.append([{"pair": int(k), "times": int(t)} for k, t in zip(keys[~known], times[~known])])
            cols = [batch.column(k) for k in range(6)] + [batch.column(7), pa.array(best_links, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(tails, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))], out_names)

    out_names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "n_best", "count_sum", "tail"]
    out_schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, row bigint, n_best bigint, count_sum bigint, tail array<struct<pair:bigint,times:bigint>>"
    weighed = cut_lineage(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "row").mapInArrow(weigh, out_schema))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    rare = weighed.where(F.size("tail") > 0).select("row", F.inline("tail")).join(counts, "pair")
    rare = rare.join(highest, F.shiftright("pair", 32) == F.col("a"))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    total = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return weighed.drop("tail").join(rare, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more"), "groups_sha256")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(table(spark, folder, "documents"))
