"""Packing of token sequences through the configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The
program asks for the least number of configurations that cover the histogram
of lengths, which has at most ``capacity`` entries whatever the corpus. It is
solved on the driver by multiplicative weights: the weight of a length falls as
it is covered, and a knapsack dynamic program finds the configurations of the
highest price. The solution is rounded to whole sequences and what is left solved again;
the last tenth goes to the sequence it fits best. Pieces then find their places by rank: the n-th piece of a length
takes the n-th slot of that length, so only counts ever leave the executors.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skyledger.llm.common import process_cache, table
from skyledger.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: share of the pieces that configurations of the program are to hold
HELD = 0.9
#: share of the shortest pieces kept aside, so that the last long ones find partners; it falls to nothing for the longest
RESERVE = 0.15
#: rows ranked together; the number of such groups stays under a million
GROUP_ROWS = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, special: bool = True) -> Callable[[str], list[int]]:
    """The encoder of a file, built once in each Python worker."""
    known = process_cache().setdefault("encoders", {})
    if (path, special) not in known:
        known[path, special] = build_encoder(path, special)
    return known[path, special]


def build_encoder(path: str, special: bool = True) -> Callable[[str], list[int]]:
    """Text to ids, as the ``tokenizers`` file at ``path`` gives them without added special tokens.

    A byte-level file whose merges are in order of their ids is run by tiktoken,
    which gives the same ids several times faster; other files, and texts that
    contain a special token, are run by ``tokenizers``. Without ``special`` the
    strings of special tokens are plain text.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not special
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return slow
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    names = [x["content"] for x in spec.get("added_tokens", [])]
    ranks = {bytes(to_byte[c] for c in token): k for token, k in model["vocab"].items() if token not in names}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [model["vocab"][m.replace(" ", "")] for m in merges]
    if order != sorted(order) or sorted(ranks.values()) != list(range(len(ranks))) or len(order) + 256 != len(ranks):
        return slow
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
    full = tiktoken.Encoding("full", pat_str=words + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    # where no two white spaces meet, both patterns cut alike, and this one needs no look-ahead
    single = tiktoken.Encoding("single", pat_str=words + r"|\s+", mergeable_ranks=ranks, special_tokens={})
    double = re.compile(r"\s\s").search
    marked = re.compile("|".join(map(re.escape, names))).search if special and names else lambda text: None

    def encode(text: str) -> list[int]:
        if marked(text):
            return slow(text)
        return (full if double(text) else single)._core_bpe.encode_ordinary(text)

    if not special:
        # the same ids as 32-bit numbers in a buffer; every byte of the text is in one of them
        encode.buffer = lambda text: (full if double(text) else single)._core_bpe.encode_to_tiktoken_buffer(text, set())
    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = array("I", encode(t.as_py() or ""))
                tokens.append(end_id)
                raw = memoryview(tokens)
                for k, (s, n) in enumerate(cut_points(len(tokens), capacity)):
                    doc.append(d), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(raw[s : s + n]))
                    if with_ids:
                        ids.append(tokens[s : s + n].tolist())
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room the highest price and the index of one item of it (-1: a unit stays empty). Lengths ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = values[:k] + best[c - lengths[:k]]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], choice[c] = got[i], i
    return best, choice


def filled(i: int, choice: list[int], sizes: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """The configuration of the highest price that holds item i: ({item: copies}, room left)."""
    config, room, left = {i: 1}, capacity - sizes[i], 0
    while room > 0:
        if (k := choice[room]) < 0:
            room -= 1
            left += 1
        else:
            config[k] = config.get(k, 0) + 1
            room -= sizes[k]
    return config, left


def relax(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 24, prices: int = 3, pull: float = 0.05) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional packing of the supply ``need`` by configurations ((item, copies), ...), by multiplicative weights.

    The price of a length is its share of the capacity, which is dual feasible,
    times a weight that rises while its supply is placed later than that of
    others. A round moves every length on to the same share of its supply,
    through the best configurations that hold it; a length that is ahead by a
    round has no price, so none runs out before the others.
    """
    done, use, sizes = np.zeros(len(lengths)), {}, lengths.tolist()
    total = need.tolist()
    for r in range(1, rounds + 1):
        share, most = r / rounds, min(1.0, (r + 1) / rounds)
        for _ in range(prices):
            values = lengths / capacity * np.exp(pull * (share - done / need))
            values[done >= most * need - 1e-9] = 0.0
            choice = price(values, lengths, capacity)[1].tolist()
            placed, moved = done.tolist(), False
            for i in range(len(sizes) - 1, -1, -1):
                if placed[i] >= total[i] * share - 1e-9:
                    continue
                config, _ = filled(i, choice, sizes, capacity)
                amount = min((total[k] * most - placed[k]) / c for k, c in config.items())
                amount = min(amount, (total[i] * share - placed[i]) / config[i])
                if amount > 1e-9:
                    moved = True
                    for k, c in config.items():
                        placed[k] += amount * c
                    key = tuple(sorted(config.items()))
                    use[key] = use.get(key, 0.0) + amount
            done = np.array(placed)
            if not moved:
                break
    return use


def rounded(use: dict[tuple[tuple[int, int], ...], float], lengths: np.ndarray, left: np.ndarray, capacity: int, spare: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Whole numbers of the configurations that leave at most ``spare`` tokens, by cumulative sums and within the supply ``left``, which is reduced."""
    sizes, out, total = lengths.tolist(), {}, 0.0
    room = {config: capacity - sum(sizes[k] * c for k, c in config) for config in use}
    for config in sorted(use, key=lambda x: (room[x], -use[x], x)):
        if room[config] > spare:
            break
        before = math.floor(total)
        total += use[config]
        n = min(math.floor(total) - before, *(int(left[k]) // c for k, c in config))
        if n > 0:
            out[config] = n
            for k, c in config:
                left[k] -= n * c
    return out


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Longest pieces first, each to the sequence with the least room that takes it; equal sequences are filled in one step."""
    open_at: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    mask, full = 0, {}
    for i in range(len(lengths) - 1, -1, -1):
        size, more = int(lengths[i]), int(left[i])
        while more:
            rooms = mask >> size
            if rooms:
                room = size + (rooms & -rooms).bit_length() - 1
                config, have = open_at[room].popitem()
            else:
                room, config, have = capacity, (), more
            # one sequence takes all it can hold before the next
            each = min(room // size, more)
            n = min(have, more // each)
            if rooms and n < have:
                open_at[room][config] = have - n
            if not open_at[room]:
                mask &= ~(1 << room)
            room, config = room - each * size, config + (i,) * each
            open_at[room][config] = open_at[room].get(config, 0) + n
            mask |= 1 << room
            more -= n * each
    for configs in open_at:
        for config, n in configs.items():
            config = tuple(sorted(config))
            full[config] = full.get(config, 0) + n
    return full


def by_program(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], int], int]:
    """Whole configurations (items with repeats, ascending) of all pieces, and how many pieces the program's own configurations hold.

    The relaxation of what is left is solved and rounded again until ``HELD`` of
    the pieces have a place: first only configurations without waste are taken,
    then such that leave 1, 2, 4, ... up to a 128th of the capacity. The best
    fit completes the plan.
    """
    left, out, held = need.copy(), {}, 0
    reach = np.cumsum(need * RESERVE * (1 - lengths / capacity) ** 2)
    reserve = np.diff(np.floor(reach), prepend=0).astype(np.int64)
    spare = 0
    while held < HELD * need.sum() and spare <= capacity // 128:
        left -= reserve
        at = np.flatnonzero(left)
        some = left[at]
        got = rounded(relax(lengths[at], some, capacity), lengths[at], some, capacity, spare)
        moved = 0
        for config, n in got.items():
            key = tuple(int(at[k]) for k, c in config for _ in range(c))
            out[key] = out.get(key, 0) + n
            moved += n * len(key)
        held += moved
        before, left[at] = int(left.sum()), some
        left += reserve
        if moved <= before // 10:
            spare = max(1, 2 * spare)
    for config, n in best_fit(lengths, left, capacity).items():
        out[config] = out.get(config, 0) + n
    return out, held


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole configurations ({length: pieces}, how often) that hold exactly the pieces of the histogram.

    They come from the program, or from best fit alone where that needs fewer sequences.
    """
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(n for n, c in histogram.items() if c and n < capacity), dtype=np.int64)
    if not len(lengths):
        return out
    need = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    whole, _ = by_program(lengths, need, capacity)
    plain = best_fit(lengths, need, capacity)
    if sum(plain.values()) < sum(whole.values()):
        whole = plain
    for config, n in sorted(whole.items()):
        kinds, counts = np.unique(config, return_counts=True)
        out.append(({int(lengths[k]): int(c) for k, c in zip(kinds, counts)}, n))
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of that length in it, offset of the first), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for config, n in plan:
        offset = 0
        for length, count in sorted(config.items()):
            rows.append((length, rank.get(length, 0), sequence, count, offset))
            rank[length] = rank.get(length, 0) + n * count
            offset += length * count
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table with ``length``, ``doc_id``, ``piece``, ``ids_crc32``) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = slots(solve(histogram, capacity))
    rows = max(GROUP_ROWS, math.ceil(sum(histogram.values()) / 1_000_000))
    # groups of each length: an array of at most ``capacity`` + 1 numbers
    groups = F.lit([max(1, math.ceil(histogram.get(n, 0) / rows)) for n in range(capacity + 1)])
    salted = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(groups, F.col("length").cast("int"))))
    first = salted.groupBy("length", "_group").agg(F.count("*").alias("n"))
    first = first.select("length", "_group", (F.sum("n").over(Window.partitionBy("length").orderBy("_group")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_own", own).join(first, ["length", "_group"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    keep = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan[:, 0] << 48) | plan[:, 1]
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_rank", "length"))
            at = plan[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
            nth = rank - at[:, 1]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at[:, 2] + nth // at[:, 3]), pa.array(at[:, 4] + nth % at[:, 3] * length)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*keep, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and offset; ``with_ids`` carries the token ids along.

    Null and empty texts give one piece, the end id. Longer documents are cut
    into pieces of the capacity, of which the first may be shorter. Repeated
    rows are packed as often as they come, a null key stays null, an empty
    table gives no rows, further columns are ignored.
    """
    return place(cut_lineage(pieces(docs, text, key, vocabulary, capacity, end_id, with_ids)), capacity)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: all documents it is given, as placed pieces with their token ids' checksum."""
    return pack(docs)
