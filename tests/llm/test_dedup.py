import numpy as np
import pytest
import xxhash
from brute import Sets, documents, frame, removal, same, words

from skyledger.llm import common, pivots, simhash, substrings
from skyledger.llm.common import components, forest
from pyspark.sql import functions as F

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text):
    w = [x.encode().translate(FOLD) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark))
    fp = [fingerprint(r[1]) for r in rows]
    sets = Sets()
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 3:
                sets.join(i, j)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[sets.find(k)] = min(low.get(sets.find(k), r[0]), r[0])
    same([tuple(r) for r in got.collect()], [(r[0], f"{fp[k]:016x}", low.get(sets.find(k))) for k, r in enumerate(rows)])


@pytest.mark.parametrize("crowd", [4096, 3])
def test_simhash_links_find_every_pair(spark, monkeypatch, crowd):
    """Random fingerprints with neighbours at distances 1 to 5, also where every anchor is split."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, d, replace=False)) for b in base for d in (1, 2, 3, 3, 4, 5)]
    fps = np.unique(np.concatenate([base, np.array(near, np.int64), -base[:5]]))
    sets = Sets()
    for k, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count((fps ^ f).view(np.uint64)) <= 3):
            sets.join(int(fps[k]), int(fps[j]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp bigint")
    found = {r["node"]: r["component"] for r in components(simhash.links(df)).collect()}
    for f in fps.tolist():
        assert found.get(f, f) == sets.find(f)


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    """Entries of anchors and edges are larger than Spark takes them for, so no join may send them through the driver."""
    plans, cut = [], common.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(common, "cut_lineage", seen)
    monkeypatch.setattr(simhash, "cut_lineage", seen)
    out = simhash.near_duplicates(frame(spark))
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


def test_simhash_stage_keeps_one_of_each_group(spark):
    docs = frame(spark)
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert sum(r[0] is None for r in rows) == 2
    ids = sorted(r[0] for r in rows if r[0] is not None)
    component = {r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["component_id"] is not None}
    assert ids == sorted(component)
    assert simhash.stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("width,gram", [(50, 8), (5, 2), (3, 3)])
def test_substrings_equal_brute_force(spark, width, gram):
    got = substrings.remove_repeats(frame(spark), width=width, gram=gram)
    got = got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    same([tuple(r) for r in got.collect()], removal(documents(), width))


def test_sketch_keeps_every_repeated_run(spark):
    runs = spark.createDataFrame([(k, 0, (k // 2 if k < 40 else k) * 7919, 0, 1) for k in range(500)], "doc_id bigint, text_id bigint, rep bigint, head int, tail int")
    kept = {r["doc_id"] for r in substrings.suspects(runs).collect()}
    assert set(range(40)) <= kept and len(kept) < 300


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark).limit(0)).count() == 0


def vectors(rng):
    base = rng.normal(size=(60, 24))
    out = [b.tolist() for b in base]
    for b in base:
        for noise in (0.05, 0.1, 0.15, 0.2, 0.3):
            out.append((b * rng.uniform(0.1, 9) + np.linalg.norm(b) * noise * rng.normal(size=24) / 5).tolist())
    out += [base[0].tolist()] * 40
    rows = [(k, v, k % 3) for k, v in enumerate(out)]
    return rows + [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [None] + [1.0] * 23, 1), (9004, [float("inf")] * 24, 1), (9005, [], 1), (None, base[1].tolist(), 2), (9006, base[2].tolist()[:12], 0), (3, base[3].tolist(), 0)]


@pytest.mark.parametrize("block", [1024, 8])
def test_pivots_against_brute_force(spark, block):
    rows = vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("links", F.lit(1))
    got = pivots.near_duplicates(df, pivots=64, block=block).collect()
    assert len(got) == len(rows)
    good = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    linked, found = 0, 0
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in good]
    want = [sum(len(a) == len(b) and a @ b >= 0.95 for b in unit) - 1 for a in unit]
    have = Counter_by_id(got)
    for r, n in zip(good, want):
        if [x[0] for x in rows].count(r[0]) > 1 or r[0] is None:
            continue
        assert have[r[0]][0] <= n
        linked, found = linked + n, found + have[r[0]][0]
    assert linked > 1000 and found >= 0.9 * linked
    for i in (9000, 9001, 9002, 9003, 9004, 9005, 9006):
        assert have[i] == (0, i, True)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_pivots_find_a_group_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(3000, 64)), rng.normal(size=(1, 64)) + 0.18 * rng.normal(size=(1500, 64))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = pivots.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    have = np.array([r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert want.sum() > 1_000_000 and (have <= want).all() and have.sum() >= 0.98 * want.sum()
    assert len({r["component_id"] for r in got if want[r["vec_id"]]}) == 1


def Counter_by_id(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}


def test_pivots_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert pivots.near_duplicates(df).count() == 0


def test_components_and_forest(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    df = spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: sets.find(x) for a, b in edges for x in (a, b) if a != b}
    x, y = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert all(sets.find(int(a)) == int(b) for a, b in zip(x, y)) and len(set(x.tolist())) == len(x)
