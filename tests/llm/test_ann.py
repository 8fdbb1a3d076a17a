import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import forest_ann as fa
from lodestrata.llm.forest_ann import op1_hash_prefix_forest, search


def brute(rows, queries, k):
    """{query id: [(id, score)]} by all inner products; equal rows count once."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in {x for x in good if any(x[0] == y[0] for y in queries)}:
        best = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, x in good if i != q and len(x) == len(v))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def by_query(got):
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all([r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == list(range(1, len(v) + 1)) for q, v in by.items())
    return by


def recall_of(by, want):
    return np.mean([len({i for i, _ in by[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_on_embeddings(spark, sf):
    got = op1_hash_prefix_forest(spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [x for x in rows if x[0] % 20 == 0], 20)
    by = by_query(got)
    assert set(by) == set(want) and all(len(v) == 20 for v in by.values())
    assert recall_of(by, want) >= 0.9
    exact = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in by.items():
        assert [s for _, s in found] == pytest.approx([float(exact[i] @ exact[q]) for i, _ in found], abs=1e-12)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)


def test_hostile_vectors_and_ties(spark):
    """At an effort beyond all strings every candidate is looked at, so the result is exact. Ties go
    to smaller ids."""
    same = [1.0, 0.0, 2.0]
    rows = [(i, same) for i in range(40)] + [(50, None), (51, []), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 0.0]), (54, [float("nan"), 1.0, 0.0]), (55, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (60, [-0.0, 3.0, 1.0]), (61, [5.0, 5.0, 5.0]), (61, [5.0, 5.0, 5.0]), (62, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int, dim int")
    asked = df.where("vec_id % 20 = 0 or vec_id > 50")
    want = {q: v for q, v in brute(rows, [x for x in rows if x[0] is not None and (x[0] % 20 == 0 or x[0] > 50)], 5).items() if v}
    assert by_query(search(df, asked, k=5, effort=1e9).collect()) == want
    assert by_query(search(df, asked, k=5).collect()).keys() == want.keys()
    assert search(df.where("false"), df.where("false")).count() == 0
    assert search(df, df.where("false")).count() == 0


def test_rows_that_share_an_id(spark):
    """None of them is a candidate of a query of that id, however many there are."""
    rng = np.random.default_rng(0)
    rows = [(20, rng.standard_normal(4).round(3).tolist()) for _ in range(60)] + [(i, (rng.standard_normal(4) / 10).round(3).tolist()) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, df.where("vec_id = 20").limit(1), k=5, effort=1e9).collect()
    assert len(got) == 5 and all(r["vec_id"] != 20 for r in got)


def test_huge_components_keep_their_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * 1e150).tolist()) for i in range(80)] + [(100, [1e300, -1e300, 0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(search(df, df.where("vec_id % 20 = 0"), k=5, effort=1e9).collect())
    assert got.keys() == {0, 20, 40, 60, 100} and all(len(v) == 5 for v in got.values())
    assert [i for i, _ in got[20]] == [i for i, _ in brute(rows[:80], [(20, None)], 6)[20] if i != 100][:5] or 100 in [i for i, _ in got[20]]


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((max(n // 100, 1), dim))
    x = centre[rng.integers(0, len(centre), n)] + 0.1 * rng.standard_normal((n, dim))
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def test_cells_at_every_depth(spark):
    """Cells of a few strings, dense ones deepened: nothing is lost, and the ascent stops where it
    should."""
    x = np.vstack([clustered(900), np.tile(clustered(1, seed=5), (200, 1)) + 1e-9 * np.random.default_rng(3).standard_normal((200, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    want = brute(list(enumerate(x.tolist())), [(i, None) for i in range(0, 1100, 20)], 10)
    held, how = fa.index(df, 10, "vec_id", "embedding", 4)
    entries = held.select("dim", F.posexplode("keys").alias("tree", "key"))
    cut = fa.cells(entries, 30, 2)
    assert cut.where("n > 30 and depth < 32").isEmpty() and cut.select("depth").distinct().count() > 2
    assert {r["n"] for r in cut.groupBy("tree").agg(F.sum("n").alias("n")).collect()} == {held.count()}
    assert by_query(search(df, asked, k=10, effort=1e9, trees=4, room=30).collect()) == want
    few = by_query(search(df, asked, k=10, effort=200, trees=4, room=30).collect())
    assert 0.5 < recall_of(few, want) <= 1
    assert few == by_query(search(df, asked, k=10, effort=200, trees=4, room=5000).collect())  # cells change no result


def test_clustered_vectors_need_few_candidates(spark):
    x = clustered(6000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    held, how = fa.index(df, 20, "vec_id", "embedding", fa.TREES)
    hashed = how.hashed(fa.usable(asked).select(F.col("vec_id").alias("query_id"), "v"), True)
    table = fa.measured(held, hashed, how, 20)
    assert table["recall"].is_monotonic_increasing and table["share"].is_monotonic_increasing
    assert table[table["recall"] >= 0.97]["share"].iloc[0] < 0.25
    ids, got = np.arange(0, 6000, 20), by_query(search(df, asked, k=20).collect())
    s = x[ids] @ x.T
    s[np.arange(len(ids)), ids] = -np.inf
    want = {int(q): [(int(i), 0) for i in np.argsort(-row)[:20]] for q, row in zip(ids, s)}
    assert recall_of(got, want) >= 0.9
