from llm_helpers import collected, oracle, rows_of
from test_line_dedup import plain, result
from test_near_dedup import brute

import corpus_pipeline as cp
from lodestrata.llm import line_dedup, quality_pu, queries
from lodestrata.session import stored


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    f = dict(cp.STAGES)
    good = stored(f["quality"](spark, docs, sf), "t")
    accepted = {r["doc_id"] for r in quality_pu.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted and good.columns == docs.columns
    lines = stored(f["line_dedup"](spark, good, sf), "t")
    assert lines.columns == docs.columns
    want = plain(rows_of(good))
    assert sorted(str((w[0], w[3])) for w in want) == sorted(str((r[0], r[3])) for r in result(lines.selectExpr("doc_id", "text", "0 as n_lines", "0 as n_dropped")))
    near = stored(f["near_dedup"](spark, lines, sf), "t")
    assert {str(r["doc_id"]) for r in near.collect()} == {x[0] for x in brute(rows_of(lines), 80) if x[3]}
    mixed = stored(f["mixing"](spark, near, sf), "t")
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in near.collect()} and mixed.columns == docs.columns
    packed = f["packing"](spark, mixed, sf)
    assert packed.select("doc_id").distinct().count() == near.select("doc_id").distinct().count()
    assert cp.run(spark, sf).count() == packed.count()


def test_stages_on_hostile_rows(spark, hostile, empty, sf):
    for rows in (hostile, empty):
        docs = rows
        for name, stage in cp.STAGES[:-1]:
            out = stored(stage(spark, docs, sf), name)
            assert out.columns == docs.columns
            docs = out
        cp.STAGES[-1][1](spark, docs, sf).collect()


def test_registered_queries(spark, sf):
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert collected(line_dedup.op3_line_dedup(spark, sf)) == oracle(sf, line_dedup.OP3_SQL)
