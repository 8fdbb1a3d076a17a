import hashlib
import random

import numpy as np
import pytest
from llm_helpers import HOSTILE, rows_of

from lodestrata.llm.line_dedup import SENT_BYTES, CuckooFilter, LineIndex, deduplicated, op3_line_dedup

WS = " \t\n\x0b\x0c\r"


def plain(rows, min_docs=3, min_chars=20):
    """The same by dictionaries: {row number: (n_lines, n_dropped, text)}."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(fold)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    order = lambda i: (i is not None, i or 0)
    gone = {k: max(v, key=order) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    shared = [f"shared line number {i} with enough characters" for i in range(12)] + ["short", "ÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄ", "ÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄÄ"]
    rows = []
    for i in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(f"{rng.choice(['', ' ', chr(9)])}{x.upper() if rng.random() < 0.3 else x}{rng.choice(['', chr(13)])}" for x in lines)))
    return rows


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000)
    f = CuckooFilter.of(keys[:2000])
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).mean() < 0.01
    f.delete(keys[:1000])
    assert f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).mean() < 0.01
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert (again.contains(keys) == f.contains(keys)).all()
    assert not CuckooFilter(0).contains(keys).any()


def test_against_plain(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(LineIndex.build(df).apply(df)) == plain(docs)


def test_filters_beyond_the_bound_are_probed_by_shard(spark, docs, monkeypatch):
    """With no room to send the filters, postings are dealt to them: the result is the same, and
    what the filters lack never reaches the exact table."""
    monkeypatch.setattr("lodestrata.llm.line_dedup.SHARD_KEYS", 1)
    monkeypatch.setattr("lodestrata.llm.line_dedup.LEAST_SHARDS", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = LineIndex.build(df)
    assert index.shards >= index.refs.count() > 2
    assert result(index.apply(df, indexed=True, sent_bytes=-1)) == plain(docs)
    few = index._probed_by_shard(index.postings)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, index._probed_at_source(index.postings).collect()))
    assert index.refs.count() <= few.select("k1", "k2").distinct().count() < index.postings.select("k1", "k2").distinct().count()


def test_insert_and_delete_are_reversible(spark, docs):
    schema = "doc_id long, text string"
    df, half = spark.createDataFrame(docs, schema), spark.createDataFrame(docs[:60], schema)
    rest = spark.createDataFrame(docs[60:], schema)
    index = LineIndex.build(half)
    grown = index.insert(rest)
    assert result(grown.apply(df)) == plain(docs)
    back = grown.delete(rest)
    assert result(back.apply(half)) == plain(docs[:60])
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, index.refs.collect()))
    assert result(index.apply(half)) == plain(docs[:60])  # the old version still stands


def test_hostile(hostile, empty):
    out = LineIndex.build(hostile).apply(hostile)
    assert result(out) == plain(rows_of(hostile))
    assert set(out.columns) == {*hostile.columns, "n_dropped"}
    assert LineIndex.build(hostile).apply(hostile, counts=None).columns == hostile.columns
    assert LineIndex.build(empty).apply(empty).count() == 0


@pytest.mark.parametrize("sent", [SENT_BYTES, -1])
def test_rows_of_one_document_count_once(spark, sent):
    two, nulls, three = "held by two documents only", "held by two rows without an id", "held by three documents, one twice"
    rows = [(1, two), (1, two), (1, two), (2, two), (None, nulls), (None, nulls), (3, nulls), (4, three), (4, three), (5, three), (None, three), (6, "own line of document six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(deduplicated(df, sent_bytes=sent))
    assert got == plain(rows)
    assert sum(dropped for _, _, dropped, _ in got) == 3


def test_registered_query_on_repeated_and_hostile_rows(spark, tmp_path):
    rows = [*HOSTILE, *[(i, t) for i, t in HOSTILE], (20, "a line of more than twenty"), (20, "A line of more than twenty "), (21, "a line of more than twenty"), (None, "a line of more than twenty")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op3_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == plain(rows)


def test_columns_named_like_working_ones_pass(spark):
    rows = [(i, "one line that three documents hold\nown " + str(i), "x", 1, "y") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __gone int, __cut string")
    out = deduplicated(df, counts=None)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(0, "own 0", "x", 1, "y"), (1, "own 1", "x", 1, "y"), (2, rows[2][1], "x", 1, "y")]
