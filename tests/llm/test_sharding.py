import random
import zlib
from collections import Counter

import pytest
from llm_helpers import rows_of

from lodestrata.llm.sharding import SlotMap, shard_documents


def test_rebalancing_nears_equal_and_keeps_versions():
    rng = random.Random(0)
    sizes = {s: rng.choice([0, 10, 50, 400]) + rng.randint(0, 30) for s in range(2048)}
    first = SlotMap.first(24, 2048)
    second = first.rebalanced(sizes)
    load = [sum(sizes[s] for s, o in enumerate(second.owner) if o == k) for k in range(24)]
    assert max(load) - min(load) <= 2 and second.version == 2 and second.parent is first
    assert sum(a == b for a, b in zip(first.owner, second.owner)) > 1400  # few slots move
    assert first.rebalanced({}).owner == first.owner


def test_growth_only_feeds_the_new_shard():
    before = SlotMap.first(24, 2048)
    after = before.grown()
    moved = [b for a, b in zip(before.owner, after.owner) if a != b]
    assert set(moved) == {24} and abs(len(moved) - 2048 / 25) < 20


def check(df, shards):
    out, slot_map = shard_documents(df, shards)
    got = out.collect()
    rows = rows_of(df)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert all(slot_map.owner[r["virtual_slot"]] == r["shard"] for r in got)
    return got


def test_documents(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"), 8)
    load = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(load) - min(load) < 0.01 * sum(load)


def test_hostile(hostile, empty, spark):
    check(hostile, 3)
    assert shard_documents(empty, 3)[0].count() == 0
    assert SlotMap.first(3, 12).table(spark).count() == 12


def test_a_record_that_a_third_of_the_rows_repeat(spark):
    """Equal rows, and rows that share an id, fill no slot more than others do."""
    rows = [(7, "the same text " * 3)] * 1000 + [(7, f"another text {i}") for i in range(1000)] + [(i, f"text number {i} " * 2) for i in range(1000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 24)
    load = [sum(r["size"] for r in got if r["shard"] == k) for k in range(24)]
    assert max(load) - min(load) < 0.01 * sum(load)
    assert max(Counter(r["virtual_slot"] for r in got).values()) < 10


def test_versions_are_stored_and_go_on(spark, tmp_path):
    path = str(tmp_path / "maps")
    schema = "doc_id long, text string"
    rows = [(i, "word " * (i % 40)) for i in range(4000)]
    few, first = shard_documents(spark.createDataFrame(rows[:2000], schema), 8, 512, maps=path)
    assert first.version == 2 and SlotMap.load(spark, path).owner == first.owner
    more, second = shard_documents(spark.createDataFrame(rows, schema), 8, 512, maps=path)
    assert second.version == 3 and second.parent.owner == first.owner and SlotMap.load(spark, path, 2).owner == first.owner
    slots = {r["doc_id"]: r["virtual_slot"] for r in few.collect()}
    got = more.collect()
    assert all(slots.get(r["doc_id"], r["virtual_slot"]) == r["virtual_slot"] for r in got)  # a record keeps its slot
    assert {r["map_version"] for r in got} == {3} and all(second.owner[r["virtual_slot"]] == r["shard"] for r in got)
    moved = sum(a != b for a, b in zip(first.owner, second.owner))
    assert moved < 256
    _, grown = shard_documents(spark.createDataFrame(rows, schema), 9, 512, maps=path)
    assert grown.version == 5 and grown.shards == 9 and max(SlotMap.load(spark, path, 4).owner) == 8
    with pytest.raises(ValueError, match="slots"):
        shard_documents(spark.createDataFrame(rows, schema), 9, 256, maps=path)
