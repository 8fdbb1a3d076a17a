"""Queries that read whole tables, against plain Python or SQL over all rows."""

import math
import random

import pytest
from test_operators import union_find

from lodestrata.plans import registry


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_components_link_every_supplier(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(120), rng.randrange(90), rng.randrange(5)) for _ in range(110)]
    write(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_partkey long, l_suppkey long")
    got = {r["vertex"]: r["component"] for r in registry.QUERIES["q_components"](spark, str(tmp_path)).collect()}
    assert got == union_find([(o * 2, p * 2 + 1) for o, p, _ in rows])
    assert 1 < len(set(got.values())) < len({o for o, _, _ in rows})


def test_conflict_sets_hold_every_part(spark, tmp_path):
    rows = [(5, "red ring", 1), (6, "blue bolt", 1), (7, "blue bolt", 2), (8, "red ring", 2), (9, "red ring", 3), (40, "hot gear", 4), (41, "red ring", 4), (42, "blue bolt", 4)]
    write(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_size long")
    got = {r["names"]: (r["n_catalogs"], r["n_images"]) for r in registry.QUERIES["q_conflict_sets"](spark, str(tmp_path)).collect()}
    assert got == {"blue bolt | red ring": (2, 4), "blue bolt | hot gear | red ring": (1, 3)}


def test_every_verdict_is_judged(spark, tmp_path):
    rows = [("F", "A", 1), ("F", "N", 1), ("F", "N", 2), ("F", "N", 3), ("O", "R", 1), ("O", "A", 2), ("O", "N", 2), ("O", "R", 4)]
    write(spark, tmp_path, "lineitem", rows, "l_linestatus string, l_returnflag string, l_linenumber int")
    got = {r["domain"]: (r["judged"], r["ok"], r["fix"], r["drop"], r["rate"]) for r in registry.QUERIES["q_error_rate_wilson"](spark, str(tmp_path)).collect()}
    assert got == {"F": (4, 3, 1, 0, 0.25), "O": (4, 1, 1, 2, 0.75)}
    [r] = registry.QUERIES["q_two_proportion"](spark, str(tmp_path)).collect()
    z = (0.25 - 0.75) / math.sqrt(0.5 * 0.5 * (1 / 4 + 1 / 4))
    assert (r["d1"], r["d2"]) == ("F", "O") and r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-8)


def test_mask_iou_of_every_neighbour(spark, tmp_path):
    rows = [(0, [1.0, -1.0, 1.0]), (1, [1.0, 1.0, -1.0]), (2, [-1.0, 1.0, -1.0]), (4, [-1.0, -1.0, -1.0]), (5, [-1.0, 0.0, -1.0])]
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["iou"] for r in registry.QUERIES["q_mask_iou"](spark, str(tmp_path)).collect()}
    assert got == {0: pytest.approx(1 / 3), 1: 0.5, 4: 1.0}
