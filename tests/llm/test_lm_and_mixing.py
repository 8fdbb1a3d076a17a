import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import sentence
from llm_helpers import collected, oracle, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import backoff_lm, mixing


def brute_scores(rows):
    """By dictionaries: each document by the counts of all others, orders 3, 2 and 1."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x in rows]
    count = lambda x: Counter(tuple(x[i : i + k]) for k in (1, 2, 3) for i in range(len(x) - k + 1))
    own = [count(x) for x in ids]
    all_ = Counter()
    for c in own:
        all_.update(c)
    total = sum(map(len, ids))
    out = []
    for (i, _), x, mine in zip(rows, ids, own):
        s = 0.0
        for at in range(len(x)):
            for k in range(min(3, at + 1), -1, -1):
                if not k:
                    s += math.log(1 / total)
                    break
                g = tuple(x[at - k + 1 : at + 1])
                if (n := all_[g] - mine[g]) > 0:
                    s += math.log(n / (all_[g[:-1]] - mine[g[:-1]] if k > 1 else total - len(x)))
                    break
                s += math.log(0.4)
        out.append((str(i), len(x), round(s, 4)))
    return sorted(out)


def lm_rows(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_prob"], 4)) for r in df.collect())


def agree(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


@pytest.mark.parametrize(("block", "part"), [(2_000_000, 1_500_000), (50, 40)])
def test_scores(hostile, empty, block, part):
    got = backoff_lm.score(hostile, block=block, part=part)
    agree(lm_rows(got), brute_scores(rows_of(hostile)))
    assert all((r["mean_log_prob"] is None) == (r["n_tokens"] == 0) for r in got.collect())
    assert backoff_lm.score(empty).count() == 0


def test_documents(spark, sf):
    agree(lm_rows(backoff_lm.op4_stupid_backoff(spark, sf)), brute_scores(rows_of(spark.read.parquet(f"{sf}/documents.parquet"))))


def test_ids_and_texts_that_look_alike(spark):
    """A row is a document by its place, not by a hash of its id and text."""
    rows = [(5, None), (None, "5"), (5, "5 5 6"), (5, "5 5 6"), (5, ""), (6, "6 5 5"), (None, None)]
    agree(lm_rows(backoff_lm.score(spark.createDataFrame(rows, "doc_id long, text string"))), brute_scores(rows))


def test_a_document_that_occurs_twice_scores_apart(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 40) for _ in range(20)]
    got = backoff_lm.score(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")).collect()
    twice = [r["mean_log_prob"] for r in got if r["doc_id"] in (0, 20)]
    assert min(twice) > max(r["mean_log_prob"] for r in got if r["doc_id"] not in (0, 20))


def test_packing_of_numbers():
    a = np.array([0, 1, 255, 256, 2**48 + 5, 2**63], np.uint64)
    assert (backoff_lm.unpack(backoff_lm.pack(a)) == a).all() and len(backoff_lm.unpack(backoff_lm.pack(a[:0]))) == 0


def corpus(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 5}", " ".join(["w"] * (1 + i % 17))) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def shares(df):
    got = df.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("uses")).alias("u")).collect()
    return {r["source"]: (r["t"], r["u"]) for r in got}


def test_repetition_limit(spark):
    s = shares(mixing.uses(corpus(spark), limit=1.25))
    t = sum(a for a, _ in s.values())
    assert max(u / a for a, u in s.values()) <= 1.25 + 1e-9
    assert max(u / a for a, u in s.values()) >= 1.2 and s["big"][1] < s["big"][0]
    assert abs(sum(u for _, u in s.values()) - t) < 0.03 * t  # the budget, but for whole documents


def test_target_entropy(spark):
    s = shares(mixing.uses(corpus(spark), limit=None, entropy=math.log(6) - 0.02))
    u = sum(x for _, x in s.values())
    h = -sum(x / u * math.log(x / u) for _, x in s.values())
    assert abs(h - (math.log(6) - 0.02)) < 0.02


def test_cover_uses_every_document(spark):
    df = corpus(spark)
    used = mixing.uses(df, limit=1.5, cover=True)
    assert used.agg(F.min("uses")).first()[0] >= 1
    s = shares(used)
    assert s["big"][0] == s["big"][1] and max(u / a for a, u in s.values()) <= 1.5 + 1e-9
    out = mixing.mixed(df, limit=1.5, cover=True)
    assert out.columns == df.columns and out.select("doc_id").distinct().count() == 600


def test_permutations_differ_by_epoch(spark):
    used = mixing.uses(corpus(spark), limit=3.0, tokens=12000)
    plan = mixing.schedule(used).where("source = 's1'").select("epoch", "block", "block_order").distinct().collect()
    order = lambda e: [r["block"] for r in sorted(plan, key=lambda r: r["block_order"]) if r["epoch"] == e]
    assert sorted(order(0)) == sorted(order(1)) and order(0) != order(1)


def test_hostile_mixing(hostile, empty):
    out = mixing.mixed(hostile, limit=1.5, cover=True)
    assert out.columns == hostile.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows_of(hostile)}
    assert mixing.uses(hostile, limit=1.5).count() > 0
    assert mixing.mixed(empty, limit=1.5, cover=True).count() == 0 and mixing.uses(empty, limit=1.5).count() == 0
    with pytest.raises(ValueError, match="limit"):
        mixing.uses(hostile, limit=None)


def test_mixing_passes_columns_of_any_name(spark):
    df = corpus(spark).selectExpr("*", "1 as __of", "2 as __use", "3 as __times", "'x' as uses", "4 as block")
    out = mixing.mixed(df, limit=1.5, cover=True)
    assert out.columns == df.columns and out.select("doc_id").distinct().count() == 600
    assert out.where("__of <> 1 or __use <> 2 or __times <> 3 or uses <> 'x' or block <> 4").isEmpty()


def test_mixing_is_native_and_equals_sql(spark, sf):
    df = mixing.op5_temperature_mixing(spark, sf)
    assert collected(df) == oracle(sf, mixing.OP5_SQL)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
