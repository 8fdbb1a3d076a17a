import random
import re
import zlib

import numpy as np
import pytest
from conftest import sentence
from llm_helpers import rows_of

from lodestrata.llm import quality_pu, toxicity_mil
from lodestrata.llm._common import sampled

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in quality_pu.op2_pu_quality(spark, SF).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r["doc_id"])]
    assert len(got) == 1000 and all(r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([got[i]["predicted"] == q for i, q in labels]) >= 0.95


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in toxicity_mil.op10_mil_toxicity(spark, SF).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r["doc_id"])]
    clean = [got[i]["predicted"] for i, t in labels if not t]
    assert np.mean(clean) <= 0.02 and np.mean([got[i]["predicted"] == t for i, t in labels]) >= 0.93
    located = [r for r in got.values() if r["offences"]]
    assert located and all(o["p"] >= 0.5 and o["start"] < o["end"] for r in located for o in r["offences"])


def test_risk_stays_non_negative_and_separates():
    rng = np.random.default_rng(0)
    n = len(quality_pu.FEATURES)
    good, bad = rng.uniform(0.2, 0.4, (3000, n)), rng.uniform(0.2, 0.4, (2000, n))
    bad[:, 3] += 0.4
    unlabelled = np.vstack([rng.uniform(0.2, 0.4, (2000, n)), bad[:1000]])
    model = quality_pu.fit_nnpu(good, unlabelled, 2 / 3)
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.9
    assert abs(quality_pu.estimate_prior(good, unlabelled) - 2 / 3) < 0.2


def test_prior_needs_no_negative_label(spark):
    """Negative labels change nothing: neither the prior nor a weight."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    with_, without = quality_pu.train(docs, labels), quality_pu.train(docs, labels.where("quality = 1"))
    share = labels.agg({"quality": "avg"}).first()[0]
    assert with_.prior == without.prior and (with_.weights == without.weights).all() and abs(with_.prior - share) < 0.1


def test_quality_scores_by_hand(spark, hostile):
    """Every row's score is the model's on its whole text."""
    model = quality_pu.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality_pu.score(hostile, model).collect())
    want = sorted((str(i), float(model.score(np.array([quality_pu.features((t or "").encode())]))[0])) for i, t in rows_of(hostile))
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_samples_are_bounded_by_rows(spark):
    """A third of the rows being one row, or one id, takes no more than its bound."""
    rows = [(7, "same text")] * 400 + [(7, f"text {i}") for i in range(400)] + [(i, f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sampled(df, 50).collect()
    assert len(got) == 50 and len({(r["doc_id"], r["text"]) for r in got}) == 50
    assert sampled(df.repartition(7), 50).select("key").exceptAll(sampled(df, 50).select("key")).isEmpty()
    assert sampled(df.where("false"), 50).count() == 0 and sampled(df, 5000).count() == 800


def toxic_bags(spark):
    rng = random.Random(1)
    texts, y = [], []
    for i in range(300):
        bag = [sentence(rng, 8) for _ in range(6)]
        if i % 3 == 0:
            bag[rng.randrange(6)] += " " + rng.choice(["blarg", "blargish", "zounk"])
        texts.append(". ".join(bag))
        y.append(int(i % 3 == 0))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")


def test_noisy_or_finds_the_word(spark):
    docs, labels = toxic_bags(spark)
    m = toxicity_mil.train(docs, labels)
    rng = random.Random(2)
    assert m.bag("ka ran. you blarg. fine")[0] > 0.7 and m.bag(sentence(rng, 50))[0] < 0.3
    _, spans = m.bag("all is fine. you zounk. fine again")
    assert [("all is fine. you zounk. fine again")[a:b].strip() for a, b, _ in spans] == ["you zounk."]
    assert m.bag("") == (0.0, [])
    again = toxicity_mil.train(docs.repartition(5), labels)
    assert again.weights.keys() == m.weights.keys() and all(abs(again.weights[w] - x) < 1e-6 for w, x in m.weights.items())
    for one in (labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert toxicity_mil.train(docs, one).bag("you blarg")[0] == 0.0


def test_length_alone_is_no_evidence(spark):
    m = toxicity_mil.train(*toxic_bags(spark))
    rng = random.Random(3)
    assert m.bag(". ".join(sentence(rng, 8) for _ in range(5000)))[0] < 0.3
    assert m.bag(". ".join(["nothing here"] * 3000)) == (0.0, [])


def test_toxicity_by_hand(spark, hostile):
    """Scores and offences are the noisy-or of sentence probabilities over whole texts."""
    m = toxicity_mil.Model({"idiot": 9.0, "idio*": 1.0, "id*": -2.0, "one": 4.0}, -6.0)

    def plain(t):
        p = []
        for s in re.findall(r"[^.!?\n]+[.!?]*", t or ""):
            w = {x.lower() for x in re.findall(r"[^\W\d_]+", s)}
            held = {f for x in w for f in (x, *(x[:k] + "*" for k in (4, 5, 6) if len(x) >= k)) if f in m.weights}
            p.append(1 / (1 + np.exp(-(m.bias + sum(m.weights[f] for f in held)))) if held else 0.0)
        return 1 - np.prod([1 - x for x in p])

    got = {(r["doc_id"], round(r["score"], 9), len(r["offences"])) for r in toxicity_mil.score(hostile, m).collect()}
    assert {(i, s) for i, s, _ in got} == {(i, round(float(plain(t)), 9)) for i, t in rows_of(hostile)}
    assert {n for i, _, n in got if i == 10} == {3}


@pytest.mark.parametrize("op", [quality_pu.classify, toxicity_mil.classify])
def test_hostile(spark, hostile, empty, no_labels, op):
    labels = spark.createDataFrame([(i, 1, int(i == 10)) for i in (1, 2, 3, 4, 6, 10, 11, 12)] + [(None, 1, 1), (3, None, None)], no_labels.schema)
    for known in (labels, no_labels):
        got = op(hostile, known).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows_of(hostile))
        assert all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got)
        same = {r["score"] for r in got if r["doc_id"] in (4, 5)}
        assert len(same) == 1
    assert op(empty, labels).count() == 0


def test_accepted_keeps_columns(hostile):
    out = quality_pu.accepted(hostile, 0.9)
    assert out.schema == hostile.schema and out.count() == hostile.count()
    assert quality_pu.accepted(hostile, 0.1).count() == 0
