import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import stats
from lodestrata.operators import review


def value(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("k", "n", "low", "high"), [(15, 300, 0.0305, 0.0808), (0, 300, 0.0, 0.0126), (0, 0, 0.0, 1.0), (21, 300, 0.0462, 0.1046), (12, 300, 0.0230, 0.0686), (84, 100, 0.7558, 0.8990), (89, 89, 0.9586, 1.0), (111, 197, 0.4936, 0.6308)])
def test_wilson(spark, k, n, low, high):
    got = value(spark, stats.wilson(F.col("k"), F.col("n")), k=k, n=n)
    assert got["low"] == pytest.approx(low, abs=6e-5) and got["high"] == pytest.approx(high, abs=6e-5)


@pytest.mark.parametrize(("k", "n", "limit", "want"), [(30, 300, "0.10", True), (31, 300, "0.10", False), (1, 10, "0.1", True), (0, 0, "0.1", False)])
def test_accepted(spark, k, n, limit, want):
    assert value(spark, stats.accepted(F.col("k"), F.col("n"), limit), k=k, n=n) is want


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (6, 0, 2 / 64), (3, 3, 1.0), (10, 4, 0.17957), (66, 0, 2.7105e-20), (73, 0, 2.1176e-22), (5000, 5000, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert value(spark, stats.mcnemar_p(F.col("b"), F.col("c")), b=b, c=c) == pytest.approx(p, rel=1e-4)


@pytest.mark.parametrize(("a", "p"), [((21, 300, 30, 300), 0.19), ((30, 300, 30, 300), 1.0), ((0, 100, 0, 100), 1.0), ((0, 0, 1, 2), 1.0)])
def test_two_proportions(spark, a, p):
    c = stats.two_proportion_p(*[F.col(x) for x in ("k1", "n1", "k2", "n2")])
    assert value(spark, c, k1=a[0], n1=a[1], k2=a[2], n2=a[3]) == pytest.approx(p, abs=5e-3)


def test_binomial_tail_and_verdict(spark):
    assert value(spark, stats.binomial_tail(F.col("k"), F.col("n"), F.lit(0.5)), k=8, n=10) == pytest.approx(sum(math.comb(10, i) for i in (8, 9, 10)) / 1024)
    verdicts = [value(spark, stats.leak_verdict(F.lit(c), F.lit(d), F.lit(p)), x=1) for c, d, p in ((0.2, 1.0, 0.0), (0.01, 0.1, 0.01), (0.01, 0.1, 0.2), (0.01, -0.1, 0.01))]
    assert verdicts == ["UNINFORMATIVE", "LEAK", "SAFE", "SAFE"]


def test_paired_review(spark):
    """Six images judged in two runs."""
    pairs = [("fix", ["missed"], "ok", []), ("fix", ["bleed"], "ok", []), ("drop", ["wrong"], "fix", ["bleed"]), ("fix", ["bleed"], "fix", ["bleed"]), ("ok", [], "ok", []), ("ok", [], "fix", ["cut"])]
    rows = [(f"f{i}", run, v, c) for i, (v1, c1, v2, c2) in enumerate(pairs) for run, v, c in (("before", v1, c1), ("after", v2, c2))] + [("lonely", "before", "ok", [])]
    d = spark.createDataFrame(rows, "file_name string, run string, verdict string, categories array<string>")
    p = review.paired(d, "before", "after")
    o = review.outcomes(p).first()
    assert (o["n"], o["fixed"], o["still"], o["both_ok"], o["broken"]) == (6, 2, 2, 1, 1)
    t = {r["category"]: (r["before"], r["after"], r["gone"], r["kept"], r["new"]) for r in review.transitions(p).collect()}
    assert t["bleed"] == (2, 2, 1, 1, 1) and t["cut"] == (0, 1, 0, 0, 1)
    s = review.scaled(review.outcomes(p).withColumns({"changed": F.lit(60), "compared": F.lit(1000), "base": F.lit(0.10)})).first()
    assert s["est_fixed"][0] == 20 and s["expected"] == pytest.approx(0.10 - 0.06 / 6)
    assert {r["file_name"] for r in review.disagreements(d).collect()} == {"f0", "f1", "f2", "f5"}


def test_error_rates(spark):
    rows = [("d", "ok")] * 279 + [("d", "fix")] * 21 + [("e", None)]
    r = review.error_rates(spark.createDataFrame(rows, "domain string, verdict string").withColumn("pop", F.lit(11693)), ["domain"], "0.10", "pop").collect()
    assert len(r) == 1 and (r[0]["judged"], r[0]["bad"], r[0]["accepted"]) == (300, 21, True)
    assert r[0]["estimates"][0] == round(0.07 * 11693)
    assert r[0]["fix_rate"] == pytest.approx(0.07)
