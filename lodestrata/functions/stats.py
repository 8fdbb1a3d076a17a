"""Statistics of reviews, as Column expressions over counts."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.96
Z95_EXACT = NormalDist().inv_cdf(0.975)


def _d(x: Column) -> Column:
    return x.cast("double")


def rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, _d(k) / _d(n)).otherwise(0.0)


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high): the score interval, (0, 1) without trials."""
    m = F.when(n > 0, _d(n))
    p = _d(k) / m
    zz = z * z
    scale = 1 + zz / m
    centre = (p + zz / (2 * m)) / scale
    half = F.lit(z) / scale * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))
    return F.struct(
        F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)).alias("low"),
        F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0)).alias("high"),
    )


def accepted(bad: Column, judged: Column, limit: str) -> Column:
    """bad / judged <= limit without a division: exact decimals."""
    return (judged > 0) & (bad.cast("decimal(18,0)") <= F.lit(limit).cast("decimal(18,9)") * judged.cast("decimal(18,0)"))


def estimates(k: Column, n: Column, population: Column) -> Column:
    """array(rate, low, high) times the population, half to even."""
    w = wilson(k, n)
    return F.array(*[F.bround(v * _d(population), 0).cast("long") for v in (rate(k, n), w["low"], w["high"])])


def fix_rate(ok: Column, fix: Column) -> Column:
    """Fixes among what was not dropped."""
    return F.when(ok + fix > 0, _d(fix) / _d(ok + fix))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact p of b and c discordant pairs: the binomial tail at one half, term by term
    in logarithms, so that many pairs underflow nothing."""
    n = _d(b + c)
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, F.lit(0.0)).otherwise(acc["term"] + F.log(n - _d(k) + 1) - F.log(F.greatest(_d(k), F.lit(1.0))))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term - n * math.log(2))).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(b, c).cast("long")), start, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def two_proportion_p(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-sided p of the pooled z-test; 1 without trials or without spread. Spark has no erfc,
    so that one function is an Arrow UDF over the few rows of a report."""
    pooled = _d(k1 + k2) / F.when(n1 + n2 > 0, _d(n1 + n2))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.when(n1 > 0, _d(n1)) + 1 / F.when(n2 > 0, _d(n2))))
    z = (rate(k1, n1) - rate(k2, n2)) / F.when(se > 0, se)
    return F.when(z.isNull(), 1.0).otherwise(_erfc(F.coalesce(F.abs(z), F.lit(0.0)) / math.sqrt(2)))


def expected_rate(base: Column, changed: Column, compared: Column, fixed: Column, broken: Column, n: Column) -> Column:
    """The rate after a change of part of the images: base - changed/compared * (fixed-broken)/n."""
    return base - _d(changed) / _d(compared) * (_d(fixed) - _d(broken)) / _d(n)


def paired_wald(b: Column, c: Column, n: Column, z: float = Z95) -> Column:
    """struct(diff, low, high) of a paired difference of proportions (b - c) / n."""
    d = (_d(b) - _d(c)) / _d(n)
    se = F.sqrt(F.greatest(_d(b) + _d(c) - F.pow(_d(b) - _d(c), 2) / _d(n), F.lit(0.0))) / _d(n)
    return F.struct(d.alias("diff"), (d - z * se).alias("low"), (d + z * se).alias("high"))


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of a binomial, in logarithms."""

    def one(k: int, n: int, p: float) -> float:
        if k <= 0:
            return 1.0
        if p <= 0 or p >= 1:
            return float(p >= 1)
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
        return min(1.0, math.fsum(map(math.exp, terms)))

    return pd.Series([one(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


def leak_verdict(control_p: Column, diff: Column, p: Column, alpha: float = 0.05) -> Column:
    """UNINFORMATIVE where the control is no better than chance, LEAK where the difference is
    positive and significant, else SAFE."""
    return F.when(~(control_p < alpha), "UNINFORMATIVE").when((diff > 0) & (p < alpha), "LEAK").otherwise("SAFE")
