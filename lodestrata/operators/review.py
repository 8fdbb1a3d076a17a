"""Statistics of review samples and of paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import accepted, estimates, expected_rate, fix_rate, mcnemar_p, rate, wilson


def error_rates(decisions: DataFrame, by: list[str], limit: str, population: str | None = None, verdict: str = "verdict") -> DataFrame:
    """judged, ok, fix, drop, bad, rate with Wilson interval, fix_rate and acceptance of each group;
    with a population column also the estimates for all of it."""
    counts = [F.count_if(F.col(verdict) == v).alias(v) for v in ("ok", "fix", "drop")]
    more = [F.max(population).alias("population")] if population else []
    g = decisions.where(F.col(verdict).isNotNull()).groupBy(*by).agg(F.count("*").alias("judged"), *counts, *more).withColumn("bad", F.col("fix") + F.col("drop"))
    k, n = F.col("bad"), F.col("judged")
    w = wilson(k, n)
    out = g.select("*", rate(k, n).alias("rate"), w["low"].alias("low"), w["high"].alias("high"), fix_rate(F.col("ok"), F.col("fix")).alias("fix_rate"), accepted(k, n, limit).alias("accepted"))
    return out.withColumn("estimates", estimates(k, n, F.col("population"))) if population else out


def category_rates(decisions: DataFrame, by: list[str], categories: str = "categories") -> DataFrame:
    """(by, category, k, n, rate, low, high): how many judged items carry a category."""
    n = decisions.groupBy(*by).agg(F.count("*").alias("n"))
    k = decisions.withColumn("category", F.explode(F.array_distinct(categories))).groupBy(*by, "category").agg(F.count("*").alias("k"))
    w = wilson(F.col("k"), F.col("n"))
    joined = k.join(n, by) if by else k.crossJoin(F.broadcast(n))
    return joined.select(*by, "category", "k", "n", rate(F.col("k"), F.col("n")).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def run_summary(decisions: DataFrame, items: DataFrame, run: str = "run", categories: str | None = None) -> DataFrame:
    """items, judged and verdict counts of each run; with a categories column also `categories`, a map
    of how many judged items carry each."""
    n = items.groupBy(run).agg(F.count("*").alias("items"))
    d = decisions.groupBy(run).agg(F.count("*").alias("judged"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "fix", "drop")])
    out = n.join(d, run, "left").na.fill(0, ["judged", "ok", "fix", "drop"])
    if categories is None:
        return out
    k = decisions.select(run, F.explode(F.array_distinct(categories)).alias("c")).groupBy(run, "c").agg(F.count("*").alias("k"))
    k = k.groupBy(run).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", "k")))).alias("categories"))
    return out.join(k, run, "left").withColumn("categories", F.coalesce("categories", F.create_map().cast("map<string,bigint>")))


def reviewable(records: DataFrame, overlays: DataFrame, wanted: DataFrame | None = None, flagged_only: bool = False) -> DataFrame:
    """Records (file_name, overlay, status, flags) that can be shown: ok, with an overlay that exists
    (overlays: name), and, where a list of names is given, listed by their own name or the
    overlay's."""
    out = records.where("status = 'ok'").join(overlays.select(F.col("name").alias("overlay")).distinct(), "overlay", "left_semi")
    if wanted is not None:
        name = wanted.select(F.col("name").alias("__w")).distinct()
        out = out.join(name, (F.col("file_name") == F.col("__w")) | (F.col("overlay") == F.col("__w")), "left_semi")
    return out.where(F.size("flags") > 0) if flagged_only else out


def paired(decisions: DataFrame, before: str, after: str, key: str = "file_name", run: str = "run") -> DataFrame:
    """(key, before_bad, after_bad, before_categories, after_categories) of items judged in both
    runs: one aggregation in place of a self-join."""
    one = lambda r, c: F.max(F.when(F.col(run) == r, c))
    bad = F.col("verdict").isin("fix", "drop")
    cats = F.coalesce("categories", F.array().cast("array<string>")) if "categories" in decisions.columns else F.array().cast("array<string>")
    g = decisions.groupBy(key).agg(one(before, bad).alias("before_bad"), one(after, bad).alias("after_bad"), one(before, cats).alias("before_categories"), one(after, cats).alias("after_categories"))
    return g.where("before_bad is not null and after_bad is not null")


def outcomes(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, fixed, still, both_ok, broken, and the exact McNemar p."""
    b, a = F.col("before_bad"), F.col("after_bad")
    g = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(b & ~a).alias("fixed"), F.count_if(b & a).alias("still"), F.count_if(~b & ~a).alias("both_ok"), F.count_if(~b & a).alias("broken"))
    return g.withColumn("p", mcnemar_p(F.col("fixed"), F.col("broken")))


def transitions(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(category, before, after, gone, kept, new) over paired items."""
    by = by or []
    x, y = F.col("before_categories"), F.col("after_categories")
    rows = pairs.select(*by, F.explode(F.array_union(x, y)).alias("category"), x.alias("x"), y.alias("y"))
    inx, iny = F.array_contains("x", F.col("category")), F.array_contains("y", F.col("category"))
    return rows.groupBy(*by, "category").agg(F.count_if(inx).alias("before"), F.count_if(iny).alias("after"), F.count_if(inx & ~iny).alias("gone"), F.count_if(inx & iny).alias("kept"), F.count_if(~inx & iny).alias("new"))


def scaled(stats: DataFrame) -> DataFrame:
    """stats with n, fixed, broken, changed, compared, base: what the pairs mean for all changed
    images, and the rate to expect."""
    n, changed = F.col("n"), F.col("changed")
    fixed, broken = wilson(F.col("fixed"), n), wilson(F.col("broken"), n)
    est = F.array(*[F.bround(v * changed, 0).cast("long") for v in (rate(F.col("fixed"), n), fixed["low"], fixed["high"])])
    return stats.select("*", est.alias("est_fixed"), F.bround(broken["high"] * changed, 0).cast("long").alias("est_broken_max"), expected_rate(F.col("base"), changed, F.col("compared"), F.col("fixed"), F.col("broken"), n).alias("expected"))


def disagreements(decisions: DataFrame, key: str = "file_name") -> DataFrame:
    """Items whose runs differ in verdict or categories, with one entry for each run."""
    d = F.struct("verdict", "categories")
    return decisions.groupBy(key).agg(F.countDistinct(d).alias("kinds"), F.array_sort(F.collect_list(F.struct("run", "verdict", "categories"))).alias("runs")).where("kinds > 1").drop("kinds")


def unreviewed(sample: DataFrame, decisions: DataFrame, key: str = "file_name") -> DataFrame:
    """The sample with its decisions, in sample order; null where nobody judged."""
    return sample.join(decisions, key, "left").orderBy("position")


def export_rows(sample: DataFrame, decisions: DataFrame, hashes: DataFrame, groups: DataFrame | None = None, key: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Decisions by content hash without names, in sample order with missing positions last, and
    the decisions whose file is gone."""
    d = decisions.join(sample.select(key, "position"), key, "left")
    if groups is not None:
        d = d.join(groups, key, "left")
    lost = d.join(hashes, key, "left_anti")
    kept = d.join(hashes.select(key, "sha256"), key).drop(key)
    return kept.orderBy(F.col("position").isNull(), "position", "sha256"), lost
