"""Ranks and quantiles of large groups, without a task that holds one.

A rank is the place in a range plus the rows of the ranges before it; the ranges are few and
their counts are summed first. A group that holds all rows is as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def hash_ranks(rows: DataFrame, by: list[str], order: Column, tie: str, digits: int = 3) -> DataFrame:
    """Add `rank` (from 1) and `total` to rows: the place in the order of a hexadecimal digest within
    each group, and the group's size. The digest's first digits are the ranges."""
    keys = [*by, "__range"]
    cut = rows.withColumn("__order", order).withColumn("__range", F.conv(F.substring("__order", 1, digits), 16, 10).cast("int"))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"), F.sum("n").over(group).alias("total"))
    placed = cut.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("__order", tie)))
    joined = placed.join(starts, _same(keys, [f"__of_{i}" for i in range(len(keys))]))
    return joined.select(*rows.columns, (F.col("__at") + F.col("__before")).alias("rank"), "total")


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], ranges: int = 256) -> DataFrame:
    """(by, one column for each of `at`): exact quantiles with linear interpolation, nulls left out.

    Equal values are one row with a number. Rough quantiles cut each group into ranges; sums over
    these tell which range holds a wanted place, and only those ranges are put in order.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    cuts = v.groupBy(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)]).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [i / ranges for i in range(1, ranges)], F.lit(20 * ranges)).alias("cuts"))
    same = _same(by, [f"__of_{i}" for i in range(len(by))])
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("place")) for name, q in at.items()])
    counted = v.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("k")).join(cuts, same).withColumn("range", F.size(F.filter("cuts", lambda x: x <= F.col("v"))))
    sizes = counted.groupBy(*by, "range").agg(F.sum("k").alias("size"), F.any_value("n").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).withColumn("w", F.explode(wanted))
    held = held.withColumn("place", F.explode(F.array_distinct(F.array(F.floor("w.place"), F.ceil("w.place"))))).where("place >= before and place < before + size")
    places = held.select(*[F.col(c).alias(f"__in_{i}") for i, c in enumerate(by)], F.col("range").alias("__range"), "before", F.col("w.name").alias("name"), (F.col("w.place") - F.floor("w.place")).alias("part"), "place")
    few = places.select(*[f"__in_{i}" for i in range(len(by))], "__range", "before").distinct()
    up_to = Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = counted.select(*by, "range", "v", "k").join(few, _same([*by, "range"], [*[f"__in_{i}" for i in range(len(by))], "__range"])).select(*by, "range", "v", "k", "before").withColumn("end", F.col("before") + F.sum("k").over(up_to))
    found = inside.join(places.drop("before"), _same([*by, "range"], [*[f"__in_{i}" for i in range(len(by))], "__range"]) & (F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("k")))
    lines = found.groupBy(*by, "name").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("part").alias("part"))
    each = lines.select(*by, "name", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at])
