"""From a segmenter's logits to one record for each image, as one plan over tables of pixels.

detections: image, instance, x0, y0, x1, y1, score, giant; candidates: image, instance, candidate,
y, x, logit; ratings: image, instance, candidate, score; sizes: image, h, w. The steps, in their
order: choose a candidate, fall back where it bleeds, drop doubles, give every pixel one owner,
drop far and small pieces, fill holes, extend fins, grow margins, and describe what came out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pixels as px
from ..session import stored


@dataclass(frozen=True)
class Options:
    """Settings of the steps; 0 leaves a step out."""

    threshold: float = 0.0
    rule: str = "score"
    bleed: float = 0.0
    fill: tuple[float, float] = (0.2, 0.95)
    frame: float = 0.8
    edge: float = 0.5
    duplicate: float = 0.8
    near: float = 0.0
    small: float = 0.0
    hole: float = 0.0
    fin_threshold: float | None = None
    fin_growth: float = 0.5
    margin: float = 0.0


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*px.ONE, *[F.col(a).alias(b) for a, b in names.items()])


def masks(detections: DataFrame, candidates: DataFrame, ratings: DataFrame, sizes: DataFrame, how: Options) -> tuple[DataFrame, DataFrame]:
    """(pixels, facts): the final masks and, for each detection, what each step did to it. A detection
    whose mask is empty or a double has no pixels and a reason in `gone`."""
    above = stored(candidates.where(F.col("logit") > how.threshold).select(*px.ONE, "candidate", "y", "x"), "candidates")
    best = stored(px.chosen(candidates, ratings, how.threshold, how.rule), "chosen")
    areas = px.areas(above.withColumn("instance", F.struct("instance", "candidate"))).select("image", "instance.instance", "instance.candidate", "area")
    by_number = areas.groupBy(*px.ONE).agg(F.sort_array(F.collect_list(F.struct("candidate", "area"))).alias("areas"), F.max("area").alias("largest"))
    if how.bleed > 0:
        turned = stored(px.fallback(above, best, detections, sizes, how.bleed, how.fill, how.frame, how.edge), "fallback")
    else:
        turned = best.select(*px.ONE, F.lit("none").alias("source"), "candidate")
    first = above.join(turned.where("source <> 'inverse'").select(*px.ONE, "candidate"), [*px.ONE, "candidate"]).select(*px.PIXEL)
    if how.bleed > 0:
        upside = turned.where("source = 'inverse'")
        cells = px.box_cells(detections.join(upside.select(*px.ONE), px.ONE, "left_semi"), sizes, 0.05)
        grid = cells.select(*px.ONE, F.explode(F.expr("sequence(int(top), int(bottom) - 1)")).alias("y"), "left", "right").withColumn("x", F.explode(F.expr("sequence(int(left), int(right) - 1)"))).select(*px.PIXEL)
        free = grid.join(above.join(upside.select(*px.ONE, "candidate"), [*px.ONE, "candidate"]).select(*px.PIXEL), px.PIXEL, "left_anti")
        first = first.unionByName(px.inner_pieces(free, sizes, 0.01))
    first = stored(first, "masks")
    double = stored(px.duplicates(first, detections, how.duplicate), "doubles")
    stay = stored(px.undisputed(first.join(double, px.ONE, "left_anti"), detections), "owned")
    contested = stay.where("claims > 1").groupBy("image").agg(F.count(F.lit(1)).alias("contested"))
    now = stay.select(*px.PIXEL)
    steps: dict[str, DataFrame] = {}
    if how.near > 0:
        near = stored(px.near_pieces(now, how.near), "near")
        steps["far_px"], now = px.areas(now.join(near, px.PIXEL, "left_anti")), near
    if how.small > 0:
        now = stored(px.drop_small(now, how.small), "small")
    if how.hole > 0:
        added = stored(px.holes(now, sizes, how.hole, blocked=now), "holes")
        steps["hole_px"], now = px.areas(added), now.unionByName(added)
    if how.fin_threshold is not None:
        own = candidates.join(turned.where("source <> 'inverse'").select(*px.ONE, "candidate"), [*px.ONE, "candidate"])
        fin = stored(px.fins(now, own, sizes, how.fin_threshold, how.fin_growth), "fins")
        more = fin.select(*px.ONE, F.explode("added").alias("p")).select(*px.ONE, "p.y", "p.x").join(now.select("image", "y", "x"), ["image", "y", "x"], "left_anti")
        now = stored(px.undisputed(now.unionByName(more.select(*px.PIXEL)), detections).select(*px.PIXEL), "finned")
    if how.margin > 0:
        now = now.unionByName(px.margins(now, sizes, how.margin))
    now = stored(now, "final")
    facts = detections.join(_named(turned, source="fallback", candidate="candidate"), px.ONE, "left").join(by_number, px.ONE, "left").join(_named(double, twin="twin"), px.ONE, "left").join(contested, "image", "left")
    for name, table in steps.items():
        facts = facts.join(_named(table, area=name), px.ONE, "left")
    if how.fin_threshold is not None:
        facts = facts.join(_named(fin, state="fin_state", growth="fin_growth", cut="fin_cut"), px.ONE, "left")
    if how.margin > 0:
        facts = facts.join(_named(px.radii(stay, how.margin), r="margin_px"), px.ONE, "left")
    gone = F.when(F.col("twin").isNotNull(), "duplicate").when(F.col("left").isNull(), "empty")
    return now, facts.join(px.areas(now).withColumnRenamed("area", "left"), px.ONE, "left").withColumn("gone", gone)


def described(pixels: DataFrame, facts: DataFrame, detections: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, status, width, height, n_detections, empty_dropped, duplicates_removed, instances): one
    row an image, its instances largest score first. An image without an instance left is skipped."""
    shape = px.shape(pixels, sizes).select(*px.ONE, "n_pieces", F.col("border").alias("touches_border"))
    shares = px.box_shares(pixels, detections, sizes).select(*px.ONE, "outside", "edge", "centre", "wrong_region")
    frame = pixels.groupBy(*px.ONE).agg(F.array(F.min("x"), F.min("y"), F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1).alias("bbox"))
    rows = facts.where("gone is null").join(shape, px.ONE).join(shares, px.ONE).join(frame, px.ONE)
    extra = [c for c in ("far_px", "hole_px", "fin_state", "fin_growth", "fin_cut", "margin_px") if c in facts.columns]
    one = F.struct((-F.col("score")).alias("order"), "instance", F.array("x0", "y0", "x1", "y1").alias("det_box"), F.col("score").alias("det_score"), F.col("left").alias("area"), "bbox", "candidate", "fallback", "n_pieces", "touches_border", F.col("outside").alias("outside_box_frac"), F.col("edge").alias("box_edge_frac"), F.col("centre").alias("box_center_cover"), "wrong_region", *extra)
    each = rows.groupBy("image").agg(F.sort_array(F.collect_list(one)).alias("instances"))
    n = facts.groupBy("image").agg(F.count(F.lit(1)).alias("n_detections"), F.count_if(F.col("gone") == "empty").alias("empty_dropped"), F.count_if(F.col("gone") == "duplicate").alias("duplicates_removed"), F.coalesce(F.max("contested"), F.lit(0)).alias("contested_px"))
    out = sizes.join(n, "image", "left").join(each, "image", "left")
    status = F.when(F.col("instances").isNotNull(), "ok").otherwise("skipped")
    reason = F.when(F.col("instances").isNotNull(), "").when(F.col("n_detections").isNull(), "no_detection").otherwise("no_mask")
    return out.select("image", status.alias("status"), reason.alias("reason"), F.col("w").alias("width"), F.col("h").alias("height"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_detections", "empty_dropped", "duplicates_removed", "contested_px")], "instances")


def segmented(detections: DataFrame, candidates: DataFrame, ratings: DataFrame, sizes: DataFrame, how: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, pixels) of all images."""
    pixels, facts = masks(detections, candidates, ratings, sizes, how or Options())
    return described(pixels, facts, detections, sizes), pixels
