"""Instance masks as a table of pixels.

A mask is the rows (image, instance, y, x) of its pixels; boxes are rows (image, instance, x0, y0,
x1, y1, score), sizes (image, h, w) and logits (image, instance, y, x, logit). Every step is a
join, an aggregation or an explode over these, so images of any number spread over the cluster;
connected pieces alone are found image by image, in Arrow batches.

Pixels lie on whole numbers, y down and x right. Distances are between pixel centres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import label_runs
from ..session import stored
from .components import connected_components

#: Fixed values of the segmentation rules.
CENTRE, CENTRE_LOW, EDGE_HIGH = 0.3, 0.25, 0.3
RING, BAND = 0.02, 3.0
STAYS = 0.1

ONE = ["image", "instance"]
PIXEL = ["image", "instance", "y", "x"]


def _n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def areas(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*ONE).agg(_n("area"))


def iou(keys: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(image, instance, iou) for every key: two empty masks are equal."""
    both = a.select(*PIXEL, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*PIXEL, F.lit(0).alias("a"), F.lit(1).alias("b")))
    pixel = both.groupBy(*PIXEL).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    shares = pixel.groupBy(*ONE).agg((F.sum(F.col("a") * F.col("b")) / _n("all")).alias("iou"))
    return keys.select(*ONE).join(shares, ONE, "left").select(*ONE, F.coalesce("iou", F.lit(1.0)).alias("iou"))


def chosen(logits: DataFrame, scores: DataFrame, threshold: float = 0.0, by: str = "score") -> DataFrame:
    """(image, instance, candidate, area): of each prompt's candidates (logits with a candidate
    column; scores: image, instance, candidate, score) the one with the greatest score or area; of
    equal ones the lowest. A pixel counts strictly above the threshold."""
    if by not in ("score", "largest"):
        raise ValueError(f"cannot choose by {by!r}")
    size = logits.groupBy(*ONE, "candidate").agg(F.count_if(F.col("logit") > threshold).alias("area"))
    ranked = size.join(scores, [*ONE, "candidate"]).withColumn("value", F.col("area").cast("double") if by == "largest" else F.col("score"))
    first = F.struct(-F.col("value"), "candidate")
    return ranked.groupBy(*ONE).agg(F.min_by("candidate", first).alias("candidate"), F.min_by("area", first).alias("area"))


def box_cells(boxes: DataFrame, sizes: DataFrame, pad: float = 0.0) -> DataFrame:
    """boxes with top, bottom, left and right (the last two ends exclusive): the cells a box
    touches inside its image, after it grew by a share of its sides."""
    px, py = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    return boxes.join(sizes, "image").withColumns({
        "top": F.greatest(F.lit(0), F.floor(F.col("y0") - py)), "bottom": F.least("h", F.ceil(F.col("y1") + py)),
        "left": F.greatest(F.lit(0), F.floor(F.col("x0") - px)), "right": F.least("w", F.ceil(F.col("x1") + px)),
    })


def box_shares(pixels: DataFrame, boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, instance, area, outside, fill, edge, centre, wrong_region) for every box, by one pass
    over the pixels: the share of the mask outside its box, and the shares of the box, of its
    outline and of its central part that the mask covers. A mask that leaves the middle free and
    runs along the outline is the background."""
    b = box_cells(boxes, sizes)
    high, wide = F.greatest(F.col("bottom") - F.col("top"), F.lit(0)), F.greatest(F.col("right") - F.col("left"), F.lit(0))
    low, far = (1 - CENTRE) / 2, (1 + CENTRE) / 2
    part = lambda side, start: (F.col(start) + F.floor(side * low), F.greatest(F.floor(side * low) + 1, F.floor(side * far)) - F.floor(side * low))
    (cy, ch), (cx, cw) = part(high, "top"), part(wide, "left")
    b = b.select(*ONE, "top", "bottom", "left", "right", high.alias("high"), wide.alias("wide"), cy.alias("cy"), ch.alias("ch"), cx.alias("cx"), cw.alias("cw"))
    joined = b.join(pixels.select(*PIXEL), ONE, "left")
    inside = F.expr("y >= top and y < bottom and x >= left and x < right")
    # a corner counts with its row; a box of one row or column has that twice
    outline = F.expr("case when y = top or y = bottom - 1 then int(y = top) + int(y = bottom - 1) else int(x = left) + int(x = right - 1) end")
    middle = inside & F.expr("y >= cy and y < cy + ch and x >= cx and x < cx + cw")
    n = joined.groupBy(*[c for c in b.columns]).agg(
        F.count("y").alias("area"), F.count_if(inside).alias("inside"), F.sum(F.when(inside, outline).otherwise(0)).alias("on_edge"), F.count_if(middle).alias("in_middle")
    )
    share = lambda a, c: F.when(c > 0, a / c).otherwise(F.lit(0.0))
    cells = F.col("high") * F.col("wide")
    cell_outline = F.when(cells > 0, 2 * F.col("wide") + 2 * F.greatest(F.col("high") - 2, F.lit(0))).otherwise(F.lit(0))
    out = n.select(
        *ONE, "area",
        share(F.col("area") - F.col("inside"), F.col("area")).alias("outside"),
        share(F.col("inside"), cells).alias("fill"),
        share(F.col("on_edge"), cell_outline).alias("edge"),
        share(F.col("in_middle"), F.when(cells > 0, F.least("ch", "high") * F.least("cw", "wide")).otherwise(F.lit(0))).alias("centre"),
    )
    return out.withColumn("wrong_region", (F.col("centre") < CENTRE_LOW) & (F.col("edge") > EDGE_HIGH))


def _overlap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def containments(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image, small, large, by_mask, by_box) for instances of one image that share a pixel: how much
    of the smaller one's mask and box lies in the larger one's; of equal sizes the lower instance
    is the smaller."""
    has = pixels.select(*PIXEL).join(areas(pixels), ONE)
    a, b = has.toDF("image", "small", "y", "x", "area"), has.toDF("image", "large", "y", "x", "area_b")
    smaller = (F.col("area") < F.col("area_b")) | ((F.col("area") == F.col("area_b")) & (F.col("small") < F.col("large")))
    shared = a.join(b, ["image", "y", "x"]).where(smaller).groupBy("image", "small", "large").agg((_n("n") / F.max("area")).alias("by_mask"))
    of = lambda who, end: boxes.select("image", F.col("instance").alias(who), *[F.col(c).alias(f"{c}_{end}") for c in ("x0", "y0", "x1", "y1")])
    boxed = shared.join(of("small", "s"), ["image", "small"]).join(of("large", "l"), ["image", "large"])
    own = (F.col("x1_s") - F.col("x0_s")) * (F.col("y1_s") - F.col("y0_s"))
    in_box = _overlap("x0_s", "x1_s", "x0_l", "x1_l") * _overlap("y0_s", "y1_s", "y0_l", "y1_l")
    return boxed.select("image", "small", "large", "by_mask", F.when(own > 0, in_box / own).otherwise(F.lit(0.0)).alias("by_box"))


def duplicates(pixels: DataFrame, boxes: DataFrame, threshold: float) -> DataFrame:
    """(image, instance, twin): instances that double one that stays. Instances are seen by score,
    area and number; one whose smaller part with an instance that stays reaches the threshold, by
    mask and by box, goes. Those marked `giant` in boxes neither go nor make others go.

    Whether an instance stays hangs on those before it: one fold over an image's instances, each of
    which carries the set of instances that it could double.
    """
    near = containments(pixels, boxes).where((F.col("by_mask") >= threshold) & (F.col("by_box") >= threshold))
    ways = near.select("image", F.col("small").alias("instance"), F.col("large").alias("other")).unionByName(near.select("image", F.col("large").alias("instance"), F.col("small").alias("other")))
    twins = ways.groupBy(*ONE).agg(F.collect_set("other").alias("twins"))
    known = boxes.join(areas(pixels), ONE, "left").join(twins, ONE, "left").where("not giant")
    order = F.struct((-F.col("score")).alias("s"), (-F.coalesce("area", F.lit(0))).alias("a"), "instance", F.coalesce("twins", F.array().cast("array<int>")).alias("twins"))
    line = known.groupBy("image").agg(F.sort_array(F.collect_list(order)).alias("line"))
    seen = F.expr("""aggregate(line, cast(array() as array<struct<instance:int,twin:int>>), (done, i) -> array_append(done, named_struct('instance', i.instance,
        'twin', get(transform(filter(done, d -> d.twin is null and array_contains(i.twins, d.instance)), d -> d.instance), 0))))""")
    return line.select("image", F.explode(seen).alias("d")).select("image", "d.instance", "d.twin").where("twin is not null")


def undisputed(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels, each with one instance: of those that claim it, one whose box holds its centre
    before others, then the higher score, then the lower number. `claims` counts them."""
    held = F.expr("x + 0.5 >= x0 and x + 0.5 <= x1 and y + 0.5 >= y0 and y + 0.5 <= y1")
    rank = F.struct(F.coalesce(held, F.lit(False)).cast("int"), F.coalesce("score", F.lit(0.0)), -F.col("instance"))
    return pixels.select(*PIXEL).join(boxes, ONE, "left").groupBy("image", "y", "x").agg(F.max_by("instance", rank).alias("instance"), _n("claims")).select(*PIXEL, "claims")


def radii(pixels: DataFrame, frac: float) -> DataFrame:
    """(image, instance, r): a share of the root of the area, one pixel at least."""
    return areas(pixels).select(*ONE, F.greatest(F.lit(1), F.bround(F.lit(frac) * F.sqrt("area")).cast("int")).alias("r"))


def around(pixels: DataFrame, reach: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, instance, y, x, d2): pixels outside a mask within its reach r, with the squared
    distance. Only pixels on a mask's rim can be the nearest of it, so only they look around."""
    p = pixels.select(*PIXEL)
    side = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    beside = p.select(*ONE, F.col("y").alias("py"), F.col("x").alias("px"), side.alias("s")).select(*ONE, "py", "px", (F.col("py") + F.col("s.dy")).alias("y"), (F.col("px") + F.col("s.dx")).alias("x"))
    rim = beside.join(p, PIXEL, "left_anti").select(*ONE, "py", "px").distinct()
    rows = rim.join(reach, ONE).withColumn("dy", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("span", F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("dy") * F.col("dy"))).cast("int"))
    seen = rows.withColumn("dx", F.explode(F.sequence(-F.col("span"), F.col("span")))).select(*ONE, (F.col("py") + F.col("dy")).alias("y"), (F.col("px") + F.col("dx")).alias("x"), (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).alias("d2"))
    within = seen.join(sizes, "image").where("y >= 0 and x >= 0 and y < h and x < w").groupBy(*PIXEL).agg(F.min("d2").alias("d2"))
    return within.join(p, PIXEL, "left_anti")


def margins(pixels: DataFrame, sizes: DataFrame, frac: float) -> DataFrame:
    """(image, instance, y, x): the background pixels by which each mask grows. A pixel that several
    reach goes to the nearest, of equally near ones to the lower instance."""
    if frac <= 0:
        return pixels.select(*PIXEL).where("false")
    free = around(pixels, radii(pixels, frac), sizes).join(pixels.select("image", "y", "x"), ["image", "y", "x"], "left_anti")
    return free.groupBy("image", "y", "x").agg(F.min_by("instance", F.struct("d2", "instance")).alias("instance")).select(*PIXEL)


def uncertain(pixels: DataFrame, logits: DataFrame, sizes: DataFrame, threshold: float = 0.0, blocked: DataFrame | None = None) -> DataFrame:
    """(image, instance, uncertain): the share of the ring around each mask whose logits lie at most
    BAND below the cut; 0 where no ring is left."""
    ring = around(pixels, radii(pixels, RING), sizes)
    if blocked is not None:
        ring = ring.join(blocked.select("image", "y", "x").distinct(), ["image", "y", "x"], "left_anti")
    near = F.col("logit").between(threshold - BAND, threshold)
    share = ring.join(logits, PIXEL).groupBy(*ONE).agg(F.avg(near.cast("int")).alias("share"))
    return pixels.select(*ONE).distinct().join(share, ONE, "left").select(*ONE, F.coalesce("share", F.lit(0.0)).alias("uncertain"))


def pieces(pixels: DataFrame, corners: bool = True) -> DataFrame:
    """The pixels with `piece`, the number of their connected piece in reading order from 1; with
    corners, pixels that touch diagonally are connected."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        return rows.assign(piece=label_runs(rows["y"].to_numpy(), rows["x"].to_numpy(), corners).astype(np.int32))

    p = pixels.select(*PIXEL)
    return p.groupBy(*ONE).applyInPandas(find, p.withColumn("piece", F.lit(0)).schema)


def _sized(found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(image, instance, piece, size, border, whole, largest) of pieces."""
    rim = F.lit(False) if sizes is None else F.expr("y = 0 or x = 0 or y = h - 1 or x = w - 1")
    each = (found if sizes is None else found.join(sizes, "image")).groupBy(*ONE, "piece").agg(_n("size"), F.bool_or(rim).alias("border"))
    return each.join(each.groupBy(*ONE).agg(F.sum("size").alias("whole"), F.max("size").alias("largest")), ONE)


def _those(found: DataFrame, keep: DataFrame) -> DataFrame:
    return found.join(keep.select(*ONE, "piece"), [*ONE, "piece"], "left_semi").select(*PIXEL)


def shape(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, instance, area, n_pieces, border)."""
    return _sized(stored(pieces(pixels), "pieces"), sizes).groupBy(*ONE).agg(F.max("whole").alias("area"), _n("n_pieces"), F.bool_or("border").alias("border"))


def drop_small(pixels: DataFrame, frac: float) -> DataFrame:
    """Without the pieces below a share of the mask; the largest always stays."""
    found = stored(pieces(pixels), "pieces")
    return _those(found, _sized(found).where((F.col("size") >= frac * F.col("whole")) | (F.col("size") == F.col("largest"))))


def inner_pieces(pixels: DataFrame, sizes: DataFrame, frac: float) -> DataFrame:
    """Of an inverse mask the largest piece, and others of a share of the whole that keep off the
    border of the image."""
    found = stored(pieces(pixels), "pieces")
    return _those(found, _sized(found, sizes).where((F.col("size") == F.col("largest")) | ((F.col("size") >= frac * F.col("whole")) & ~F.col("border"))))


def _reach(r: Column) -> Column:
    """Offsets (dy, dx) of an ellipse that fills a square of side 2r + 1, row by row."""
    across = lambda dy: F.bround(F.sqrt(r * r - dy * dy)).cast("int")
    return F.flatten(F.transform(F.sequence(-r, r), lambda dy: F.transform(F.sequence(-across(dy), across(dy)), lambda dx: F.struct(dy.alias("dy"), dx.alias("dx")))))


def near_pieces(pixels: DataFrame, frac: float) -> DataFrame:
    """The pieces that the largest one, or any of a tenth of it, reaches over gaps of at most a share
    of the root of the largest one's area, directly or over other pieces.

    Pieces whose pixels lie within reach are linked; what stays is the linked groups that hold a
    piece of a tenth of the largest.
    """
    if frac <= 0:
        return pixels.select(*PIXEL)
    found = stored(pieces(pixels), "pieces")
    size = stored(_sized(found).withColumn("name", F.xxhash64(*ONE, "piece")), "sizes")
    step = size.where("size < whole").select(*ONE, "piece", "name", F.greatest(F.lit(1), F.bround(F.lit(frac) * F.sqrt("largest")).cast("int")).alias("r"))
    named = found.join(step, [*ONE, "piece"])
    spread = named.withColumn("o", F.explode(_reach(F.col("r")))).select(*ONE, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("name").alias("a"))
    links = spread.join(named.select(*PIXEL, F.col("name").alias("b")), PIXEL).where("a <> b").select("a", "b").distinct()
    groups = size.join(connected_components(links), F.col("name") == F.col("vertex"), "left").withColumn("of", F.coalesce("component", "name"))
    seeds = groups.where(F.col("size") >= STAYS * F.col("largest")).select(*ONE, "of").distinct()
    return _those(found, groups.join(seeds, [*ONE, "of"], "left_semi"))


def holes(pixels: DataFrame, sizes: DataFrame, frac: float, blocked: DataFrame | None = None) -> DataFrame:
    """(image, instance, y, x): background that a mask encloses, in pieces (without corners) of at
    most a share of the mask, except for blocked pixels (image, y, x).

    A mask's own rows tell its holes, so no table of the background is made. Masks meet the sizes
    by a merge: a planner that goes by the size of packed files would broadcast pixels.
    """

    def find(rows: pa.Table) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        top, left = max(y.min(), 0), max(x.min(), 0)
        bottom, right = min(y.max() + 1, rows["h"][0].as_py()), min(x.max() + 1, rows["w"][0].as_py())
        # background at the edge of a mask's frame is at the image's border or reaches it outside the frame
        free = np.ones((max(bottom - top, 0), max(right - left, 0)), bool)
        inside = (y >= top) & (y < bottom) & (x >= left) & (x < right)
        free[y[inside] - top, x[inside] - left] = False
        fy, fx = np.nonzero(free)
        piece = label_runs(fy, fx, corners=False)
        small = np.bincount(piece) <= frac * len(rows)
        small[piece[(fy == 0) | (fx == 0) | (fy == free.shape[0] - 1) | (fx == free.shape[1] - 1)]] = False
        held = small[piece]
        shape = pa.schema([rows.schema.field(c) for c in PIXEL])
        columns = [pa.repeat(rows[c][0], int(held.sum())) for c in ONE] + [pa.array(fy[held] + top), pa.array(fx[held] + left)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    p = pixels.select(*PIXEL)
    out = p.join(sizes.select("image", "h", "w").hint("merge"), "image").groupBy(*ONE).applyInArrow(find, p.schema)
    return out if blocked is None else out.join(blocked.select("image", "y", "x").distinct(), ["image", "y", "x"], "left_anti")


def fins(pixels: DataFrame, logits: DataFrame, sizes: DataFrame, threshold: float, most: float) -> DataFrame:
    """(image, instance, state, growth, cut) and, in `added`, the pixels by which each mask grows:
    fainter parts of its own logits that hang together with it. Added pieces at the border of the
    image are cut; a mask that would grow by more than `most` stays as it is (`guarded`)."""
    p = pixels.select(*PIXEL)
    wide = stored(pieces(p.unionByName(logits.where(F.col("logit") > threshold).select(*PIXEL)).distinct().join(p.select(*ONE).distinct(), ONE, "left_semi")), "pieces")
    own = wide.join(p, PIXEL, "left_semi").select(*ONE, "piece").distinct()
    more = stored(pieces(_those(wide, own).join(p, PIXEL, "left_anti")), "pieces")
    sized = _sized(more, sizes)
    n = sized.groupBy(*ONE).agg(F.sum(F.when(~F.col("border"), F.col("size")).otherwise(0)).alias("gain"), F.sum(F.when(F.col("border"), F.col("size")).otherwise(0)).alias("cut"))
    state = areas(p).join(n, ONE, "left").withColumn("growth", F.coalesce("gain", F.lit(0)) / F.col("area"))
    state = state.withColumn("state", F.when(F.col("growth") > most, "guarded").otherwise("extended"))
    kept = _those(more, sized.where(~F.col("border"))).join(state.where("state = 'extended'").select(*ONE), ONE, "left_semi")
    added = kept.groupBy(*ONE).agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("added"))
    return state.join(added, ONE, "left").select(*ONE, "state", "growth", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("added", F.array().cast("array<struct<y:int,x:int>>")).alias("added"))


def fallback(candidates: DataFrame, chosen_: DataFrame, boxes: DataFrame, sizes: DataFrame, outside: float, fill: tuple[float, float], frame: float, edge: float, pad: float = 0.05, speck: float = 0.01) -> DataFrame:
    """(image, instance, source, candidate): what stands in for a chosen candidate (chosen_: image,
    instance, candidate) that spills out of its box by more than `outside`. candidates are pixels
    with a candidate column. First choice is the largest candidate that fits the box, then the
    largest inverse, inside the padded box, of a candidate that covers the frame of the image;
    without either the candidate stays (`unresolved`).

    Every candidate, and every inverse, is an instance of its own here: shares are taken of all at
    once and the choice is one aggregation.
    """
    code = lambda c: (F.col("instance") * 1000 + F.col(c)).cast("int")
    as_own = candidates.select("image", code("candidate").alias("instance"), "y", "x")
    all_ = candidates.select(*ONE, "candidate").distinct().unionByName(chosen_.select(*ONE, "candidate")).distinct()
    own_boxes = all_.join(boxes, ONE).select("image", code("candidate").alias("own"), *[c for c in boxes.columns if c != "image"]).drop("instance").withColumnRenamed("own", "instance")
    good = (F.col("area") > 0) & (F.col("outside") <= outside) & F.col("fill").between(*fill)
    shares = stored(box_shares(as_own, own_boxes, sizes), "shares")
    rim = as_own.join(sizes, "image").groupBy(*ONE, "h", "w").agg(F.sum(F.expr("int(y = 0) + int(y = h - 1) + int(x = 0) + int(x = w - 1)")).alias("n"))
    framed = rim.where(F.col("n") / (2 * F.col("h") + 2 * F.col("w")) >= frame).select(*ONE)
    cells = box_cells(own_boxes.join(framed, ONE, "left_semi"), sizes, pad)
    grid = cells.select(*ONE, F.explode(F.expr("sequence(int(top), int(bottom) - 1)")).alias("y"), "left", "right").withColumn("x", F.explode(F.expr("sequence(int(left), int(right) - 1)")))
    inverse = inner_pieces(grid.join(as_own, PIXEL, "left_anti"), sizes, speck)
    turned = box_shares(inverse, own_boxes.join(framed, ONE, "left_semi"), sizes).where(good & (F.col("edge") <= edge))
    options = shares.where(good).select(*ONE, "area", F.lit(0).alias("way")).unionByName(turned.select(*ONE, "area", F.lit(1).alias("way")))
    best = options.withColumn("candidate", F.col("instance") % 1000).withColumn("instance", F.floor(F.col("instance") / 1000).cast("int")).groupBy(*ONE).agg(F.min(F.struct("way", (-F.col("area")).alias("a"), "candidate")).alias("best"))
    spilt = shares.withColumn("candidate", F.col("instance") % 1000).withColumn("instance", F.floor(F.col("instance") / 1000).cast("int")).select(*ONE, "candidate", (F.col("outside") > outside).alias("spills"))
    out = chosen_.select(*ONE, "candidate").join(spilt, [*ONE, "candidate"], "left").join(best, ONE, "left")
    spills = F.coalesce("spills", F.lit(False)) if outside > 0 else F.lit(False)
    source = F.when(~spills, "none").when(F.col("best").isNull(), "unresolved").when(F.col("best.way") == 0, "candidate").otherwise("inverse")
    return out.select(*ONE, source.alias("source"), F.when(source.isin("candidate", "inverse"), F.col("best.candidate")).otherwise(F.col("candidate")).alias("candidate"))


def deepest(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, instance, y, x, d2): the pixel of each mask that is farthest from whatever is not in it,
    the border of the image included; of equally deep ones the first in reading order.

    The mask is peeled: round r drops every pixel that has a neighbour outside within r, which a
    join with the outer rim tells; the nearest outside pixel is always on that rim.
    """
    p = pixels.select(*PIXEL)
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    out = p.withColumn("s", step).select(*ONE, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct().join(p, PIXEL, "left_anti")
    rim = out.groupBy(*ONE).agg(F.collect_list(F.struct("y", "x")).alias("rim"))
    d2 = F.array_min(F.transform("rim", lambda o: (o["y"] - F.col("y")) * (o["y"] - F.col("y")) + (o["x"] - F.col("x")) * (o["x"] - F.col("x"))))
    deep = p.join(rim, ONE).select(*PIXEL, d2.alias("d2"))
    return deep.groupBy(*ONE).agg(F.min(F.struct((-F.col("d2")).alias("n"), "y", "x")).alias("m")).select(*ONE, "m.y", "m.x", (-F.col("m.n")).alias("d2"))



def regions(pixels: DataFrame, sizes: DataFrame, frac: float) -> DataFrame:
    """(image, y, x, region) of every pixel of an image that has masks: `fish`, `ring` (within the
    margin), `outer` (from one to two margins of the widest) or `background`."""
    fish = pixels.select("image", "y", "x").distinct()
    ring = margins(pixels, sizes, frac).select("image", "y", "x").distinct()
    twice = radii(pixels, frac).groupBy("image").agg((2 * F.max("r")).alias("r"))
    one = fish.withColumn("instance", F.lit(0))
    outer = around(one, one.select(*ONE).distinct().join(twice, "image"), sizes).select("image", "y", "x")
    grid = fish.select("image").distinct().join(sizes, "image").withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    rank = fish.withColumn("k", F.lit(0)).unionByName(ring.withColumn("k", F.lit(1))).unionByName(outer.withColumn("k", F.lit(2))).groupBy("image", "y", "x").agg(F.min("k").alias("k"))
    name = F.element_at(F.array(*map(F.lit, ("fish", "ring", "outer", "background"))), F.coalesce("k", F.lit(3)) + 1)
    return grid.join(rank, ["image", "y", "x"], "left").select("image", "y", "x", name.alias("region"))
