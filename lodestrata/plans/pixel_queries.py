"""Queries over masks: each embedding is read as eight by eight logits, four of them as the
instances of one image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels as px
from ..session import table
from .registry import _r, query

_LOGITS = """logits AS (SELECT vec_id // 4 AS image, (vec_id % 4)::INT AS instance, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, e AS logit
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
px AS (SELECT image, instance, y, x FROM logits WHERE logit > 0.05::FLOAT),
boxes AS (SELECT vec_id // 4 AS image, (vec_id % 4)::INT AS instance, vec_id % 3 + 0.5::DOUBLE AS x0, vec_id % 2 + 0.25::DOUBLE AS y0, vec_id % 3 + 4.5::DOUBLE AS x1, vec_id % 2 + 5.25::DOUBLE AS y1, (vec_id % 7) / 10::DOUBLE AS score FROM embeddings),
area AS (SELECT image, instance, count(*) AS area FROM px GROUP BY ALL)"""


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "logit"))
    return e.select(F.expr("vec_id div 4").alias("image"), (F.col("vec_id") % 4).cast("int").alias("instance"), F.expr("int(at div 8)").alias("y"), (F.col("at") % 8).alias("x"), "logit")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).where(F.col("logit") > F.lit(0.05).cast("float")).select(*px.PIXEL)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    x, y = (F.col("vec_id") % 3).cast("double"), (F.col("vec_id") % 2).cast("double")
    return e.select(F.expr("vec_id div 4").alias("image"), (F.col("vec_id") % 4).cast("int").alias("instance"), (x + 0.5).alias("x0"), (y + 0.25).alias("y0"), (x + 4.5).alias("x1"), (y + 5.25).alias("y1"), ((F.col("vec_id") % 7) / F.lit(10.0)).alias("score"), F.lit(False).alias("giant"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w")).distinct()


@query(r"""
WITH pairs AS (SELECT a.vec_id, unnest(a.embedding) AS p, unnest(b.embedding) AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(coalesce(count(*) FILTER (WHERE p > 0 AND q > 0) / nullif(count(*) FILTER (WHERE p > 0 OR q > 0), 0)::DOUBLE, 1), 9) AS iou FROM pairs GROUP BY vec_id
""")
def q_mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of every vector's mask (components above 0) with its successor's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pixel = e.select("vec_id", F.posexplode("embedding").alias("x", "v")).where("v > 0").select("vec_id", F.lit(0).alias("instance"), F.lit(0).alias("y"), "x")
    a, b = pixel.withColumnRenamed("vec_id", "image"), pixel.withColumn("image", F.col("vec_id") - 1).drop("vec_id")
    keys = e.select((F.col("vec_id") - 1).alias("image"), F.lit(0).alias("instance")).join(e.select(F.col("vec_id").alias("image")), "image", "left_semi")
    kept = lambda rows: rows.join(keys.select("image"), "image", "left_semi")
    return px.iou(keys, kept(a), kept(b)).select(F.col("image").alias("vec_id"), _r(F.col("iou")).alias("iou"))


@query(rf"""
WITH {_LOGITS},
n AS (SELECT image, instance, (vec := NULL) IS NULL AS k FROM boxes WHERE false),
by_score AS (SELECT image, arg_min(instance, -score * 1000 + instance) AS candidate FROM boxes GROUP BY image),
by_area AS (SELECT b.image, arg_min(b.instance, -coalesce(a.area, 0) * 10 + b.instance) AS candidate FROM boxes b LEFT JOIN area a ON a.image = b.image AND a.instance = b.instance GROUP BY b.image)
SELECT 'score' AS rule, s.image, s.candidate, coalesce(a.area, 0) AS area FROM by_score s LEFT JOIN area a ON a.image = s.image AND a.instance = s.candidate
UNION ALL SELECT 'largest', s.image, s.candidate, coalesce(a.area, 0) FROM by_area s LEFT JOIN area a ON a.image = s.image AND a.instance = s.candidate
""".replace("n AS (SELECT image, instance, (vec := NULL) IS NULL AS k FROM boxes WHERE false),\n", ""))
def q_chosen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the four masks of an image, as candidates, the best by score and the largest."""
    own = lambda df: df.withColumn("candidate", F.col("instance")).withColumn("instance", F.lit(0))
    logits, scores = own(_logits(spark, sf_dir).withColumn("logit", F.col("logit") - F.lit(0.05).cast("float"))), own(_boxes(spark, sf_dir)).select("image", "instance", "candidate", "score")
    one = lambda rule: px.chosen(logits, scores, by=rule).select(F.lit(rule).alias("rule"), "image", "candidate", "area")
    return one("score").unionByName(one("largest"))


@query(rf"""
WITH {_LOGITS},
c AS (SELECT *, greatest(0, floor(y0)) AS top, least(8, ceil(y1)) AS bottom, greatest(0, floor(x0)) AS "left", least(8, ceil(x1)) AS "right" FROM boxes),
d AS (SELECT *, bottom - top AS hh, "right" - "left" AS ww, top + floor((bottom - top) * 0.35) AS cy, "left" + floor(("right" - "left") * 0.35) AS cx FROM c),
e AS (SELECT *, greatest(cy + 1, top + floor(hh * 0.65)) AS ey, greatest(cx + 1, "left" + floor(ww * 0.65)) AS ex FROM d),
j AS (SELECT e.*, px.y, px.x, px.y >= top AND px.y < bottom AND px.x >= "left" AND px.x < "right" AS inside FROM e LEFT JOIN px ON px.image = e.image AND px.instance = e.instance),
s AS (SELECT image, instance, count(y) AS area, count(*) FILTER (WHERE inside) AS n, count(*) FILTER (WHERE inside AND (y = top OR y = bottom - 1 OR x = "left" OR x = "right" - 1)) AS edge,
        count(*) FILTER (WHERE inside AND y >= cy AND y < ey AND x >= cx AND x < ex) AS mid, any_value(hh) AS hh, any_value(ww) AS ww, any_value((ey - cy) * (ex - cx)) AS mids FROM j GROUP BY image, instance)
SELECT image, instance, area, round(CASE WHEN area > 0 THEN (area - n) / area::DOUBLE ELSE 0 END, 9) AS outside, round(n / (hh * ww), 9) AS fill, round(edge / (2 * ww + 2 * (hh - 2)), 9) AS edge, round(mid / mids, 9) AS centre,
       mid / mids < 0.25 AND edge / (2 * ww + 2 * (hh - 2)) > 0.3 AS wrong_region FROM s
""")
def q_box_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = px.box_shares(_masks(spark, sf_dir), _boxes(spark, sf_dir), _sizes(spark, sf_dir))
    return s.select("image", "instance", "area", *[_r(F.col(c)).alias(c) for c in ("outside", "fill", "edge", "centre")], "wrong_region")


@query(rf"""
WITH {_LOGITS}
SELECT image, y, x, arg_max(instance, (inside * 2 + score) * 100 - instance) AS instance, count(*) AS claims FROM (
  SELECT px.*, score, (x + 0.5 >= x0 AND x + 0.5 <= x1 AND y + 0.5 >= y0 AND y + 0.5 <= y1)::INT AS inside FROM px JOIN boxes b ON b.image = px.image AND b.instance = px.instance)
GROUP BY image, y, x
""")
def q_undisputed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.undisputed(_masks(spark, sf_dir), _boxes(spark, sf_dir))


_AROUND = """near AS (SELECT p.image, p.instance, g.y, g.x, min((g.y - p.y) * (g.y - p.y) + (g.x - p.x) * (g.x - p.x)) AS d2, any_value(r.r) AS r
  FROM px p JOIN r ON r.image = p.image AND r.instance = p.instance, (SELECT y.range::INT AS y, x.range::INT AS x FROM range(8) y, range(8) x) g GROUP BY ALL)"""


@query(rf"""
WITH {_LOGITS}, r AS (SELECT image, instance, greatest(1, round_even(0.3 * sqrt(area), 0)) AS r FROM area), {_AROUND}
SELECT image, y, x, arg_min(instance, d2 * 10 + instance) AS instance FROM near WHERE d2 <= r * r AND NOT EXISTS (SELECT 1 FROM px WHERE px.image = near.image AND px.y = near.y AND px.x = near.x) GROUP BY image, y, x
""")
def q_grown_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.margins(_masks(spark, sf_dir), _sizes(spark, sf_dir), 0.3)


@query(rf"""
WITH {_LOGITS}, r AS (SELECT image, instance, greatest(1, round_even(0.02 * sqrt(area), 0)) AS r FROM area), {_AROUND},
ring AS (SELECT near.*, logit FROM near JOIN logits USING (image, instance, y, x) WHERE d2 > 0 AND d2 <= r * r)
SELECT a.image, a.instance, round(coalesce(avg((logit BETWEEN 0.05 - 3 AND 0.05)::INT), 0), 9) AS uncertain FROM area a LEFT JOIN ring ON ring.image = a.image AND ring.instance = a.instance GROUP BY a.image, a.instance
""".replace("0.05 - 3 AND 0.05", "-0.1 - 3 AND -0.1"))
def q_uncertain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each mask's ring whose logits lie between 3.1 and 0.1 below zero."""
    u = px.uncertain(_masks(spark, sf_dir), _logits(spark, sf_dir), _sizes(spark, sf_dir), -0.1)
    return u.select("image", "instance", _r(F.col("uncertain")).alias("uncertain"))


_PIECES = """walk AS (SELECT image, instance, y, x, y * 8 + x AS root FROM px
  UNION SELECT p.image, p.instance, p.y, p.x, w.root FROM walk w JOIN px p ON p.image = w.image AND p.instance = w.instance AND abs(p.y - w.y) <= 1 AND abs(p.x - w.x) <= 1),
piece AS (SELECT image, instance, y, x, min(root) AS root FROM walk GROUP BY ALL),
size AS (SELECT image, instance, root, count(*) AS n, bool_or(y = 0 OR x = 0 OR y = 7 OR x = 7) AS border FROM piece GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_LOGITS}, {_PIECES} SELECT image, instance, sum(n)::BIGINT AS area, count(*) AS n_pieces, bool_or(border) AS border FROM size GROUP BY image, instance")
def q_mask_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.shape(_masks(spark, sf_dir), _sizes(spark, sf_dir))


@query(rf"""
WITH RECURSIVE {_LOGITS}, {_PIECES}
SELECT piece.image, piece.instance, y, x FROM piece JOIN (SELECT *, sum(n) OVER w AS whole, max(n) OVER w AS largest FROM size WINDOW w AS (PARTITION BY image, instance)) s
  ON s.image = piece.image AND s.instance = piece.instance AND s.root = piece.root WHERE n >= 0.2 * whole OR n = largest
""")
def q_without_small_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.drop_small(_masks(spark, sf_dir), 0.2)


@query(rf"""
WITH RECURSIVE {_LOGITS}, {_PIECES}
SELECT piece.image, piece.instance, y, x FROM piece JOIN (SELECT *, sum(n) OVER w AS whole, max(n) OVER w AS largest FROM size WINDOW w AS (PARTITION BY image, instance)) s
  ON s.image = piece.image AND s.instance = piece.instance AND s.root = piece.root WHERE n = largest OR (n >= 0.05 * whole AND NOT border)
""")
def q_inner_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.inner_pieces(_masks(spark, sf_dir), _sizes(spark, sf_dir), 0.05)


@query(rf"""
WITH RECURSIVE {_LOGITS},
free AS (SELECT image, instance, y.range::INT AS y, x.range::INT AS x FROM area, range(8) y, range(8) x EXCEPT SELECT image, instance, y, x FROM px),
walk AS (SELECT image, instance, y, x, y * 8 + x AS root FROM free
  UNION SELECT p.image, p.instance, p.y, p.x, w.root FROM walk w JOIN free p ON p.image = w.image AND p.instance = w.instance AND abs(p.y - w.y) + abs(p.x - w.x) = 1),
piece AS (SELECT image, instance, y, x, min(root) AS root FROM walk GROUP BY ALL),
size AS (SELECT image, instance, root, count(*) AS n FROM piece GROUP BY ALL HAVING NOT bool_or(y = 0 OR x = 0 OR y = 7 OR x = 7))
SELECT piece.image, piece.instance, y, x FROM piece JOIN size s ON s.image = piece.image AND s.instance = piece.instance AND s.root = piece.root JOIN area a ON a.image = piece.image AND a.instance = piece.instance WHERE n <= 0.2 * area
""")
def q_small_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.holes(_masks(spark, sf_dir), _sizes(spark, sf_dir), 0.2)


@query(rf"""
WITH {_LOGITS},
shared AS (SELECT a.image, a.instance AS i, b.instance AS j, count(*) AS n FROM px a JOIN px b ON a.image = b.image AND a.y = b.y AND a.x = b.x AND a.instance < b.instance GROUP BY ALL),
k AS (SELECT s.*, CASE WHEN a.area <= b.area THEN i ELSE j END AS small, CASE WHEN a.area <= b.area THEN j ELSE i END AS large, least(a.area, b.area) AS area FROM shared s JOIN area a ON a.image = s.image AND a.instance = i JOIN area b ON b.image = s.image AND b.instance = j)
SELECT k.image, small, large, round(n / area::DOUBLE, 9) AS by_mask,
  round(greatest(0, least(s.x1, l.x1) - greatest(s.x0, l.x0)) * greatest(0, least(s.y1, l.y1) - greatest(s.y0, l.y0)) / ((s.x1 - s.x0) * (s.y1 - s.y0)), 9) AS by_box
FROM k JOIN boxes s ON s.image = k.image AND s.instance = small JOIN boxes l ON l.image = k.image AND l.instance = large
""")
def q_mask_containments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = px.containments(_masks(spark, sf_dir), _boxes(spark, sf_dir))
    return c.select("image", "small", "large", _r(F.col("by_mask")).alias("by_mask"), _r(F.col("by_box")).alias("by_box"))


@query()
def q_duplicate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that double another by 40 %; the fold over instances is tested against a loop."""
    return px.duplicates(_masks(spark, sf_dir), _boxes(spark, sf_dir), 0.4)


@query()
def q_near_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces within reach of the largest; tested against repeated dilation."""
    return px.near_pieces(_masks(spark, sf_dir), 0.1)


@query()
def q_extended_fins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks grown by fainter connected parts; tested against dense arrays."""
    f = px.fins(_masks(spark, sf_dir), _logits(spark, sf_dir), _sizes(spark, sf_dir), 0.0, 0.5)
    return f.select("image", "instance", "state", _r(F.col("growth")).alias("growth"), "cut", F.size("added").alias("added"))


@query(rf"""
WITH {_LOGITS}, g AS (SELECT y.range::INT AS y, x.range::INT AS x FROM range(-1, 9) y, range(-1, 9) x),
out AS (SELECT a.image, a.instance, g.y, g.x FROM area a, g EXCEPT SELECT image, instance, y, x FROM px),
d AS (SELECT p.image, p.instance, p.y, p.x, min((o.y - p.y) * (o.y - p.y) + (o.x - p.x) * (o.x - p.x)) AS d2 FROM px p JOIN out o ON o.image = p.image AND o.instance = p.instance GROUP BY ALL)
SELECT image, instance, y, x, d2 FROM d QUALIFY row_number() OVER (PARTITION BY image, instance ORDER BY d2 DESC, y, x) = 1
""")
def q_deepest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.deepest(_masks(spark, sf_dir), _sizes(spark, sf_dir))
