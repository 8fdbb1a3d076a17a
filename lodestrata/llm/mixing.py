"""Temperature mixing of sources, in DataFrame operations alone.

Source s with token share p_s gets the weight w_s = p_s^a / sum(p^a). The exponent a is the
least multiple of 10^-6 in [0, 1] (the flattest mix) that keeps the largest number of epochs at
or below a repetition limit, or that brings the entropy of the weights down to a target: both
fall as a grows, so each round narrows the interval to one of 64 parts, by one aggregation over
the table of sources. At a = 1 the mix is the corpus as it is.

The weights are realised in whole documents. A source with the token budget b_s = w_s * B runs
through floor(b_s / T_s) whole epochs and a part of one more. In each epoch the source's blocks
(documents by hash; about the root of its number of documents, so that neither a block nor the
table of blocks grows with the source) come in a fresh permutation; the partial epoch takes
whole blocks while they fit and, of the next block, documents in hash order while they fit.
A source with a third of all rows is cut by its blocks and never gathered in one task.

Budget: `tokens`, by default the corpus's own number; or cover=True, the budget at which the
source that is used least is used exactly once, so that no document goes.

Defined results: a null source is a source of its own; rows of one source that share an id are
one unit and are used alike; a null or empty text has no tokens; a source without any token has
no weight: its units are used once under cover=True and otherwise not; an empty table gives no
rows; extra columns are not read, and pass through `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS_CLASS, fresh, rows_of, stored

STEPS = 1_000_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WS_CLASS.replace("[", "[^") + "+")), F.lit(0)).cast("long")


def md5_number(*parts: Column | str) -> Column:
    """The first 32 bits of an MD5 digest, as a number; null parts count as empty strings."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def exponent(sources: DataFrame, limit: float | None, entropy: float | None, tokens: float | None, cover: bool) -> float:
    """The least exponent that keeps the limit or reaches the entropy; 1 if none does."""
    low, high = 0, STEPS
    while low < high:
        step = max(1, (high - low) // 64)
        grid = [low + i * step for i in range((high - low) // step + 1)]
        a = (F.col("k") / F.lit(float(STEPS))).alias("a")
        rows = sources.where("share > 0").select("share", F.explode(F.array(*map(F.lit, grid))).alias("k")).withColumn("a", a)
        found = rows.groupBy("k").agg(
            F.sum(F.pow("share", "a")).alias("z"),
            F.sum(F.pow("share", "a") * F.log("share")).alias("zl"),
            F.max(F.pow("share", F.col("a") - 1)).alias("most"),
            F.min(F.pow("share", F.col("a") - 1)).alias("least"),
            F.max("a").alias("a"),
        )
        if entropy is not None:
            ok = F.log("z") - F.col("a") * F.col("zl") / F.col("z") <= entropy + 1e-12
        elif cover:
            ok = F.col("most") / F.col("least") <= limit + 1e-12
        else:
            ok = F.col("most") / F.col("z") * F.lit(float(tokens)) <= limit + 1e-12
        good = [r["k"] for r in found.where(ok).select("k").collect()]  # at most 65 rows
        if not good:
            if grid[-1] >= high:
                return 1.0
            low = grid[-1] + 1
            continue
        first = min(good)
        if first == low:
            return first / STEPS
        low, high = max(first - step + 1, low), first
    return low / STEPS


def uses(docs: DataFrame, limit: float | None = 2.0, entropy: float | None = None, tokens: int | None = None, cover: bool = False, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(source, doc_id, n_tokens, block, uses), one row per unit: how many times it is used."""
    if (limit is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    unit = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), n_words(text).alias("n"))
    unit = stored(unit.groupBy("source", "doc_id").agg(F.sum("n").alias("n_tokens")), "units")
    sums = unit.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("units"))
    all_tokens = unit.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    table = stored(sums.withColumn("share", F.col("t") / F.lit(float(max(all_tokens, 1)))), "sources")
    wanted = float(tokens) / max(all_tokens, 1) if tokens is not None else 1.0
    a = exponent(table, limit, entropy, wanted, cover)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(a - 1.0)))
    scale = table.agg(F.sum(F.when(F.col("share") > 0, F.pow("share", F.lit(a)))).alias("z"), F.min(power).alias("least")).first()
    whole = power / F.lit(float(scale["least"] or 1.0)) if cover else power / F.lit(float(scale["z"] or 1.0)) * F.lit(wanted)
    epochs = F.coalesce(F.round(whole, 9), F.lit(1.0 if cover else 0.0))
    plan = table.select(
        F.col("source").alias("s"),
        F.floor(epochs).cast("int").alias("full"),
        F.floor(F.round((epochs - F.floor(epochs)) * F.col("t"), 3)).cast("long").alias("rest"),
        F.ceil(F.sqrt(F.col("units").cast("double"))).cast("long").alias("blocks"),
    )
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    dealt = unit.join(plan, same("source", "s")).withColumn("block", md5_number(seed, "doc", F.col("doc_id")) % F.col("blocks")).drop("s", "blocks")
    dealt = stored(dealt, "dealt")
    # (source, block): tokens before a block in the order of the partial epoch
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.max("full").alias("full"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(md5_number(seed, F.col("full"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(order), F.lit(0)))
    state = F.when(F.col("before") + F.col("t") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 2).otherwise(0)
    blocks = stored(blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", state.alias("state")), "blocks")
    # the one block of a source that the budget cuts
    edge = dealt.join(blocks.where("state = 2"), same("source", "s") & (F.col("block") == F.col("b"))).select("source", "doc_id", "n_tokens", "rest", "before")
    up_to = Window.partitionBy("source").orderBy(md5_number(seed, "edge", F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = edge.withColumn("so_far", F.col("before") + F.sum("n_tokens").over(up_to)).where("so_far <= rest").select(F.col("source").alias("ts"), F.col("doc_id").alias("td"), F.lit(1).alias("taken"))
    out = dealt.join(blocks, same("source", "s") & (F.col("block") == F.col("b"))).join(taken, same("source", "ts") & same("doc_id", "td"), "left")
    extra = F.when(F.col("state") == 1, 1).otherwise(F.coalesce("taken", F.lit(0)))
    return out.select("source", "doc_id", "n_tokens", "block", (F.col("full") + extra).cast("int").alias("uses"))


def schedule(used: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per use: source, doc_id, n_tokens, epoch (from 0), block and block_order, the place
    of the block in its epoch's permutation (ties by block)."""
    rows = used.where("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    return rows.select("source", "doc_id", "n_tokens", "epoch", "block", md5_number(seed, F.col("epoch"), F.col("source"), F.col("block")).alias("block_order"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The rows of docs, each as many times as it is used; columns as they are."""
    of, which, times, use = fresh(docs, "of", "which", "times", "use")
    plan = uses(docs, doc_id=doc_id, source=source, **how).where("uses > 0").select(F.col("source").alias(of), F.col("doc_id").alias(which), F.col("uses").alias(times))
    rows = docs.join(plan, docs[source].cast("string").eqNullSafe(F.col(of)) & docs[doc_id].eqNullSafe(F.col(which)))
    return rows.withColumn(use, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


LIMIT = 1.25


def op5_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: as many tokens as they have, no source more than 1.25 times."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return schedule(uses(docs, limit=LIMIT))


OP5_SQL = r"""
WITH unit AS (
  SELECT source, doc_id,
         sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS n_tokens
  FROM documents GROUP BY ALL),
src AS (
  SELECT source, sum(n_tokens) AS t, count(*) AS units,
         sum(n_tokens) / (SELECT sum(n_tokens)::DOUBLE FROM unit) AS share
  FROM unit GROUP BY source),
coarse AS (
  SELECT min(k) AS k FROM (
    SELECT k, max(pow(share, k / 1000 - 1)) / sum(pow(share, k / 1000)) AS most
    FROM src, (SELECT unnest(range(0, 1001))::DOUBLE AS k) GROUP BY k) WHERE most <= 1.25 + 1e-12),
fine AS (
  SELECT coalesce(min(k), 1000000) / 1000000 AS a FROM (
    SELECT g.k, max(pow(share, g.k / 1000000 - 1)) / sum(pow(share, g.k / 1000000)) AS most
    FROM src, (SELECT unnest(range(greatest(0, ((SELECT k FROM coarse) - 1) * 1000)::BIGINT, ((SELECT k FROM coarse) * 1000 + 1)::BIGINT))::DOUBLE AS k) g
    GROUP BY g.k) WHERE most <= 1.25 + 1e-12),
plan AS (
  SELECT source, t, e, floor(e)::INT AS epochs, floor(round((e - floor(e)) * t, 3))::BIGINT AS rest, ceil(sqrt(units))::BIGINT AS blocks
  FROM (SELECT *, round(pow(share, (SELECT a FROM fine) - 1) / (SELECT sum(pow(share, (SELECT a FROM fine))) FROM src), 9) AS e FROM src)),
dealt AS (
  SELECT unit.*, epochs, rest, ('0x' || substr(md5('mix:doc:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block
  FROM unit JOIN plan ON unit.source IS NOT DISTINCT FROM plan.source),
blk AS (
  SELECT *, coalesce(sum(t) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('mix:' || epochs || ':' || coalesce(source, '') || ':' || block), 1, 8))::BIGINT, block
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, block, sum(n_tokens) AS t, max(epochs) AS epochs, max(rest) AS rest FROM dealt GROUP BY source, block)),
edge AS (
  SELECT d.source, d.doc_id, d.rest,
         before + sum(n_tokens) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('mix:edge:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT, d.doc_id
                                      ROWS UNBOUNDED PRECEDING) AS so_far
  FROM dealt d JOIN blk ON d.source IS NOT DISTINCT FROM blk.source AND d.block = blk.block
  WHERE before + t > blk.rest AND before < blk.rest),
used AS (
  SELECT d.source, d.doc_id, d.n_tokens, d.block,
         d.epochs + CASE WHEN before + t <= blk.rest THEN 1 WHEN so_far <= edge.rest THEN 1 ELSE 0 END AS uses
  FROM dealt d JOIN blk ON d.source IS NOT DISTINCT FROM blk.source AND d.block = blk.block
  LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source AND d.doc_id IS NOT DISTINCT FROM edge.doc_id)
SELECT source, doc_id, n_tokens::BIGINT AS n_tokens, epoch::INT AS epoch, block,
       ('0x' || substr(md5('mix:' || epoch || ':' || coalesce(source, '') || ':' || block), 1, 8))::BIGINT AS block_order
FROM (SELECT *, unnest(range(0, uses)) AS epoch FROM used)
"""
