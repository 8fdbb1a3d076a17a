"""All queries of the library by name, and the DuckDB SQL that gives the same rows.

Column names and types match between the two; floating-point results are rounded in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, records, stats
from ..operators import curate, decisions, probe, ranks, replay, review, sampling, split
from ..operators.components import connected_components
from ..session import table
from ..streaming import replay as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 9):
    return F.round(c, digits)


# --- the manifest -----------------------------------------------------------------------------


@query(r"""
WITH d AS (SELECT doc_id, lang AS domain, sha256(text) AS sha256 FROM documents),
lab AS (SELECT doc_id, quality FROM labels),
j AS (
  SELECT d.*, lab.quality, lab.doc_id IS NOT NULL AS labelled,
         min(d.doc_id) OVER (PARTITION BY sha256) AS first_id, count(*) OVER (PARTITION BY sha256) AS copies
  FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
s AS (
  SELECT *, CASE WHEN doc_id <> first_id THEN 'dropped' WHEN NOT labelled THEN 'dropped' ELSE 'usable' END AS status,
         CASE WHEN doc_id <> first_id THEN 'byte-identical copy' WHEN NOT labelled THEN 'no class' ELSE '' END AS reason
  FROM j),
u AS (
  SELECT doc_id, quality::VARCHAR AS class, count(*) OVER (PARTITION BY quality) AS n,
         row_number() OVER (PARTITION BY quality ORDER BY sha256('0/' || quality::VARCHAR || '/' || doc_id::VARCHAR), doc_id) AS r
  FROM s WHERE status = 'usable'),
sp AS (
  SELECT doc_id, CASE WHEN n < 5 THEN 'train_only' WHEN r <= greatest(1, round_even(n * 0.15, 0)::INT) THEN 'test'
                      WHEN r <= greatest(1, round_even(n * 0.15, 0)::INT) + greatest(1, round_even(n * 0.15, 0)::INT) THEN 'val' ELSE 'train' END AS split
  FROM u)
SELECT s.doc_id, s.domain, s.sha256, s.first_id AS specimen, s.copies, s.quality::VARCHAR AS class, s.status, s.reason, coalesce(sp.split, 'none') AS split
FROM s LEFT JOIN sp ON s.doc_id = sp.doc_id
""")
def q_manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents: content key, copies, label, status with reason, and split.

    The group of equal bytes is one aggregation joined back, so a text that a third of all rows
    repeat is one row of it, and no window gathers its copies.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"), F.sha2("text", 256).alias("sha256"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    same = d.groupBy(F.col("sha256").alias("s")).agg(F.min("doc_id").alias("specimen"), F.count("*").alias("copies"))
    j = d.join(same, F.col("sha256") == F.col("s")).join(lab, F.col("doc_id") == F.col("l_id"), "left")
    copy, unlabelled = F.col("doc_id") != F.col("specimen"), F.col("l_id").isNull()
    j = j.withColumn("status", F.when(copy | unlabelled, "dropped").otherwise("usable"))
    j = j.withColumn("reason", F.when(copy, "byte-identical copy").when(unlabelled, "no class").otherwise(""))
    usable = j.where("status = 'usable'").select(F.col("doc_id").alias("u_id"), F.col("quality").alias("class"))
    sp = split.split_one_domain(usable, 0, 0.15, 0.15, 5, specimen="u_id").select("u_id", "split")
    out = j.join(sp, F.col("doc_id") == F.col("u_id"), "left")
    return out.select("doc_id", "domain", "sha256", "specimen", "copies", F.col("quality").cast("string").alias("class"), "status", "reason", F.coalesce("split", F.lit("none")).alias("split"))


@query("SELECT sha256, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents) GROUP BY sha256 HAVING count(*) > 1")
def q_exact_dup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("copies > 1")


@query(r"""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY (lang = 'en') DESC, doc_id) = 1 THEN ''
                    ELSE 'byte-identical copy of an image kept under another file name' END AS label_drop
FROM documents
""")
def q_keep_one_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts one stays: a preferred one (here: English), then the least id."""
    rows = decisions.start(table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256")))
    return decisions.keep_one_copy(rows, F.col("lang") == "en", name="doc_id").select("doc_id", "label_drop")


# --- parsing ----------------------------------------------------------------------------------


@query(r"""
SELECT p_partkey, regexp_extract(p_name, '^[^\s(]+') AS genus, coalesce(regexp_extract(regexp_extract(p_name, '^\S+\s+(\S+)', 1), '^[a-z]+$'), '') AS epithet,
       CASE WHEN regexp_matches(p_name, '^\S+\s+[a-z]+(\s|$)') AND regexp_extract(p_name, '^\S+\s+([a-z]+)', 1) NOT IN ('sp', 'spp', 'cf', 'aff')
            THEN regexp_extract(p_name, '^(\S+)', 1) || ' ' || regexp_extract(p_name, '^\S+\s+([a-z]+)', 1) ELSE '' END AS binomial
FROM part
""")
def q_genus_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    b = parse.binomial_of(F.col("p_name"))
    return p.select("p_partkey", parse.genus_of(F.col("p_name")).alias("genus"), F.regexp_extract(b, r" (.*)$", 1).alias("epithet"), b.alias("binomial"))


_NAMES = r"""(SELECT c_custkey, 'photo/Genus_species_NMW' || (10000 + c_custkey) ||
   CASE c_custkey % 5 WHEN 0 THEN '-' || ((10000 + c_custkey + 3) % 100) WHEN 1 THEN ',' || (10000 + c_custkey + 7) WHEN 2 THEN '-' || (10000 + c_custkey - 1)
        WHEN 3 THEN '_lateral' ELSE '-' || (20000 + c_custkey) END || '.jpg' AS name, c_custkey % 5 AS kind FROM customer)"""


def _file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with each kind of tail, made from customer keys."""
    k = F.col("c_custkey")
    tail = (
        F.when(k % 5 == 0, F.concat(F.lit("-"), ((k + 10003) % 100).cast("string")))
        .when(k % 5 == 1, F.concat(F.lit(","), (k + 10007).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("-"), (k + 9999).cast("string")))
        .when(k % 5 == 3, "_lateral")
        .otherwise(F.concat(F.lit("-"), (k + 20000).cast("string")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("photo/Genus_species_NMW"), (k + 10000).cast("string"), tail, F.lit(".jpg")).alias("name"))


@query(rf"""
WITH t AS (SELECT *, 10000 + c_custkey AS a FROM {_NAMES}),
e AS (SELECT *, CASE WHEN kind = 0 THEN a - a % CASE WHEN (a + 3) % 100 < 10 THEN 10 ELSE 100 END + (a + 3) % 100 END AS z FROM t)
SELECT c_custkey,
       CASE WHEN kind = 0 AND z > a AND z <= a + 200 THEN z - a + 1 WHEN kind = 1 THEN 2 ELSE 1 END::INT AS n_numbers,
       a AS first_number,
       CASE WHEN kind = 0 AND z > a AND z <= a + 200 THEN z WHEN kind = 1 THEN a + 7 ELSE a END AS last_number,
       CASE WHEN kind = 0 THEN NOT (z > a AND z <= a + 200) ELSE kind IN (2, 4) END AS odd
FROM e
""")
def q_catalog_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue numbers of file names: short suffixes, lists, and ranges that go nowhere."""
    c = _file_names(spark, sf_dir).withColumn("c", parse.catalog_numbers(F.col("name")))
    return c.select("c_custkey", F.size("c.numbers").alias("n_numbers"), F.array_min("c.numbers").alias("first_number"), F.array_max("c.numbers").alias("last_number"), (F.size("c.odd") > 0).alias("odd"))


@query(rf"""
SELECT c_custkey, 'Genus species' AS species, 'NMW' || (10000 + c_custkey) AS catalog_number, regexp_extract(name, 'NMW\d+(.*)\.jpg$', 1).ltrim('_') AS extra, false AS needs_review, '' AS review_reason, 'photo' AS domain
FROM {_NAMES}
""")
def q_parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _file_names(spark, sf_dir).withColumn("p", parse.parse_name(parse.stem(F.col("name"))))
    return c.select("c_custkey", "p.species", "p.catalog_number", "p.extra", "p.needs_review", "p.review_reason", parse.domain_of(F.col("name")).alias("domain"))


# --- aggregation ------------------------------------------------------------------------------


@query(r"""
SELECT source, lang AS majority FROM (
  SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1
""")
def q_majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent language of a source, ties to the least; counted in two aggregations, so
    that no task holds all values of a group."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("majority"))


_SPLIT = r"""(SELECT doc_id, lang, source, CASE WHEN n < 5 THEN 'train_only' WHEN r <= t THEN 'test' WHEN r <= 2 * t THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, greatest(1, round_even(n * 0.15, 0)::INT) AS t FROM (
    SELECT doc_id, lang, source, count(*) OVER (PARTITION BY source) AS n,
           row_number() OVER (PARTITION BY source ORDER BY sha256('0/' || source || '/' || doc_id::VARCHAR), doc_id) AS r FROM documents)))"""


def _split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return split.split_one_domain(d, 0, 0.15, 0.15, 5, specimen="doc_id", cls="source")


@query(f"SELECT doc_id, source, split FROM {_SPLIT}")
def q_split_single_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_documents(spark, sf_dir).select("doc_id", "source", "split")


@query(rf"""
SELECT lang, source, {", ".join(f"count(*) FILTER (WHERE split = '{s}') AS images_{s}" for s in ("train", "val", "test", "train_only"))},
       {", ".join(f"count(DISTINCT doc_id) FILTER (WHERE split = '{s}') AS specimens_{s}" for s in ("train", "val", "test", "train_only"))}
FROM {_SPLIT} GROUP BY lang, source
""")
def q_balance_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.balance(_split_documents(spark, sf_dir), ["lang", "source"], specimen="doc_id")


@query(r"""
SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice::DOUBLE, 0.75), 6) AS q75
FROM lineitem GROUP BY l_returnflag
""")
def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles with linear interpolation."""
    q = ranks.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.select("l_returnflag", *[_r(F.col(n), 6).alias(n) for n in ("q25", "q50", "q75")])


# --- sheets, joins ----------------------------------------------------------------------------


@query(r"""
SELECT p_partkey, CASE WHEN p_type = 'STANDARD' OR p_type = 'STD' THEN 'ST' ELSE p_type END AS p_type,
       CASE WHEN p_type = 'STANDARD' THEN 'p_type STANDARD -> STD; p_type STD -> ST' WHEN p_type = 'STD' THEN 'p_type STD -> ST' ELSE '' END AS label_change
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'STANDARD' WHEN p_partkey % 3 = 1 THEN 'STD' ELSE 'OTHER' END AS p_type FROM part)
""")
def q_sheet_value_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames in chain: the second row sees what the first made."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "STANDARD").when(F.col("p_partkey") % 3 == 1, "STD").otherwise("OTHER")
    rows = decisions.start(table(spark, sf_dir, "part").select("p_partkey", kind.alias("p_type")))
    sheet = spark.createDataFrame([(1, "p_type", "STANDARD", "STD", "accept"), (2, "p_type", "STD", "ST", "accept"), (3, "p_type", "OTHER", "X", "")], "pos int, column string, from string, to string, decision string")
    return decisions.finish(decisions.value_renames(rows, sheet, ["p_type"])).select("p_partkey", "p_type", "label_change")


@query(r"""
WITH m AS (SELECT * FROM (VALUES ('red', 'ruber'), ('blue', 'caeruleus')) v(a, b))
SELECT p_partkey, CASE WHEN m.b IS NULL THEN p_name ELSE m.b || substr(p_name, length(m.a) + 1) END AS species,
       CASE WHEN m.b IS NULL THEN '' ELSE 'genus ' || m.a || ' -> ' || m.b END AS label_change
FROM part LEFT JOIN m ON regexp_extract(p_name, '^[^\s(]+') = m.a
""")
def q_sheet_genus_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions.start(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("species")))
    sheet = spark.createDataFrame([(1, "red", "rubens", "accept"), (2, "red", "ruber", "accept"), (3, "blue", "caeruleus", "accept"), (4, "green", "x", "")], "pos int, from_genus string, to_genus string, decision string")
    return decisions.finish(decisions.genus_spelling(rows, sheet)).select("p_partkey", "species", "label_change")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0)")
def q_drop_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose bytes are not on a drop list of hashes; a hash may belong to several rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.join(d.where("doc_id % 7 = 0").select("sha256").distinct(), "sha256", "left_anti").select("doc_id", "sha256")


@query(r"""
SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side,
       count(d.doc_id) + count(l.doc_id) AS n, count(*) AS n_keys
FROM (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3) d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY side
""")
def q_missing_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.mismatches(table(spark, sf_dir, "documents").where("doc_id % 10 <> 3"), table(spark, sf_dir, "labels"), "doc_id")


@query(r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'ok' ELSE 'skipped' END AS status,
       CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price
FROM orders
""")
def q_merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base run with the taken records of a patch run."""
    o = table(spark, sf_dir, "orders")
    base = o.select("o_orderkey", F.lit("skipped").alias("status"), F.col("o_totalprice").alias("price"))
    patch = o.where("o_orderkey % 11 = 0").select("o_orderkey", F.lit("ok").alias("status"), (F.col("o_totalprice") * 2).alias("price"))
    return curate.merge_records(base, patch, patch.select("o_orderkey"), key="o_orderkey")


_RECORDS = r"""(SELECT doc_id, 'f' || doc_id AS file_name, CASE WHEN doc_id % 9 = 0 THEN 'skipped' ELSE 'ok' END AS status,
  (doc_id % 100) / 1000.0::DOUBLE AS outside, CASE doc_id % 6 WHEN 0 THEN 'inverse' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'candidate' END AS fallback,
  (doc_id % 37) / 40.0::DOUBLE AS edge, doc_id % 4 = 0 AS border, (doc_id % 997) * 10.0::DOUBLE AS area FROM documents)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one instance, made from document ids."""
    k = F.col("doc_id")
    schema = records.INSTANCE
    values = {
        "outside_box_frac": (k % 100) / 1000.0,
        "bleed_fallback": F.when(k % 6 == 0, "inverse").when(k % 6 == 1, "unresolved").when(k % 6 == 2, "candidate"),
        "edge_uncertain_frac": (k % 37) / 40.0,
        "touches_border": k % 4 == 0,
        "area": (k % 997) * F.lit(10.0),
    }
    inst = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    qa = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in records.QA.fields])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("f"), k.cast("string")).alias("file_name"), F.when(k % 9 == 0, "skipped").otherwise("ok").alias("status"), F.lit("").alias("reason"), F.lit(100).alias("width"), F.lit(100).alias("height"), qa.alias("qa"), F.array(inst).alias("instances")
    )


@query(rf"""
SELECT file_name, CASE WHEN status = 'ok' AND len(why) > 0 THEN 'qa_rule_B: ' || array_to_string(list_sort(why), ',') END AS rule_b,
       area / 10000 > 0.7 AND border AS suspect,
       CASE WHEN fallback IS NULL THEN '' ELSE 'bleed_' || fallback END AS rules
FROM (SELECT *, list_filter([CASE WHEN outside > 0.02 THEN 'outside_box' END, CASE WHEN fallback IN ('inverse', 'unresolved') THEN fallback END, CASE WHEN edge > 0.5 THEN 'edge_uncertain' END], lambda x: x IS NOT NULL) AS why FROM {_RECORDS})
""")
def q_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule B, the coverage rule and the names of the rules that fired, over nested records."""
    r = _records(spark, sf_dir)
    return r.select(
        "file_name",
        records.rule_b(F.col("status"), F.col("instances")).alias("rule_b"),
        records.is_suspect(F.col("width"), F.col("height"), F.col("instances")).alias("suspect"),
        F.array_join(records.rules_fired(F.col("instances"), F.col("qa")), ",").alias("rules"),
    )


@query(rf"""
SELECT file_name, CASE WHEN doc_id % 50 = 0 OR doc_id % 20 = 1 OR (status = 'ok' AND doc_id % 3 <> 0 AND rb) THEN 'dropped' ELSE status END AS status,
       CASE WHEN doc_id % 50 = 0 THEN 'by name' WHEN doc_id % 20 = 1 THEN 'by hash' WHEN status = 'ok' AND doc_id % 3 <> 0 AND rb THEN 'rule' ELSE '' END AS why
FROM (SELECT *, (outside > 0.02 OR fallback IN ('inverse', 'unresolved') OR edge > 0.5) IS TRUE AS rb FROM {_RECORDS})
""")
def q_drop_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name list before hash list before rule B, from which taken images are exempt."""
    r = _records(spark, sf_dir).withColumn("sha256", F.sha2("file_name", 256))
    by_name = r.where("doc_id % 50 = 0").select(F.col("file_name").alias("key"), F.lit("by name").alias("reason"))
    by_sha = r.where("doc_id % 20 = 1").select(F.col("sha256").alias("key"), F.lit("by hash").alias("reason"))
    take = r.where("doc_id % 3 = 0 and doc_id % 50 <> 0 and doc_id % 20 <> 1").select("file_name")
    # exempt from rule B but not named on a list
    drops = curate.drops_by_content(r, by_name, by_sha, r.where("doc_id % 3 = 0").select("file_name"))
    out = curate.apply_drops(r.drop("doc_id", "sha256"), drops, take)
    return out.select("file_name", "status", F.when(F.startswith("reason", F.lit("qa_rule_B")), "rule").otherwise(F.col("reason")).alias("why"))


# --- logs, samples ----------------------------------------------------------------------------


@query(r"""
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'purchase'
""")
def q_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user; a purchase clears the user."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return replay.replay(log, ["user_id"], ["ts", "event_id"], "event_type = 'purchase'").select("user_id", "event_id", "event_type", _r(F.col("value"), 6).alias("value"))


@query("SELECT (row_number() OVER (ORDER BY sha256('7/' || doc_id::VARCHAR), doc_id) - 1)::INT AS position, doc_id FROM documents QUALIFY position < 100")
def q_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents"), 100, 7, "doc_id")


@query("SELECT (row_number() OVER (ORDER BY sha256('7/' || doc_id::VARCHAR), doc_id) - 1)::INT AS position, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY position < 100")
def q_sample_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents"), 100, 7, "doc_id", exclude=table(spark, sf_dir, "labels"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('3/' || doc_id::VARCHAR), doc_id) <= 25")
def q_stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), 25, 3, ["lang"], "doc_id")


@query(r"""
WITH one AS (SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256('5/' || doc_id::VARCHAR), doc_id) = 1)
SELECT lang, source, doc_id FROM one QUALIFY count(*) OVER (PARTITION BY lang) >= 8 AND row_number() OVER (PARTITION BY lang ORDER BY sha256('5/' || source), source) <= 8
""")
def q_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each of eight sources of every language."""
    return sampling.balanced(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), 8, 5, "lang", "source", "doc_id").select("lang", "source", "doc_id")


@query(r"""
SELECT (row_number() OVER (ORDER BY o, run, file_name) - 1)::BIGINT AS position, run, file_name FROM (
  SELECT run, p_partkey AS file_name, sha256('1/' || run || '/' || p_partkey) AS o FROM part, (VALUES ('A'), ('B')) v(run))
""")
def q_blind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_name"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("run"))
    return sampling.blind_order(pairs, 1)


# --- statistics -------------------------------------------------------------------------------

_VERDICTS = "(SELECT l_linestatus AS domain, CASE l_returnflag WHEN 'A' THEN 'fix' WHEN 'R' THEN 'drop' ELSE 'ok' END AS verdict FROM lineitem)"


def _verdicts(items: DataFrame) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "A", "fix").when(F.col("l_returnflag") == "R", "drop").otherwise("ok")
    return items.select(F.col("l_linestatus").alias("domain"), v.alias("verdict"))


_WILSON = "greatest(0, ({p} + 1.9208 / {n}) / (1 + 3.8416 / {n}) {s} 1.96 / (1 + 3.8416 / {n}) * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})))"


@query(rf"""
SELECT domain, judged, ok, fix, drop, bad, round(p, 9) AS rate, round({_WILSON.format(p="p", n="judged", s="-")}, 9) AS low, round(least(1, {_WILSON.format(p="p", n="judged", s="+")}), 9) AS high,
       round(fix / (ok + fix)::DOUBLE, 9) AS fix_rate, bad <= 0.67::DECIMAL(18, 9) * judged AS accepted
FROM (SELECT *, fix + drop AS bad, (fix + drop) / judged::DOUBLE AS p FROM (
  SELECT domain, count(*) AS judged, count(*) FILTER (WHERE verdict = 'ok') AS ok, count(*) FILTER (WHERE verdict = 'fix') AS fix, count(*) FILTER (WHERE verdict = 'drop') AS drop
  FROM {_VERDICTS} GROUP BY domain))
""")
def q_error_rate_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = review.error_rates(_verdicts(table(spark, sf_dir, "lineitem")), ["domain"], "0.67")
    return g.select("domain", "judged", "ok", "fix", "drop", "bad", *[_r(F.col(c)).alias(c) for c in ("rate", "low", "high", "fix_rate")], "accepted")


@query("SELECT k.range AS bad, n.range AS judged, n.range > 0 AND k.range * 10 <= n.range AS accepted FROM range(0, 40) k, range(0, 400, 10) n")
def q_accepted_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance at 10 % without a division, over a grid of counts."""
    k = spark.range(40).withColumnRenamed("id", "bad").withColumn("judged", F.explode(F.sequence(F.lit(0), F.lit(390), F.lit(10)).cast("array<bigint>")))
    return k.select("bad", "judged", stats.accepted(F.col("bad"), F.col("judged"), "0.10").alias("accepted"))


_PAIRS = r"""(SELECT conv_id, max(bad) FILTER (WHERE role = 'user') AS b, max(bad) FILTER (WHERE role = 'assistant') AS a,
   max(n) FILTER (WHERE role = 'user') AS nb, max(n) FILTER (WHERE role = 'assistant') AS na
   FROM (SELECT conv_id, role, max((length(text) % 3 = 0)::INT) AS bad, sum(length(text)) % 4 AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id HAVING b IS NOT NULL AND a IS NOT NULL)"""


def _conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision for each conversation and role: users play the run before, assistants after."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max((F.length("text") % 3 == 0).cast("int")).alias("bad"), (F.sum(F.length("text")) % 4).alias("n"))
    cats = F.array_compact(F.array(F.when(F.col("n") >= 1, "c1"), F.when(F.col("n") >= 2, "c2"), F.when(F.col("n") == 3, "c3")))
    d = g.select(F.col("conv_id").alias("file_name"), F.col("role").alias("run"), F.when(F.col("bad") == 1, "fix").otherwise("ok").alias("verdict"), cats.alias("categories"))
    return review.paired(d, "user", "assistant")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE b = 1 AND a = 0) AS fixed, count(*) FILTER (WHERE b = 1 AND a = 1) AS still, count(*) FILTER (WHERE b = 0 AND a = 0) AS both_ok, count(*) FILTER (WHERE b = 0 AND a = 1) AS broken FROM {_PAIRS}")
def q_paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.outcomes(_conversation_pairs(spark, sf_dir)).drop("p")


@query(rf"""
SELECT category, count(*) FILTER (WHERE x) AS before, count(*) FILTER (WHERE y) AS after, count(*) FILTER (WHERE x AND NOT y) AS gone, count(*) FILTER (WHERE x AND y) AS kept, count(*) FILTER (WHERE y AND NOT x) AS new
FROM (SELECT 'c' || c AS category, nb >= c AS x, na >= c AS y FROM {_PAIRS}, (VALUES (1), (2), (3)) v(c)) WHERE x OR y GROUP BY category
""")
def q_category_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.transitions(_conversation_pairs(spark, sf_dir))


_PQ = "(SELECT b.range AS b, c.range AS c FROM range(0, 31) b, range(0, 31) c)"


@query(rf"""
SELECT b, c, CASE WHEN b + c = 0 THEN 1 ELSE round(least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS k))), 9) END AS p FROM {_PQ}
""")
def q_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact McNemar over a grid of discordant pairs."""
    g = spark.range(31).withColumnRenamed("id", "b").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(30)).cast("array<bigint>")))
    return g.select("b", "c", _r(stats.mcnemar_p(F.col("b"), F.col("c"))).alias("p"))


@query(rf"""
WITH g AS (SELECT domain, count(*)::DOUBLE AS n, count(*) FILTER (WHERE verdict <> 'ok')::DOUBLE AS k FROM {_VERDICTS} GROUP BY domain),
z AS (SELECT a.domain AS d1, b.domain AS d2, abs(a.k / a.n - b.k / b.n) / sqrt((a.k + b.k) / (a.n + b.n) * (1 - (a.k + b.k) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) AS z FROM g a JOIN g b ON a.domain < b.domain),
simpson AS (SELECT range AS i, CASE WHEN range IN (0, 4000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(4001))
SELECT d1, d2, round(greatest(0, 1 - 2 / sqrt(2 * pi()) * least(z, 12) / 4000 / 3 * sum(w * exp(-pow(least(z, 12) * i / 4000, 2) / 2))), 9) AS p FROM z, simpson GROUP BY d1, d2, z
""")
def q_two_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled z-test of each pair of domains' error rates; the SQL integrates the normal density."""
    g = review.error_rates(_verdicts(table(spark, sf_dir, "lineitem")), ["domain"], "0.10")
    a, b = g.select(F.col("domain").alias("d1"), F.col("bad").alias("k1"), F.col("judged").alias("n1")), g.select(F.col("domain").alias("d2"), F.col("bad").alias("k2"), F.col("judged").alias("n2"))
    return a.join(b, F.col("d1") < F.col("d2")).select("d1", "d2", _r(stats.two_proportion_p(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))).alias("p"))


@query(rf"""
SELECT n, fixed, broken, [round_even(changed * fixed / n, 0), round_even(changed * {_WILSON.format(p="(fixed / n)", n="n", s="-")}, 0), round_even(changed * least(1, {_WILSON.format(p="(fixed / n)", n="n", s="+")}), 0)]::BIGINT[] AS est_fixed,
       round_even(changed * least(1, {_WILSON.format(p="(broken / n)", n="n", s="+")}), 0)::BIGINT AS est_broken_max, round(0.1 - changed / 1000.0 * (fixed - broken) / n, 9) AS expected
FROM (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (WHERE b = 1 AND a = 0))::DOUBLE AS fixed, (count(*) FILTER (WHERE b = 0 AND a = 1))::DOUBLE AS broken, 60.0::DOUBLE AS changed FROM {_PAIRS})
""")
def q_expected_rate_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = review.outcomes(_conversation_pairs(spark, sf_dir)).withColumns({"changed": F.lit(60), "compared": F.lit(1000), "base": F.lit(0.1)})
    s = review.scaled(o)
    return s.select(*[F.col(c).cast("double").alias(c) for c in ("n", "fixed", "broken")], "est_fixed", "est_broken_max", _r(F.col("expected")).alias("expected"))


# --- groups -----------------------------------------------------------------------------------


def _order_parts(items: DataFrame) -> DataFrame:
    return items.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()


@query()
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all orders and the parts they hold. Recursive SQL is too slow on the whole
    table, so there is none; tested against a union-find."""
    return connected_components(_order_parts(table(spark, sf_dir, "lineitem")))


@query(r"""
WITH k AS (SELECT doc_id, sha256(text) AS h, source FROM documents),
g AS (SELECT h, min(lpad(doc_id::VARCHAR, 20, '0')) AS root FROM k GROUP BY h),
n AS (SELECT root, 'S' || lpad(row_number() OVER (ORDER BY root)::VARCHAR, 5, '0') AS specimen FROM g)
SELECT k.doc_id, n.specimen FROM k JOIN g ON k.h = g.h JOIN n ON g.root = n.root
""")
def q_entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items with their id as the key, grouped by equal bytes; ids by least key."""
    key = F.struct(F.lit("D").alias("ns"), F.col("doc_id").alias("num"), F.lit(None).cast("string").alias("id"))
    items = table(spark, sf_dir, "documents").select("doc_id", F.array(key).alias("keys"), F.sha2("text", 256).alias("sha256"))
    return split.entity_groups(items, name="doc_id")


def _document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("specimen"))
    g = d.groupBy("specimen").agg(F.min("source").alias("class"), F.array_sort(F.collect_set("lang")).alias("domains"))
    return g


@query()
def q_split_multi_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas for each language within a source; the greedy pick is beyond SQL."""
    return split.split_classes(_document_groups(spark, sf_dir), ["en", "de", "fr", "es"], 0, 0.15, 0.15, 5).select("specimen", "class", "split", F.size("evaluated").alias("n_evaluated"))


_CELLS = "(SELECT d.lang AS domain, g.class, count(DISTINCT g.specimen) AS n FROM (SELECT sha256(text) AS specimen, min(source) AS class FROM documents WHERE {where} GROUP BY ALL) g JOIN documents d ON sha256(d.text) = g.specimen WHERE {where} GROUP BY ALL HAVING n >= 5)"


@query(f"SELECT domain, class FROM {_CELLS.format(where='true')} EXCEPT SELECT domain, class FROM {_CELLS.format(where='doc_id % 4 <> 0')}")
def q_lost_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(language, source) cells that are evaluated only while the dropped documents are in."""

    def cells(d: DataFrame) -> DataFrame:
        d = d.select("source", "lang", F.sha2("text", 256).alias("specimen"))
        g = d.groupBy("specimen").agg(F.min("source").alias("class"), F.collect_set("lang").alias("domains"))
        return split.evaluated_cells(g, 5)

    d = table(spark, sf_dir, "documents")
    return split.lost_evaluation(cells(d), cells(d.where("doc_id % 4 <> 0")))


# --- conflicts, runs, streams ---------------------------------------------------------------------


def _conflict_sets(parts: DataFrame) -> DataFrame:
    p = parts.select(F.col("p_size").cast("string").alias("catalog_number"), F.regexp_replace("p_name", r"\s+", " ").alias("species"))
    return decisions.conflict_sets(p).select(F.array_join("names", " | ").alias("names"), "n_catalogs", "n_images")


@query(r"""
WITH p AS (SELECT p_size AS catalog_number, regexp_replace(p_name, '\s+', ' ') AS species FROM part),
g AS (SELECT catalog_number, list_sort(list(DISTINCT species)) AS names, count(DISTINCT regexp_extract(species, '^[^\s(]+')) AS genera, count(*) AS n FROM p GROUP BY ALL)
SELECT array_to_string(names, ' | ') AS names, count(*) AS n_catalogs, sum(n)::BIGINT AS n_images FROM g WHERE genera > 1 GROUP BY names
""")
def q_conflict_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers under more than one genus, by their sorted set of names, over all parts."""
    return _conflict_sets(table(spark, sf_dir, "part"))


@query("SELECT DISTINCT source FROM documents GROUP BY source, lang QUALIFY count(*) OVER (PARTITION BY source) = (SELECT count(DISTINCT lang) FROM documents)")
def q_common_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have documents in every language: the n-way intersection."""
    return sampling.common_to_all(table(spark, sf_dir, "documents"), run="lang", key="source").select("source").distinct()


_JUDGED = "(SELECT conv_id AS file_name, role AS run, CASE WHEN max(length(text) % 3) = 0 THEN 'fix' WHEN max(turn) % 5 = 0 THEN 'drop' ELSE 'ok' END AS verdict FROM conversations GROUP BY conv_id, role)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.max(F.length("text") % 3) == 0, "fix").when(F.max("turn") % 5 == 0, "drop").otherwise("ok")
    g = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_name"), F.col("role").alias("run")).agg(v.alias("verdict"))
    return g.withColumn("categories", F.when(F.col("verdict") == "fix", F.array(F.lit("a"), F.lit("b"))).when(F.col("verdict") == "drop", F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")))


@query(f"SELECT file_name, count(*) AS runs FROM {_JUDGED} GROUP BY file_name HAVING count(DISTINCT verdict) > 1")
def q_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.disagreements(_judged(spark, sf_dir)).select("file_name", F.size("runs").cast("long").alias("runs"))


@query(f"SELECT run, count(*) AS items, count(*) AS judged, count(*) FILTER (WHERE verdict = 'ok') AS ok, count(*) FILTER (WHERE verdict = 'fix') AS fix, count(*) FILTER (WHERE verdict = 'drop') AS drop FROM {_JUDGED} GROUP BY run")
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _judged(spark, sf_dir)
    return review.run_summary(d, d.select("run", "file_name"))


@query(f"""
WITH n AS (SELECT run, count(*) AS n FROM {_JUDGED} GROUP BY run),
k AS (SELECT run, unnest(CASE verdict WHEN 'fix' THEN ['a', 'b'] WHEN 'drop' THEN ['b'] ELSE [] END) AS category FROM {_JUDGED})
SELECT k.run, category, count(*) AS k, n.n, round(count(*) / n.n::DOUBLE, 9) AS rate FROM k JOIN n ON k.run = n.run GROUP BY k.run, category, n.n
""")
def q_category_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.category_rates(_judged(spark, sf_dir), ["run"]).select("run", "category", "k", "n", _r(F.col("rate")).alias("rate"))


@query(r"""
SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def q_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: hourly windows by event time, the same code as over a stream."""
    w = stream.tumbling(table(spark, sf_dir, "events"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query(r"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session
""")
def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: sessions of each user, split at gaps of half an hour."""
    return stream.sessions_by_gap(table(spark, sf_dir, "events").select("user_id", "ts")).select("user_id", "session", "first", "last", "n")


@query()
def q_linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a linear model reads the label from an embedding; five stratified folds."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return probe.accuracy(probe.predictions(rows, "label", "embedding", "vec_id", components=32, iterations=20), "label")


@query("SELECT sha256(text) AS specimen, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) AS images FROM documents GROUP BY 1")
def q_images_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("specimen"), "lang")
    return curate.images_per_domain(d, ["en", "de"], domain="lang")


@query("SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT o.o_orderkey FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_select_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders named by a list, here of the orders with a returned line."""
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("name"))
    return curate.select_images(table(spark, sf_dir, "orders").select("o_orderkey"), wanted, key="o_orderkey")


@query("""
SELECT doc_id AS file_name FROM documents d WHERE quality_status = 'ok' AND (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR -doc_id IN (SELECT -doc_id FROM labels WHERE toxic = 1)) AND n_chars > 1000
""".replace("quality_status = 'ok'", "lang <> 'de'"))
def q_reviewable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: `ok` unless German, flagged if long, wanted by id or by overlay."""
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    records = d.select(F.col("doc_id").alias("file_name"), (-F.col("doc_id")).alias("overlay"), F.when(F.col("lang") == "de", "skipped").otherwise("ok").alias("status"), F.when(F.col("n_chars") > 1000, F.array(F.lit("long"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    wanted = known.where("quality = 1").select(F.col("doc_id").alias("name")).unionByName(known.where("toxic = 1").select((-F.col("doc_id")).alias("name")))
    return review.reviewable(records, d.select((-F.col("doc_id")).alias("name")), wanted, flagged_only=True).select("file_name")


from . import pixel_queries  # noqa: E402, F401  (registers its queries)
