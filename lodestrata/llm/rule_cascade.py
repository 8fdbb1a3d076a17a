"""Quality rules as a short-circuit cascade.

Each rule is a native predicate that is true where a document is rejected. On a sample the
operator times every rule (its cost) and counts what it rejects (its selectivity), and orders
the rules by rejection per cost. The verdict is one nested CASE: a document that a rule rejects
never evaluates the rules behind it. The order changes the work, never the verdict.

The base metrics are part of every row's result, so rules over them cost a comparison; rules
over the text or its words scan, split or sort it, and are what the order saves. Costs are the
least of several timings over a sample that is held and read many times over, less what an empty
rule takes, and count in powers of two of a microsecond a row: noise below that changes no
order, and rules of equal rank go by name.

All metrics are DataFrame expressions. Repeated three-word windows are found inside the row:
one sort by hash and position brings equal windows together, and a fold over the sorted
positions counts the words they cover. No window leaves its row, so a very frequent one is no
hot key.

Defined results: a null or empty text has no words (base_failed); repeated rows are judged one
by one, and the sample holds at most `sample_rows` different ones; an empty table gives no rows;
a column beside id and text is not read.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS, WS_CLASS, sampled

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, none of a null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, WS_CLASS + "+"))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_repeat_words(df: DataFrame, words: str, out: str, k: int = 3) -> DataFrame:
    """Add the number of words that lie in a k-word window which the text holds twice or more.

    Each step is a projection of its own: a lambda must read columns, not expressions that it
    would evaluate again for each element.
    """
    n, h, pairs, at = (f"__{out}_{x}" for x in ("n", "h", "pairs", "at"))
    n_windows = F.greatest(F.size(words) - (k - 1), F.lit(0))
    df = df.withColumn(n, n_windows)
    element = lambda a, i: F.get(F.col(a), i.cast("int"))
    df = df.withColumn(h, F.when(F.col(n) > 1, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.xxhash64(*[element(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window; they need no more.
    df = df.withColumn(h, F.when(F.size(F.array_distinct(h)) < F.size(h), F.col(h)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(pairs, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    # positions whose window equals its neighbour's in the sorted order
    df = df.withColumn(at, F.expr(f"""sort_array(filter(transform({pairs}, (x, j) ->
        case when (j > 0 and x.h = get({pairs}, j - 1).h) or (x.h = get({pairs}, j + 1).h) then x.i else -1 end), i -> i >= 0))"""))
    covered = F.expr(f"aggregate({at}, named_struct('n', 0L, 'end', -1), (s, i) -> named_struct('n', s.n + least({k}, i + {k} - 1 - s.end), 'end', i + {k} - 1), s -> s.n)")
    return df.withColumn(out, F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(covered)).drop(n, h, pairs, at)


def base_metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("__words", words_of(F.col("text")))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0))
    df = with_repeat_words(df, "__words", "n_repeat_words")
    df = df.select(
        "doc_id", "text", F.col("__words").alias("words"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(without(t, WS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.monotonically_increasing_id().alias("__row"),
    )
    # A filter on the result must not be pushed into the steps of n_repeat_words, which would repeat
    # them for each element of an array: no filter passes a column that is not deterministic.
    return df.withColumn("n_repeat_words", F.when(F.col("__row") >= 0, F.col("n_repeat_words")).otherwise(F.lit(0).cast("long"))).drop("__row")


@dataclass(frozen=True)
class Rule:
    """`rejects` is SQL over the columns at hand: true where a document goes."""

    name: str
    rejects: str


#: Whole numbers only: a verdict never depends on rounding.
RULES = (
    Rule("mean_word_long", "word_chars > 20 * n_words"),
    Rule("mean_word_short", "word_chars < 2 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * (length(text) - length(replace(text, '\n', '')) + 1)"),
    Rule("repeat_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("shouting", "2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars"),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words"),
    Rule("few_words", "20 * size(array_distinct(words)) < n_words"),
    Rule("word_run", "exists(sequence(0, greatest(n_words - 10, 0)), i -> n_words >= 10 and forall(sequence(1, 9), j -> get(words, int(i)) = get(words, int(i + j))))"),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / 2.0 ** math.ceil(math.log2(max(self.cost * 1e6, 1.0)))


def measure(sample: DataFrame, rules: tuple[Rule, ...] = RULES, times: int = 20, repeats: int = 3) -> list[Measured]:
    """Cost (seconds a row) and selectivity of each rule on a sample of base_metrics (bounded by the
    caller), which is held while the rules are timed. Each timing is one aggregation that reads
    the sample `times` over; the least of `repeats` counts."""
    sample = sample.persist()
    try:
        n = max(sample.count(), 1)
        over = sample.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def timed(rejects: str) -> tuple[float, float]:
            test = over.agg(F.count_if(F.expr(rejects) & (F.col("time") > 0)).alias("x"))
            took, x = [], test.first()["x"]  # compiled once, timed after
            for _ in range(repeats):
                began = time.perf_counter()
                test.first()
                took.append(time.perf_counter() - began)
            return min(took), x / (n * times)

        empty, _ = timed("length(text) < 0")
        out = []
        for r in rules:
            took, rejected = timed(r.rejects)
            out.append(Measured(r, max(took - empty, 0.0) / (n * times), rejected))
        return out
    finally:
        sample.unpersist()


def order_rules(measured: list[Measured]) -> list[Rule]:
    return [m.rule for m in sorted(measured, key=lambda m: (-m.rank, m.rule.name))]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects a row; null if none does. CASE stops
    at the first branch that holds."""
    out = None
    for r in rules:
        c = F.expr(r.rejects)
        out = F.when(c, F.lit(r.name)) if out is None else out.when(c, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Metrics, base_failed, kept and rejected_by (the cascade's rule, `base`, or null).
    `sample_rows` rows at most, by the hash of id and text, set the order of the rules; every row
    is judged."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = order_rules(measure(base_metrics(sampled(own, sample_rows)), rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = base_metrics(docs, doc_id, text).withColumn("base_failed", failed)
    df = df.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return df.withColumn("kept", F.col("rejected_by").isNull()).drop("words")


def op7_rule_cascade(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, judged by RULES in the order that a sample gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM win
  QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, text, words, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words
            OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * (length(text) - length(replace(text, chr(10), '')) + 1))
            OR 100 * n_repeat_words > 30 * n_words
            OR 2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars
            OR 10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words
            OR 20 * len(list_distinct(words)) < n_words
            OR len(list_filter(range(1, n_words - 8), lambda i: len(list_distinct(words[i:i + 9])) = 1)) > 0) AS kept
FROM b
"""
