import random
import re
from collections import Counter

from llm_helpers import collected, oracle, rows_of

from lodestrata.llm import rule_cascade as rc
from lodestrata.llm._common import sampled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def metrics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    again = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def keeps(text):
    n, chars, symbols, dup, repeat = metrics(text)
    t = text or ""
    if n < 50 or 100 * repeat > 50 * n:
        return True, False
    bad = chars > 20 * n or chars < 2 * n or 10 * symbols > n or (dup > 2 and 10 * dup > 3 * (t.count("\n") + 1)) or 100 * repeat > 30 * n
    bad = bad or 2 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > chars or 10 * t.count("!") > 3 * n
    w = WORD.findall(t)
    bad = bad or 20 * len(set(w)) < n or any(len(set(w[i : i + 10])) == 1 for i in range(n - 9))
    return False, not bad


def check(df):
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rc.judge(df).collect())
    assert got == sorted((str(i), *metrics(t), *keeps(t)) for i, t in rows_of(df))


def test_random_texts(spark):
    rng = random.Random(2)
    parts = ["a", "b", "c", "dd", "EE!", "#x", "|", "é", "\n", "\n\n", "\t", "\x0b"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))) for i in range(250)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_hostile(hostile, empty):
    check(hostile)
    assert rc.judge(empty).count() == 0


def test_very_long_text_with_repeats(spark):
    """Windows are told apart by whole hashes, also among very many of them."""
    rng = random.Random(4)
    words = [f"{rng.randrange(40000)}" for _ in range(150_000)]
    words[70_000:70_050] = words[10:60]
    words[90_000:90_012] = ["run"] * 12
    check(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:60_000])), (3, "a b " * 30_000)], "doc_id long, text string"))


def test_order_changes_no_verdict(spark, sf):
    docs = rc.base_metrics(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = lambda rules: docs.where(rc.cascade(list(rules)).isNull()).count()
    assert kept(rc.RULES) == kept(rc.RULES[::-1])
    measured = rc.measure(docs)
    assert {m.rule for m in measured} == set(rc.RULES) and all(0 <= m.rejected <= 1 and m.cost >= 0 for m in measured)
    ordered = rc.order_rules(measured)
    assert [m.rank for r in ordered for m in measured if m.rule == r] == sorted((m.rank for m in measured), reverse=True)


def test_costly_rules_cost_more_and_are_skipped(spark, sf):
    """A rule that scans costs more than one that compares two numbers, and behind a rule that
    rejects everything no rule runs."""
    docs = rc.base_metrics(spark.read.parquet(f"{sf}/documents.parquet"))
    cheap, dear = rc.measure(docs, (rc.Rule("cheap", "n_words > 60"), rc.Rule("dear", "size(array_distinct(words)) > 40")))
    assert dear.cost > 3 * cheap.cost and rc.order_rules([dear, cheap])[0].name == "cheap"
    never = rc.Rule("never", "cast(raise_error('reached') as boolean)")
    assert docs.where(rc.cascade([rc.Rule("all", "n_words >= 0"), never]).isNull()).count() == 0
    tie = [rc.Measured(rc.Rule(x, "true"), c, 0.5) for x, c in (("b", 1.1e-6), ("a", 1.9e-6), ("c", 0.0))]
    assert [r.name for r in rc.order_rules(tie)] == ["c", "a", "b"]


def test_sample_is_bounded_by_rows(spark):
    """A third of the rows sharing an id, or being one row, changes neither bound nor verdict."""
    rows = [(7, "some words " * 30)] * 300 + [(7, f"other words {i} " * 20) for i in range(300)] + [(i, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sampled(df, 40).count() == 40
    check(df)


def test_native(spark, sf):
    plan = rc.op7_rule_cascade(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_oracle(spark, sf):
    assert collected(rc.op7_rule_cascade(spark, sf)) == oracle(sf, rc.OP7_SQL)
