"""Quality rules against plain Python, and the cascade's independence of its order."""

import re

import pytest
from pyspark.sql import functions as F

from weftwise.llm.quality import RULES, Rule, best_order, judge, keep_good, measured, plan_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over a lazy dog while seven other animals watch it from afar."


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    marked = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            marked.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w))


TEXTS = [
    None, "", "   \n\t ", "one", PROSE, "é" * 30 + " " + PROSE, f"{PROSE}\n{PROSE}\n\n{PROSE} x", " lead " + PROSE + "\x0b\x0c tail \r\n",
    "a b c d e a b c d e f g h i j k l m n o p", "x " * 40, "| ".join(PROSE.split()), "#### $$$ " + PROSE, "1234 5678 " * 9 + "12 13 14 15 16 17 18 19 20 21 22 23 24 25", "  " + PROSE + "  end",
    "w" * 600 + " " + PROSE, "Lorem ipsum " + PROSE, "😀 " + PROSE, "\n".join(["same line here"] * 3 + [PROSE]), "\n\n\n", "!! ".join(PROSE.upper().split()),
]


def test_figures(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, words int")
    got = {r["doc_id"]: r for r in judge(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert not (r["base_failed"] and r["kept"])
        assert r["words"] == 1
    assert [got[i]["kept"] for i in (4, 5, 7, 16)] == [True] * 4
    assert not any(got[i]["kept"] for i in (0, 1, 2, 3, 9, 10, 12, 14, 15, 19))


def test_order_does_not_change_the_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    first = {r["doc_id"] for r in judge(df, order=list(RULES)).filter("kept").collect()}
    assert first == {r["doc_id"] for r in judge(df, order=RULES[::-1]).filter("kept").collect()}
    assert first == {r["doc_id"] for r in keep_good(df).collect()}


def test_cascade_orders_by_rejections_per_cost(spark):
    df = spark.createDataFrame([("| ".join(PROSE.split()),)] * 20 + [(PROSE,)] * 5, "text string")
    order = [r.name for r in plan_order(df)]
    assert sorted(order) == sorted(r.name for r in RULES)
    assert order[0] == "symbols"


def test_order_is_the_same_in_every_run(spark):
    rows = [(t,) for t in TEXTS for _ in range(40)] + [(PROSE * 300,)] * 5
    df = spark.createDataFrame(rows, "text string").repartition(3).cache()
    df.count()
    assert len({tuple(r.name for r in plan_order(df)) for _ in range(3)}) == 1
    many = spark.range(30_000, numPartitions=4).select(F.concat(F.lit(PROSE), F.col("id").cast("string")).alias("text"))
    first = measured(many)
    assert len(first) == 200 and measured(many) == first


def test_order_follows_the_costs(spark):
    """Rules that reject the same rows come by their steps; a rule made dear goes behind all that reject as much."""
    steps = lambda n: lambda t, words, lines: F.lit(n).cast("long")
    odd = lambda t, f: F.coalesce(t.contains("odd"), F.lit(False))
    rules = [Rule("dear", odd, steps(9_000)), Rule("cheap", odd, steps(3)), Rule("other", lambda t, f: t.contains("other"), steps(500)), Rule("none", lambda t, f: F.lit(False), steps(1))]
    df = spark.createDataFrame([("odd",)] * 10 + [("other",)] * 5 + [("fine",)] * 5 + [(None,)], "text string")
    assert [r.name for r in plan_order(df, rules=rules)] == ["cheap", "other", "none", "dear"]
    rules[1] = Rule("cheap", odd, steps(900_000))
    assert [r.name for r in plan_order(df, rules=rules)] == ["other", "dear", "none", "cheap"]


def test_greedy_by_what_is_left():
    """A rule whose rejections others have taken already counts for nothing, and costs count for the rows still there."""
    rules = [Rule(n, None, None) for n in "abc"]
    rows = [(0b011, 2, 1, 10)] * 4 + [(0b100, 2, 100, 10)] * 3 + [(0, 2, 100, 10)]
    assert [r.name for r in best_order(rows, rules)] == ["a", "c", "b"]
    assert best_order([], rules) == rules or len(best_order([], rules)) == 3


def test_long_texts_count_in_the_sample(spark):
    rows = measured(spark.createDataFrame([("word " * 100_000,), (None,), ("",)], "text string"))
    steps = max(r[1 + [x.name for x in RULES].index("symbols")] for r in rows)
    assert len(rows) == 3 and steps > 500_000 and sum(r[0] & 1 for r in rows) == 2


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, PROSE, True), (None, PROSE, True), (1, PROSE, False), (1, None, None)], "doc_id long, text string, kept boolean")
    got = judge(df).collect()
    assert [r["_kept"] for r in got if r["text"]] == [True] * 3 and [r["kept"] for r in got if r["text"]] == [True, True, False]
    assert sorted(map(str, keep_good(df).collect())) == sorted(str(r) for r in df.collect() if r["text"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert judge(df).count() == 0 and keep_good(df).count() == 0


@pytest.mark.parametrize("n", [30_000])
def test_long_text_is_whole(spark, n):
    text = " ".join(f"w{i}" for i in range(n)) + " w0 w1 w2 w3 w4"
    row = judge(spark.createDataFrame([(text,)], "text string")).select("n_words", "n_repeat_words").first()
    assert tuple(row) == (n + 5, 10)
