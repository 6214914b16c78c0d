"""Quality rules as a short-circuit cascade, all in DataFrame expressions.

Every rule is cheap or dear and rejects few or many. Both are estimated on a sample of rows (``SAMPLE_ROWS``, whole
texts): a rule's cost is the work that it does for a text, counted in steps (characters that an expression scans,
times what a character takes there; windows that are hashed and sorted), its selectivity the rows that it rejects.
One job gives both, as numbers; no text reaches the driver. Steps are counted, not timed, so a table gives the same order
in every run, on any machine. Rules are ordered greedily: next comes the rule that rejects most, for each step, of the
sample's rows that still are there when it is reached. The verdict is one CASE over that order, so a text that an early rule
rejects never pays for later ones (``keep_good``). In ``judge`` the figures are columns of the result, so there they
are computed for every text and only the rules without a column are saved. The order changes the work only: a text is
kept if no rule rejects it, in any order.

Words are runs of anything but ASCII blanks. Nulls and empty texts have no words and are rejected. Repeated rows are
judged alike; very long texts are judged whole; an empty table stays one, with the rules in the order that they are
written in; extra columns pass; an added name that is taken gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import free_name

#: Rows of the sample that the order is estimated on; it has no part in any verdict.
SAMPLE_ROWS = 200
#: Steps that a character takes where it is compared, where it is copied or folded, and where a pattern is tried at it;
#: and that a window takes to be hashed (five words) and for each comparison when windows are sorted.
COMPARED, COPIED, MATCHED, HASHED, SORTED = 1, 2, 8, 40, 4
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = r"[\x20\x09-\x0D]"
_WINDOW = 5


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK + "+"))


def word_chars(words_: Column) -> Column:
    return F.char_length(F.concat_ws("", words_)).cast("long")


def symbols(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long")


def full_lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(words_: Column) -> Column:
    """A hash of every window of five words."""
    return F.when(
        F.size(words_) >= _WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words_) - _WINDOW), lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(_WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))


def repeated_words(words_: Column) -> Column:
    """Words that stand in windows found at least twice: sort by hash, keep places next to an equal hash, add up their cover."""

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(at, k + 1), x + _WINDOW) - x))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def count(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(by_hash, places), covered))

    return let(windows(words_), count)


@dataclass(frozen=True)
class Rule:
    name: str
    #: From a text, and the figures at hand by name, to whether it is rejected.
    rejects: Callable[[Column, dict[str, Column]], Column]
    #: From a text, its number of words and its lines to the steps that the rule takes once these are at hand.
    steps: Callable[[Column, Column, Column], Column]


def scanned(weight: int) -> Callable[[Column, Column, Column], Column]:
    """Steps of a rule that goes through the whole text."""
    return lambda text, n, lines: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") * weight + 1


def _windowed(text: Column, n: Column, lines: Column) -> Column:
    """Steps of hashing and sorting all windows."""
    found = F.greatest(n - _WINDOW + 1, F.lit(0)).cast("long")
    return found * HASHED + found * F.ceil(F.log2(found + 1)).cast("long") * SORTED + 1


def figures(text: Column, words_: Column, lines: Column) -> dict[str, Column]:
    """The figures as expressions, so that only those that a verdict gets to are computed."""
    return {"n_words": F.size(words_).cast("long"), "word_chars": word_chars(words_), "n_symbols": symbols(text), "lines": lines, "n_dup_lines": duplicate_lines(lines), "n_repeat_words": repeated_words(words_)}


RULES = [
    Rule("few_words", lambda t, f: f["n_words"] < 10, lambda t, n, lines: F.lit(1).cast("long")),
    Rule("repetition", lambda t, f: 100 * f["n_repeat_words"] > 20 * f["n_words"], _windowed),
    Rule("symbols", lambda t, f: 10 * f["n_symbols"] > 3 * f["n_words"], scanned(MATCHED)),
    Rule("shouting", lambda t, f: 10 * (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!"), F.lit("")))) > 5 * f["n_words"], scanned(COMPARED)),
    Rule("duplicate_lines", lambda t, f: 10 * f["n_dup_lines"] > 3 * F.size(f["lines"]), lambda t, n, lines: F.octet_length(F.concat_ws("", lines)).cast("long") * COMPARED + F.size(lines) * HASHED + 1),
    Rule("word_length", lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"]), scanned(COPIED)),
    Rule("few_letters", lambda t, f: 2 * F.char_length(F.regexp_replace(F.coalesce(t, F.lit("")), r"\P{L}+", "")) < f["word_chars"], scanned(MATCHED + COPIED)),
    Rule("endless_word", lambda t, f: F.coalesce(t, F.lit("")).rlike(r"[^\x20\x09-\x0D]{500}"), scanned(MATCHED)),
    Rule("placeholder", lambda t, f: F.lower(F.coalesce(t, F.lit(""))).contains("lorem ipsum"), scanned(COPIED + COMPARED)),
]
BASE = ("few_words", "repetition")


def measured(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> list[tuple[int, ...]]:
    """For each row of a sample of ``docs`` the rules that reject it (as bits) and each rule's steps."""

    def facts(picked: DataFrame) -> list[tuple[int, ...]]:
        split = picked.withColumns({"w": words(F.col("t")), "l": full_lines(F.col("t"))})
        known = figures(F.col("t"), F.col("w"), F.col("l"))
        bits = sum((F.coalesce(r.rejects(F.col("t"), known), F.lit(False)).cast("long") * (1 << k) for k, r in enumerate(rules)), F.lit(0).cast("long"))
        steps = [r.steps(F.col("t"), F.size("w"), F.col("l")).cast("long").alias(f"s{k}") for k, r in enumerate(rules)]
        return [tuple(r) for r in split.select(bits.alias("bits"), *steps).limit(SAMPLE_ROWS).collect()]

    texts = docs.select(F.col(text_col).alias("t"))
    spread = facts(texts.sample(withReplacement=False, fraction=0.02, seed=5))
    return spread if len(spread) == SAMPLE_ROWS else facts(texts)  # small tables: the first rows


def best_order(rows: list[tuple[int, ...]], rules: list[Rule] = RULES) -> list[Rule]:
    """Rules by what each rejects a step among the rows that are left; those that reject nothing more come last, cheapest first."""
    left, order, known = rows, [], list(enumerate(rules))
    while known:

        def worth(rule: tuple[int, Rule]) -> tuple[Fraction, int, int]:
            k = rule[0]
            steps = sum(r[k + 1] for r in left)
            return Fraction(sum(r[0] >> k & 1 for r in left), max(1, steps)), -sum(r[k + 1] for r in rows), -k

        best = max(known, key=worth)
        known.remove(best)
        order.append(best[1])
        left = [r for r in left if not r[0] >> best[0] & 1]
    return order


def plan_order(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> list[Rule]:
    """The order of ``rules`` for ``docs``, from one job over a sample; the same in every run over one table."""
    rows = measured(docs, text_col, rules)
    return best_order(rows, rules) if rows else list(rules)


def cascade(order: list[Rule], text: Column, known: dict[str, Column]) -> Column:
    """The first rule in order that rejects, as its name, else null."""
    verdict: Column | None = None
    for rule in order:
        no = F.coalesce(rule.rejects(text, known), F.lit(False))
        verdict = F.when(no, rule.name) if verdict is None else verdict.when(no, rule.name)
    return verdict.otherwise(F.lit(None).cast("string"))


def rejected_by(order: list[Rule], text: Column) -> Column:
    """``cascade`` over a text; words and lines are split once and the other figures only when needed."""
    split = F.struct(words(text).alias("w"), full_lines(text).alias("l"))
    return let(split, lambda x: cascade(order, text, figures(text, x["w"], x["l"])))


def judge(docs: DataFrame, text_col: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with figures, ``base_failed`` and ``kept`` added."""
    order = order or plan_order(docs, text_col)
    name = {k: free_name(docs, k) for k in ("words", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
    text, known = F.col(text_col), {k: F.col(v) for k, v in name.items()}
    out = docs.withColumns({name["words"]: words(text), name["lines"]: full_lines(text)})
    made = figures(text, known["words"], known["lines"])
    out = out.withColumns({name[k]: made[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    failed = F.lit(False)
    for r in order:
        if r.name in BASE:
            failed = failed | r.rejects(text, known)
    out = out.withColumns({name["base_failed"]: failed, name["kept"]: cascade(order, text, known).isNull()})
    return out.drop(name["words"], name["lines"])


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects; what an earlier rule rejects never pays for later ones."""
    return docs.filter(rejected_by(plan_order(docs, text_col), F.col(text_col)).isNull())
