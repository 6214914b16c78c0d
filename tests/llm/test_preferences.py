"""Preference formatting against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from weftwise.llm.preferences import conversations_of, format_preferences, masks, pair_neighbours

TURNS = "conv_id long, turn long, role string, text string, prompt string"


def render(turns):
    return "".join(f"<|{r.replace('<|', '< |')}|>\n{t.replace('<|', '< |')}<|end|>\n" for r, t in turns)


def mask(turns):
    out = []
    for r, t in turns:
        out += [f"{len(r.replace('<|', '< |')) + 5}:0", f"{len(t.replace('<|', '< |'))}:{int(r == 'assistant')}", "8:0"]
    return ",".join(out)


def brute(rows):
    convs = {}
    for c, n, r, t, _ in rows:
        if c is not None:
            convs.setdefault(c, []).append((n is not None, n or 0, r or "user", t or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = []
    for p in sorted({c >> 1 for c in convs}):
        a, b = convs.get(2 * p), convs.get(2 * p + 1)
        if a is None:
            a, b = b, None
        n = next((i for i, (x, y) in enumerate(zip(a, b or [], strict=False)) if x != y), min(len(a), len(b or [])))
        rest_a, rest_b = a[n:], (b or [])[n:]
        ok = b is not None and any(r == "assistant" for r, _ in rest_a) and any(r == "assistant" for r, _ in rest_b)
        out.append((p, n, render(a[:n]), render(rest_a), render(rest_b) if b is not None else None, mask(rest_a), mask(rest_b) if b is not None else None, ok))
    return out


def test_against_plain_python(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(60):
        if c % 7 == 3:
            continue
        shared = int(rng.integers(0, 4)) if c % 2 else 0
        last = [r for r in rows if r[0] == c - 1][:shared]
        rows += [(c, r[1], r[2], r[3], "x") for r in last]
        rows += [(c, n, ["user", "assistant"][n % 2], f"text {rng.integers(3)} <|end|> é", "x") for n in range(len(last), len(last) + int(rng.integers(1, 5)))]
    rows += [(100, 0, "user", None, "x"), (100, 1, None, "q", "x"), (101, 0, "user", "", "x"), (101, 1, "user", "q", "x"), (None, 0, "user", "lost", "x"), (102, None, "system", "s", "x"), (102, 0, "assistant", "a", "x"), (104, 0, "user", "same", "x"), (104, 0, "user", "same", "x")]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = format_preferences(pair_neighbours(df)).select("pair_id", "prefix_turns", "prompt", "chosen", "rejected", masks_of("chosen_segments"), masks_of("rejected_segments"), "usable").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def masks_of(name):
    return masks(F.col(name))


def test_empty(spark):
    assert format_preferences(pair_neighbours(spark.createDataFrame([], TURNS))).count() == 0


def test_any_two_conversations_and_a_long_one(spark):
    """Conversations by themselves can be paired in any way; one has very many turns and one very long text."""
    rows = [(c, n, ["user", "assistant"][n % 2], f"{n}" if n < 4000 or c == 1 else "other", "x") for c in (1, 7) for n in range(5000)] + [(1, 5000, "user", "x" * 3_000_000, "x")]
    convs = conversations_of(spark.createDataFrame(rows, TURNS).repartition(3))
    one, two = (convs.filter(F.col("conv_id") == c).select(F.lit(0).alias("pair_id"), F.col("turns").alias(name)) for c, name in ((1, "chosen"), (7, "rejected")))
    got = format_preferences(one.join(two, "pair_id")).select("prefix_turns", F.length("prompt"), F.length("chosen"), "usable").first()
    texts = [render([(r, t)]) for c, _, r, t, _ in rows if c == 1]
    assert tuple(got) == (4000, len("".join(texts[:4000])), len("".join(texts[4000:])), True)
