"""Suffix-array dedup against a brute force that lists every window."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from weftwise.llm.repeats import STEP, remove_repeats
from weftwise.llm.run_index import RunLengthIndex

L = 60


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int(np.sum(gone[:-1] & ~np.append(False, gone[:-1])[: len(t)]))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 8))) for _ in range(n))


def corpus(seed):
    rng = np.random.default_rng(seed)
    passages = [prose(rng, n) for n in (14, 20, 40, 90)]
    rows = []
    for d in range(60):
        t = prose(rng, int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[rng.integers(len(passages))]
            a = int(rng.integers(0, 30))
            t += " " + p[a : len(p) - int(rng.integers(0, 30))] + " " + prose(rng, int(rng.integers(0, 20)))
        rows.append((d, t))
    near = rows[5][1] + prose(rng, 100)
    for d in range(60, 80):
        cut = int(rng.integers(0, len(near)))
        rows.append((d, near[:cut] + "XY" + near[cut + 2 :]))
    rows += [(80, near), (81, near), (82, None), (83, ""), (84, "a" * 500), (85, "ab" * 300), (86, "short"), (None, near), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}, {"hot_spans": 3}])
def test_against_brute_force(spark, options):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, length=L, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, L))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_bytes string, d int, s int")
    assert remove_repeats(df, length=L).count() == 0
    df = spark.createDataFrame([(1, "x" * 100, "mine", 4, 5)], "doc_id long, text string, n_bytes string, d int, s int")
    row = remove_repeats(df, length=L).collect()[0]
    assert row["n_bytes"] == "mine" and row["_n_bytes"] == 100 and row["n_removed"] == 100 and row["d"] == 4 and row["text"] == ""


def test_text_of_several_steps(spark):
    """Over 16 MB: matches within one text, across the seam of two steps, and with another text."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, STEP + 400_000).astype(np.uint8)
    text[STEP + 200_000 : STEP + 200_300] = text[1000:1300]
    seam = bytes(text[STEP - 150 : STEP + 150]).decode()
    rows = [(1, bytes(text).decode()), (2, f"<{seam}>"), (3, "short")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=200).collect()}
    assert got == {1: (len(text), 900, 3), 2: (302, 300, 1), 3: (5, 0, 0)}


def test_index_gives_longest_match_elsewhere():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 25)).astype(np.uint8) for _ in range(rng.integers(1, 5))]
        data, ends = np.concatenate(strings), np.cumsum([len(s) for s in strings])
        got = RunLengthIndex(data, ends).matching_statistics()
        places = [(s.tobytes(), i) for s in strings for i in range(len(s))]

        def common(p, q):
            a, b = p[0][p[1] :], q[0][q[1] :]
            return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        for k, p in enumerate(places):
            assert got[k] == max((common(p, q) for j, q in enumerate(places) if j != k), default=0)
