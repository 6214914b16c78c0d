"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftwise.llm import phrases
from weftwise.llm.phrases import Block, blocks, collocations, frequent_phrases, levels, scored

DOCS = "doc_id long, text string, lang string, phrase string, n long, a long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, most=3, least=10, first=2000):
    f, n = counted(rows, most)
    found = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, score, a, " ".join(p), left, right))
    out = []
    for lang in {x[0] for x in found}:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        out += [(lang, i, p, a, le, ri, n[lang], s) for i, (_, s, a, p, le, ri) in enumerate(own[:first], 1)]
    return sorted(out)


def odd_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "cat", "Ähre", "ähre", "x y", "\U0001f600", "dog", "a'b", "ｚ"]
    rows = [("".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", ";x:", "!", "?", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "", "und"])) for _ in range(250)]
    return rows + [(None, "en"), ("", None), ("a a a a a a a a a a a a a a", "fr"), ("   \t.,", "fr"), ("one two three", "es")] + [("new york city hall", "es")] * 12 + [("york city", "es")] * 30 + [("new york", "es")] * 11


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "mine", 0, 0) for i, r in enumerate(rows)], DOCS).repartition(5)


@pytest.mark.parametrize("how", [{}, {"first": 7}, {"bits": 6}, {"most": 4, "least": 5}, {"most": 2}])
def test_against_plain_python(spark, how):
    rows = odd_rows()
    got = sorted(map(tuple, collocations(frame(spark, rows), **how).collect()))
    assert got == brute(rows, **{k: v for k, v in how.items() if k != "bits"}) and len(got) > 5


def test_counts_of_all_frequent_phrases(spark):
    rows = odd_rows()
    f, n = counted(rows, 3)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in frequent_phrases(frame(spark, rows).select("text", "lang")).filter("k > 0").collect()}
    assert got == {k: v for k, v in f.items() if v >= 10}


def test_empty_table(spark):
    assert collocations(frame(spark, [])).count() == 0
    assert collocations(frame(spark, [(None, None), ("", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**15
    grams = spark.createDataFrame([("en", 1, "p", big), ("en", 1, "q", big + 1), ("en", 2, "p q", big - 1), ("en", 1, "r", 3 * big), ("en", 2, "q r", big - 2), ("en", 3, "p q r", big - 3)], "lang string, k int, phrase string, a long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in scored(grams).collect()}
    s = lambda a, left, right: (left, right, 1_000_000 * a * a // (left * right))
    assert got == {"p q": s(big - 1, big, big + 1), "q r": s(big - 2, big + 1, 3 * big), "p q r": min(s(big - 3, big, big - 2), s(big - 3, big - 1, 3 * big), key=lambda x: x[2])}


def counts_of(made, most=3):
    found = Counter()
    everything = [np.full(1 << 2, 2**64 - 1, np.uint64)] * most
    for block in made:
        for level in levels(block, everything, most):
            for words, n in zip(level.words.tolist(), level.counts().tolist(), strict=True):
                if n:
                    found[block.names[block.spelt[words[0]][0]], tuple(block.spelt[w][1] for w in words)] += n
    return found


def test_blocks_cut_long_texts_between_pieces(monkeypatch):
    """Whatever the size of a block, the lists of all blocks add up to the same counts."""
    rows = odd_rows() + [("lone " * 3000 + "end. " + "a b c. " * 2000, "en"), ("no piece ends here " * 900, "de")]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r[0] for r in rows], pa.string()), "lang": pa.array([r[1] for r in rows], pa.string())})
    want = Counter({k: v for k, v in counted(rows, 3)[0].items()})
    for size in (64, 5000, 1 << 20):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        assert counts_of(blocks(iter([batch.slice(0, 50), batch.slice(50)]))) == want


def test_lists_are_ascending_and_their_length_is_the_frequency():
    data = b"a b a b. a b"
    block = Block(data, np.array([0, len(data)]), np.array([0]), ["en"])
    one, two = list(levels(block, [np.full(4, 2**64 - 1, np.uint64)], 2))
    lists = {" ".join(block.spelt[w][1] for w in words): two.position[two.phrase == i].tolist() for i, words in enumerate(two.words.tolist())}
    assert lists == {"a b": [0, 2, 5], "b a": [1]} and one.counts().tolist() == [3, 3]
