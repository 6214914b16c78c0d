"""MinHash near-dedup against all pairs of full shingle sets."""

import re
from itertools import combinations

import numpy as np
import pytest

from weftwise.llm import near_dup
from weftwise.llm.components import connected_components
from weftwise.llm.near_dup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(ids, links):
    label = {d: d for d in ids}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {d: find(d) for d in ids}


def brute(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = roots(list(sets), links)
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


def corpus(seed, bases=25, each=14):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghé"), rng.integers(2, 7))) for _ in range(400)]
    rows, d = [], 0
    for _ in range(bases):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 260))))
        for _ in range(int(rng.integers(1, each))):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, len(w) // 40)))):
                w[rng.integers(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
            rows.append((d, text.upper() if rng.random() < 0.1 and "é" not in text else text))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, "one two"), (d + 3, "ONE\ttwo"), (d + 4, "one two three"), (d + 5, " \n "), (d + 6, "a a a a a a"), (d + 7, "a a a a a")]
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rows = corpus(5, bases=3, each=250)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text, "x"), (4, text, "y"), (9, text, "z"), (None, text, "n"), (None, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r)[:4] for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 46, 4, True), (4, 46, 4, True), (9, 46, 4, False), (None, 46, None, True), (None, 0, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_but_not_a_text(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(4, one), (4, two), (9, one + " x"), (10, two + " y"), (3, two + " y z")]
    got = sorted(tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 48, 3, True), (4, 46, 3, False), (4, 46, 4, True), (9, 47, 4, False), (10, 47, 3, False)]
    rows = [(4, one), (4, one), (4, one + " x"), (4, two), (7, None), (7, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # one row of each group stays, and the repeated rows of that row
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)
    stay = {(r["n_shingles"], r["text_hash"]) for r in got if r["stays"]}
    assert len(stay) == 3 and {n for n, _ in stay} in ({0, 46}, {0, 46, 47})


def test_very_long_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 150_000)]
    near = list(words)
    for k in rng.integers(0, len(near), 3000):
        near[k] = "changed"
    rows = [(1, " ".join(near)), (2, " ".join(words)), (3, " ".join(words[:60_000])), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + " ")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute(rows)


def test_components(spark, tmp_path):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    want = roots({x for p in links for x in p}, links)
    for task_links in (10_000, 130):
        got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(4), f"file://{tmp_path}/{task_links}", task_links).collect()
        assert sorted(map(tuple, got)) == sorted((d, r) for d, r in want.items() if d != r)


def template_corpus(seed, documents=700, pairs=40):
    """Documents that share a template (likeness below 0.75 to each other), some with one partner just over it."""
    rng = np.random.default_rng(seed)
    template = [f"t{i}" for i in range(160)]
    rows = []
    for d in range(documents):
        own = [f"d{d}x{i}" for i in range(30)]
        rows.append((d, " ".join(template + own)))
    for k in range(pairs):
        # half of the document's own end is new: 0.83 to that document, 0.72 to all others
        words = rows[k][1].split()
        rows.append((documents + k, " ".join(words[:-17] + [f"p{k}x{i}" for i in range(17)])))
    order = rng.permutation(len(rows))
    return [(int(order[i]), t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("block", "size"), [(4096, 2_000_000), (60, 9_000)])
def test_pairs_within_a_crowded_template(spark, block, size, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", size)
    rows = template_corpus(3, 400)
    want = brute(rows)
    assert sum(not kept for _, _, kept in want.values()) == 40
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == want


def crowded_corpus(seed, documents=1000, words=120, edits=3):
    """One base text with a few edits each: most pairs are below 0.75, some hundreds just over it."""
    rng = np.random.default_rng(seed)
    base = [f"b{x}" for x in rng.integers(0, 10_000, words)]
    rows = []
    for d in range(documents):
        w = list(base)
        for k in rng.choice(words, edits, replace=False):
            w[k] = f"e{d}x{k}"
        rows.append((d, " ".join(w)))
    return rows


def test_crowded_group_near_the_threshold(spark):
    rows = crowded_corpus(11)
    want = brute(rows)
    assert 300 < len({c for _, c, _ in want.values()}) < 900
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == want


def test_depth_grows_only_where_a_prefix_is_crowded():
    region = np.array([1] * 3 + [2] * 20)
    deep = np.array([5, 6, 7, *(np.arange(20) // 10 * (1 << 60) + np.arange(20) // 5 * (1 << 40) + np.arange(20))])
    first, leaf, above = near_dup._leaves(region, deep)
    assert first.tolist() == [0] * 3 + [3] * 20
    assert leaf.tolist() == [0] * 3 + [3] * 5 + [8] * 5 + [13] * 5 + [18] * 5
    assert above.tolist() == [0] * 3 + [3] * 10 + [13] * 10
