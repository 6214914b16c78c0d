"""Fingerprints: the edited text and its digest by brute force, and likeness that follows the edit distance."""

import hashlib

import numpy as np
import pytest

from weftwise.llm import fingerprints
from weftwise.llm.common import mix64
from weftwise.llm.fingerprints import BINS, edit_probe, fingerprint_documents, fingerprint_texts, likeness, near_groups


def prose(rng, n):
    return "".join(rng.choice(list("abcdefghij éü"), n))


def texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    return [prose(rng, int(k)) for k in np.append(rng.integers(0, 900, n - 3), [1, 5000, 20_000])]


def test_likeness_follows_edits():
    rng = np.random.default_rng(1)
    base = prose(rng, 3000)
    made = [base]
    for edits in (3, 30, 300):
        t = list(base)
        for _ in range(edits):
            k = int(rng.integers(len(t)))
            t[k : k + int(rng.integers(0, 2))] = list(prose(rng, 1))
        made.append("".join(t))
    made += [base[:1500] + prose(rng, 1500), prose(rng, 3000), base]
    p = fingerprint_texts(made)
    near = likeness(np.repeat(p[:1], len(p), axis=0), p)
    assert near[0] == near[6] == 1 and near[1] > 0.9 and near[1] >= near[2] > near[3] > near[5] and 0.35 < near[4] < 0.75 and near[5] < 0.25


def test_walks_do_not_depend_on_company():
    some = texts(3)
    together = fingerprint_texts(some)
    assert all(np.array_equal(fingerprint_texts([t])[0], together[k]) for k, t in enumerate(some))
    assert together.shape == (len(some), BINS) and not fingerprint_texts([""]).any()


def test_probe(spark):
    some = texts()
    rows = [(7 * i, t, "x") for i, t in enumerate(some)] + [(10_000, None, "x"), (10_001, "tail", "x"), (35, some[5], "x"), (None, "no id", "x")]
    got = edit_probe(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (d, t, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        p = fingerprint_texts([t, edited, after])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), p[0].tobytes().hex(), p[1].tobytes().hex(), likeness(p[:1], p[1:2])[0], likeness(p[:1], p[2:])[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


def test_single_and_empty(spark):
    one = edit_probe(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1
    assert edit_probe(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_banding_finds_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = prose(rng, 2000)
    rows = [(i, base[:k] + "Z" + base[k:]) for i, k in enumerate(rng.integers(0, 2000, 40))] + [(100 + i, prose(rng, 1500)) for i in range(20)] + [(200, None), (201, ""), (202, base + "!"), (None, base)]
    got = dict(map(tuple, near_groups(fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))).collect()))
    assert got == {d: 0 if d < 40 or d == 202 else 200 if d in (200, 201) else d for d, _ in rows if d is not None}


@pytest.mark.parametrize("block", [4096, 16])
def test_groups_against_all_pairs(spark, monkeypatch, block):
    """Chains of edits in one large group and short texts: recall and precision against every pair."""
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = np.random.default_rng(5)
    some = texts(2, 40)
    for k in range(160):
        t = list(some[int(rng.integers(len(some)))])
        for _ in range(1 + len(t) // 100):
            if t:
                t[int(rng.integers(len(t)))] = "x"
        some.append("".join(t))
    prints = fingerprint_texts(some)
    label = list(range(len(some)))
    links = 0
    for i in range(len(some)):
        for j in np.flatnonzero(likeness(prints[i : i + 1], prints[i + 1 :]) >= 0.8) + i + 1:
            links += 1
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert links > 200
    got = dict(map(tuple, near_groups(spark.createDataFrame([(d, p.tobytes().hex()) for d, p in enumerate(prints)], "doc_id long, fingerprint string")).collect()))
    assert got == dict(enumerate(label))


def plain_walk(text):
    """The walk a character at a time, from its definition."""
    walk, out, at, j = fingerprints._Walk(), [0] * BINS, 0, 0
    walk.reach(1 << 14)
    while at < len(text):
        walk.reach(j + 1)
        code = int(mix64(np.array([ord(text[at]) + 1], np.uint64))[0] >> np.uint64(32)) | 1
        if j in walk.sample:
            b, odd = walk.sample[j]
            out[b] = ((code * int(odd)) % 2**32 >> 24) | 1
        at += (code * int(walk.move[j])) % 2**32 >> 31
        j += 1
    return bytes(out)


def test_walk_against_its_definition():
    for t in ["", "a", "aaaa", "héllo wörld 😀 " * 40, *texts(4, 6)[:5]]:
        assert fingerprint_texts([t])[0].tobytes() == plain_walk(t)


def test_very_long_text(spark):
    rng = np.random.default_rng(1)
    long_ = prose(rng, 400_000)
    got = {r["doc_id"]: r for r in edit_probe(spark.createDataFrame([(1, long_), (2, long_[:-5] + "other"), (3, "x")], "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == 400_000 and got[1]["near_next"] > 0.95 and 0.3 < got[1]["near_edited"] < 0.8
    assert got[2]["near_next"] < 0.2 and got[3]["edited_sha256"] == hashlib.sha256(b"x").hexdigest()
