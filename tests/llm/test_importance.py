"""Importance resampling: the models by hand, the sample's size and determinism, and held-out accuracy."""

import math
from collections import Counter

import numpy as np

from weftwise.llm import importance
from weftwise.llm.importance import fit, good_ids, resample

COLUMNS = "doc_id long, text string, log_ratio string"


def corpus(seed=0, n=400):
    rng = np.random.default_rng(seed)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows, labels = [], []
    for d in range(n):
        bad_one = d % 4 == 0
        words = [str(rng.choice(bad if bad_one and rng.random() < 0.4 else good)) for _ in range(int(rng.integers(5, 60)))]
        rows.append((d, " ".join(words), "x"))
        labels.append((d, 0 if bad_one else 1, 0))
    return rows, labels


def test_weights_are_the_ratio_of_the_two_models(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    wanted = [d for d, q, _ in labels if q and d % 3]
    weights = fit(df, spark.createDataFrame([(d,) for d in wanted], "doc_id long"))
    raw, target = Counter(), Counter()
    for d, text, _ in rows:
        w = text.split()
        grams = [(x,) for x in w] + list(zip(w, w[1:], strict=False))
        raw.update(grams)
        if d in set(wanted):
            target.update(grams)
    buckets = {g: importance.hashed_ngrams(np.frombuffer(" ".join(g).encode(), np.uint8), np.array([0, len(" ".join(g))]))[0][-1] for g in raw}
    alone = {g: b for g, b in buckets.items() if Counter(buckets.values())[b] == 1}
    total = sum(raw.values()) + 1e-3 * importance.BUCKETS
    for g in list(alone)[:300]:
        expected = (raw[g] + 1e-3) / total * sum(target.values())
        want = math.log((target[g] + importance.SMOOTHING) / (expected + importance.SMOOTHING))
        assert abs(weights[alone[g]] - want) < 1e-4


def test_ratio_key_and_cut(spark):
    """Log ratios, Gumbel keys and the cut against plain Python; keys far apart and beyond a million stay in order."""
    rows, labels = corpus(2, 120)
    rows.append((500, " ".join(["g1"] * 400_000), "x"))
    rows.append((501, " ".join(["b1"] * 400_000), "x"))
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    good = good_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weights = fit(df, good)
    got = {r["doc_id"]: r for r in resample(df, good, 0.5).collect()}
    for d, text, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        bucket, _ = importance.hashed_ngrams(data, np.array([0, len(data)]))
        assert got[d]["n_ngrams"] == len(bucket) and math.isclose(got[d]["log_ratio"], float(weights[bucket].astype(float).sum()), rel_tol=1e-6, abs_tol=1e-6)
    noise = [r["gumbel_key"] - r["log_ratio"] for d, r in got.items() if d < 500]
    assert -4 < min(noise) < max(noise) < 12 and 0 < sum(noise) / len(noise) < 1.2
    order = sorted(got, key=lambda d: -got[d]["gumbel_key"])
    assert {d for d, r in got.items() if r["kept"]} == set(order[: round(0.5 * len(rows))])
    assert min(abs(got[d]["log_ratio"]) for d in (500, 501)) > 1e6


def test_sample(spark):
    rows, labels = corpus(1)
    rows += [(1000, None, "x"), (1001, " ", "x"), (5, rows[5][1], "x"), (None, rows[6][1], "x")]
    df = spark.createDataFrame(rows, COLUMNS)
    good = good_ids(spark.createDataFrame([r for r in labels if r[0] % 2], "doc_id long, quality int, toxic int"))
    one = resample(df.repartition(5), good, 0.75).collect()
    two = resample(df.repartition(2), good, 0.75).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str) and len(one) == len(rows)
    kept = {r["doc_id"] for r in one if r["kept"]}
    usable = [r for r in one if r["n_ngrams"]]
    assert abs(sum(r["kept"] for r in usable) - round(0.75 * len(usable))) <= 1 and not kept & {1000, 1001}
    assert min(r["gumbel_key"] for r in usable if r["kept"]) >= max(r["gumbel_key"] for r in usable if not r["kept"])
    bad = {d for d, q, _ in labels if not q and d % 2 == 0}
    assert len(kept & bad) < 0.25 * len(bad)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert resample(spark.createDataFrame([], COLUMNS), none, 0.5).count() == 0
    got = resample(spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], COLUMNS), none, 0.5).collect()
    assert sum(r["kept"] for r in got) == 1 and all(r["log_ratio"] == 0 for r in got)
