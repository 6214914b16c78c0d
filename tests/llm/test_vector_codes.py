"""Vector codes against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from weftwise.llm.vector_codes import books_digest, compress_vectors, nearest

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in rows if usable(v)]
    order = sorted((r for r in kept if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not order:
        return [], None
    dim = len(order[0][1])
    width = -(-dim // parts)
    cut = lambda v: [(v + [0] * (width * parts - dim))[k * width : (k + 1) * width] for k in range(parts)]
    fit = [(i, cut(v), label) for i, v, label in kept if len(v) == dim]
    books = [[cut(r[1])[k] for r in order if len(r[1]) == dim][:entries] for k in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for k in range(parts):
            of = [near(v[k], books[k])[0] for _, v, _ in fit]
            books[k] = [[sum(v[k][i] for (_, v, _), e in zip(fit, of, strict=True) if e == j) // of.count(j) for i in range(width)] if j in of else c for j, c in enumerate(books[k])]
    out = []
    for i, v, label in fit:
        found = [near(x, b) for x, b in zip(v, books, strict=True)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
    flat = ",".join(str(x) for k, b in enumerate(books) for c in b for x in c[: max(0, dim - k * width)])
    sha = hashlib.sha256(flat.encode()).hexdigest()
    total = {label: sum(r[2] for r in out if r[3] == label) for label in {r[3] for r in out}}
    done = [(i, c, e, total[label], sha) for i, c, e, label in out]
    return done + [(i, None, None, None, None) for i, v, _ in kept if len(v) != dim], books


def same(spark, rows, **how):
    df = spark.createDataFrame([(*r, "mine", 0) for r in rows], VECTORS).repartition(3)
    got, books = compress_vectors(df, **how)
    want, own = brute(rows, **how)
    assert sorted(map(str, map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))) == sorted(map(str, want))
    assert books is None if own is None else books.tolist() == own


def test_against_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(90)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None] * 4, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] + [0.0] * 7, 2), (205, [-float("inf")] + [0.0] * 7, 2), (206, [0.5] * 7, 2)]
    rows += [(300, rows[0][1], 1), (300, rows[0][1], 1), (301, [0.0] * 8, None), (-5, [-0.0004] * 8, 1), (None, [0.1] * 8, 1), (None, [0.2] * 8, 1)]
    same(spark, rows, entries=16)


def test_dimension_that_parts_do_not_divide_and_few_vectors(spark):
    rng = np.random.default_rng(4)
    same(spark, [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6)], i % 2) for i in range(20)])
    same(spark, [(1, [0.5], 1), (2, [-0.5], 1)])


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [float("nan")], 1)]])
def test_nothing_is_kept(spark, rows):
    same(spark, rows)


def test_ties_go_to_the_lower_entry_and_means_are_floored(spark):
    same(spark, [(i, [x / 1024] * 4, 0) for i, x in enumerate([0, 0, 2, 1, -1, -3, -2, 1])], entries=3, rounds=2)


def test_whole_numbers_stay_exact_far_out():
    x = np.array([[2**28, -(2**28)], [2**28 - 1, 5]], np.int64)
    book = np.array([[-(2**28), 2**28], [2**28, 3]], np.int64)
    code, d = nearest(x, book)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in book] for v in x]
    assert code.tolist() == [w.index(min(w)) for w in want] and d.tolist() == [min(w) for w in want]


def test_huge_components_are_bounded(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38, 1.0, 0.0], 1, "", 0), (2, [0.0] * 4, None, "", 0)], VECTORS)
    got, books = compress_vectors(df)
    assert got.count() == 2 and abs(books).max() == math.isqrt((2**61 - 1) // 4) and books_digest(books, 4) == got.first()["codebooks_sha256"]
