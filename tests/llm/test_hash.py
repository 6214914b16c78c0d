"""The hash of byte ranges, and texts that meet under any polynomial modulo a power of two."""

import numpy as np

from weftwise.llm.common import RollingHash
from weftwise.llm.near_dup import near_duplicates


def thue_morse(bits, a, b):
    one, two = a, b
    for _ in range(bits):
        one, two = one + two, two + one
    return one, two


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_equal_bytes_have_equal_hashes_wherever_they_stand():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    h = RollingHash(data)
    for k in (1, 2, 7, 200):
        seen, every = {}, h.every(k)
        for i in range(len(data) - k + 1):
            assert seen.setdefault(data[i : i + k].tobytes(), every[i]) == every[i]
        assert len(set(seen.values())) == len(seen) and len(every) == len(data) - k + 1
        assert (h.of(np.arange(len(data) - k + 1), np.arange(k, len(data) + 1)) == every).all()
    assert h.of(np.array([3]), np.array([3]))[0] == 0 and len(RollingHash(data[:0]).of(np.array([0]), np.array([0]))) == 1


def test_very_long_ranges():
    data = np.frombuffer(b"ab" * 3_000_000, np.uint8)
    h = RollingHash(data)
    assert h.of(np.array([0]), np.array([5_000_000])) == h.of(np.array([1_000_000]), np.array([6_000_000])) != h.of(np.array([1]), np.array([5_000_001]))


def test_thue_morse_words_differ():
    for bits in (10, 12, 16):
        one, two = thue_morse(bits, "a", "b")
        both = RollingHash(as_bytes(one + two))
        n = len(one)
        assert both.of(np.array([0]), np.array([n])) != both.of(np.array([n]), np.array([2 * n]))


def test_documents_of_such_words_are_not_linked(spark):
    one, two = thue_morse(10, "a", "b")
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}"), (5, one.upper())]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
