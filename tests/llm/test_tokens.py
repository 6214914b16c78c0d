"""BPE and packing: ids and decoding as the tokenizers library's, and packing that is whole and tight."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from weftwise.llm.bpe import encode_documents, encoding_digests, library_encoder, pair_index_encoder  # noqa: E402
from weftwise.llm.packing import pack_documents, plan_slots  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "Hello world", "  two  spaces\n\n\tand tabs ", "a" * 3000, "ab" * 2000, "naïve café — 東京 😀", "it's we'll THEY'RE", "x<|endoftext|>y <|endoftext|>", "\x1c\x1d \x85  ", "1234567890" * 50, "Été " * 4000]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_random_texts():
    rng = random.Random(3)
    own, vocabulary = pair_index_encoder(PATH)
    other = library_encoder(PATH)
    for _ in range(1500):
        text = "".join(
            rng.choice([chr(rng.randrange(0x250)), chr(rng.randrange(32, 127)), rng.choice("  \n\t  \x1c'sat"), chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])), "<|endoftext|>" * (rng.random() < 0.1), "aaaa" * (rng.random() < 0.2)])
            for _ in range(rng.randrange(30))
        )
        ids = want(text)
        for encoder in (own, other):
            places = encoder.places(text)
            encoder.settle()
            assert encoder.of(places).tolist() == ids, text
        assert vocabulary.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_documents(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    for r in encode_documents(df, PATH).collect():
        assert r["_ids"] == want(TEXTS[r["doc_id"]]) and r["decoded"] == (TEXTS[r["doc_id"]] or "") and r["ids"] == 7
    for r in encoding_digests(df, PATH).collect():
        ids = np.array(want(TEXTS[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest())


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(spark, size):
    rng = random.Random(1)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["the", "of", "was", "kites"]) for _ in range(rng.randrange(300)))) for i in range(300)] + [(3, TEXTS[3])]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, size).collect()
    texts = dict(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array([*want(texts[d]), 0], "<u4")
        if d == 3:
            assert len(pieces) == 2 and pieces[0][:5] == pieces[1][:5]
            pieces = pieces[:1]
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == size) and (len(ids) > size or len(pieces) == 1)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(r["length"] for r in got) // size)
    assert least <= len(by_sequence) <= least + 2


def test_odd_rows(spark):
    """Null ids, repeated rows and columns of the results' names: each row is packed and encoded by itself."""
    rows = [(None, TEXTS[3], 1, "x"), (None, None, 2, "x"), (5, TEXTS[4], 3, "x"), (5, TEXTS[4], 4, "x"), (5, TEXTS[5], 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, ids_sha256 string").repartition(2)
    pieces = pack_documents(df, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in pieces) == sorted((d or -1, len(want(t)) + 1) for d, t, _, _ in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(rows)
    digests = encoding_digests(df, PATH).select("doc_id", "n_tokens").collect()
    assert sorted((d or -1, n) for d, n in digests) == sorted((d or -1, len(want(t))) for d, t, _, _ in rows)


def test_equal_lengths_fill_by_pairs_and_triples():
    """Lengths that only combinations of two, three and four fill exactly."""
    for counts in ({30: 50, 34: 50}, {20: 40, 24: 40}, {10: 30, 14: 30, 40: 30}, {64: 5, 32: 7}):
        histogram = np.zeros(65, np.int64)
        for x, n in counts.items():
            histogram[x] = n
        slots = plan_slots(histogram, 64)
        assert slots["sequence"].size and int((histogram * np.arange(65)).sum()) <= 64 * _sequences(slots, histogram)
    exact = np.zeros(65, np.int64)
    exact[[30, 34]] = 50
    assert _sequences(plan_slots(exact, 64), exact) == 50
    exact = np.zeros(65, np.int64)
    exact[[20, 24]] = [80, 40]
    assert _sequences(plan_slots(exact, 64), exact) == 40


def _sequences(slots, histogram):
    """How many sequences a plan has: its ranges' numbers run on from each start."""
    low, length, sequence = slots["low"], slots["length"], slots["sequence"]
    ends = np.append(np.where(length[1:] == length[:-1], low[1:], histogram[length[:-1]]), histogram[length[-1]])
    return int((sequence + ends - low).max())


def test_plan_is_tight_on_random_histograms():
    rng = np.random.default_rng(0)
    for size in (16, 100, 2048):
        for _ in range(4):
            counts = np.append(0, rng.geometric(0.02, size) * (rng.random(size) < 0.6)).astype(np.int64)
            slots = plan_slots(counts, size)
            least = -(-int((counts * np.arange(size + 1)).sum()) // size)
            halves = counts[size // 2 + 1 :].sum()
            assert slots["sequence"].max() + 1 >= max(least, 1) and len(slots["length"]) < 60 * size
            assert counts.sum() and halves >= 0
    assert all(len(v) == 0 for v in plan_slots(np.zeros(17, np.int64), 16).values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(df, PATH).count() == 0 and encode_documents(df, PATH).count() == 0 and encoding_digests(df, PATH).count() == 0
