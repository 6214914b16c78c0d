"""Phrase collocation mining over vertical positional lists.

Texts are worked on in blocks, whose words become inverted lists: for each word its ascending positions in the block.
Frequent phrases are extended by merge-joining their positions with the postings of the word that stands next, and the
length of the joined list is the block's exact count; as no phrase crosses a piece, the counts of all blocks add up by
a grouped shuffle.

Only phrases whose parts are frequent are extended. What is frequent anywhere is told to the tasks as a bitmap of
fixed size over phrase hashes, made by a first count over those hashes: two phrases that share a bit or a hash only let
more through, so nothing frequent is lost, and a last count over the phrases themselves is exact. With more frequent
phrases than bits the bitmap cuts less and more is shuffled; results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwise.llm.common import LOWER, U64, RollingHash, let_workers_import, materialise, mix64, shuffles_freed, work_dir

#: Bytes of text in a block; a longer text is cut between pieces, and only a longer piece makes a larger block.
BLOCK_BYTES = 4 << 20
#: Bits (as a power of two) of the broadcast set of frequent hashes: 8 MB.
BITS = 26

_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(LOWER)
_CLASS = bytes(2 if c in _ENDS else 1 if c in _BLANKS else 0 for c in range(256))
_STEP = U64(0x9E3779B97F4A7C15)


class Block:
    """The words of a block: ``kind`` of each occurrence (a word of a language) at its ``position``, both in text order.

    Positions go up by one from word to word and by two between pieces, so adjacent words of one piece are exactly
    those whose positions differ by one.
    """

    def __init__(self, raw: bytes, offsets: np.ndarray, langs: np.ndarray, names: list[str]):
        sort = np.frombuffer(raw.translate(_CLASS), np.uint8)
        inner = sort == 0
        begin, stop = inner.copy(), inner.copy()
        begin[1:] &= sort[:-1] != 0
        stop[:-1] &= sort[1:] != 0
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text begins and another ends
        begin[heads] = inner[heads]
        stop[heads[1:] - 1] = inner[heads[1:] - 1]
        start = np.flatnonzero(begin)
        # words without what stands between them are one run of bytes, which Arrow tells apart exactly
        at = np.concatenate([[0], np.cumsum(np.flatnonzero(stop) + 1 - start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw.translate(_LOWER, _ENDS + _BLANKS))]).dictionary_encode()
        self.words, word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(self.words)
        row, piece = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(np.flatnonzero(sort == 2), start)
        fresh = np.zeros(len(start), bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
        self.position = np.arange(len(start), dtype=np.int64) + np.cumsum(fresh)
        self.names, self.lang = names, langs[row]
        self.kinds, self.kind = np.unique(self.lang * n + word, return_inverse=True) if len(np.unique(langs)) > 1 else (np.arange(n) + langs[0] * n, word)
        _, at, letters = self.words.buffers()
        at, whole = np.frombuffer(at, np.int32)[: n + 1], RollingHash(np.frombuffer(letters, np.uint8) if letters is not None else np.zeros(0, np.uint8))
        seed = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in names], U64)
        self.hash = mix64(whole.of(at[:-1], at[1:])[self.kinds % n] ^ seed[self.kinds // n]) if n else np.zeros(0, U64)

    @cached_property
    def spelt(self) -> list[tuple[int, str]]:
        """Language and word of each kind."""
        words = self.words.to_pylist()
        return [(k // len(words), words[k % len(words)]) for k in self.kinds.tolist()]

    def postings(self) -> Level:
        """The words as lists."""
        return Level(self.kind, self.position, np.arange(len(self.kinds))[:, None], self.hash)


class Level:
    """The vertical lists of all phrases of one length.

    ``position`` holds list after list, each ascending, and ``phrase`` the number of its phrase; ``words`` (a row a
    phrase) and ``hash`` tell what a phrase is.
    """

    def __init__(self, phrase: np.ndarray, position: np.ndarray, words: np.ndarray, hash_: np.ndarray):
        """Of occurrences in any order: one sort of number and position packed together makes the lists."""
        self.width = int(position.max(initial=0)).bit_length()
        packed = np.sort((phrase.astype(U64) << U64(self.width)) | position.astype(U64))
        self.phrase, self.position = (packed >> U64(self.width)).astype(np.int64), (packed & U64((1 << self.width) - 1)).astype(np.int64)
        self.words, self.hash = words, hash_

    def counts(self) -> np.ndarray:
        """The lengths of the lists."""
        return np.bincount(self.phrase, minlength=len(self.words))

    def without(self, keep: np.ndarray) -> Level:
        """Only the lists of the phrases that are kept, under their old numbers."""
        out, at = object.__new__(Level), keep[self.phrase]
        out.width, out.phrase, out.position, out.words, out.hash = self.width, self.phrase[at], self.position[at], self.words, self.hash
        return out

    def by_place(self) -> np.ndarray:
        """What stands at each position: the phrase that begins there, -1 where none does (and two places beyond)."""
        out = np.full(int(self.position.max(initial=0)) + self.words.shape[1] + 2, -1, np.int64)
        out[self.position] = self.phrase
        return out

    def extended(self, postings: Level) -> Level:
        """Merge-join: each list, in ascending order, with the postings of the words that stand next to its phrase.

        The postings are laid out by position for it. What is left of the longer phrase without its first word has to
        have a list at this level as well.
        """
        n, word_at = self.words.shape[1], postings.by_place()
        word = word_at[np.minimum(self.position + n, len(word_at) - 1)]
        hit = word >= 0
        if n > 1:
            hit &= self.by_place()[self.position + 1] >= 0
        position, key = self.position[hit], self.phrase[hit] * len(postings.words) + word[hit]
        longer = Level(key, position, postings.words, postings.hash)
        new = np.ones(len(key), bool)
        new[1:] = longer.phrase[1:] != longer.phrase[:-1]
        key, longer.phrase = longer.phrase[new], np.cumsum(new) - 1
        first, last = np.divmod(key, max(1, len(postings.words)))
        longer.words = np.concatenate([self.words[first], last[:, None]], axis=1)
        longer.hash = mix64((self.hash[first] + _STEP) * U64(3) ^ mix64(postings.hash[last]))
        return longer


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashes & U64((len(bits) << 6) - 1)
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def levels(block: Block, masks: list[np.ndarray], most: int) -> Iterator[Level]:
    """Lists of 1, 2, ... words as far as the masks of frequent phrases go, and one level beyond them."""
    level = postings = block.postings()
    yield level
    for mask in masks[: most - 1]:
        level = level.without(passes(mask, level.hash))
        if level.words.shape[1] == 1:
            postings = level
        level = level.extended(postings)
        yield level


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of whole texts (text, lang); texts larger than a block are cut where a piece ends."""
    for batch in batches:
        names, langs = _languages(batch.column(1))
        text = batch.column(0).fill_null("").cast(pa.large_string())
        _, offs, data = text.buffers()
        if not batch.num_rows or data is None:
            continue
        offs, raw = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1], memoryview(data)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_BYTES, "right")) - 1)
            at = offs[i : j + 1]
            if j == i + 1 and at[1] - at[0] > BLOCK_BYTES:
                for part in _cuts(bytes(raw[at[0] : at[1]])):
                    yield Block(part, np.array([0, len(part)]), langs[i:j], names)
            elif at[-1] > at[0]:
                yield Block(bytes(raw[at[0] : at[-1]]), at - at[0], langs[i:j], names)
            i = j


def _cuts(raw: bytes) -> Iterator[bytes]:
    """Stretches of about a block, each ending with a piece."""
    ends = np.append(np.flatnonzero(np.frombuffer(raw.translate(_CLASS), np.uint8) == 2) + 1, len(raw))
    a = 0
    while a < len(raw):
        k = int(np.searchsorted(ends, a + BLOCK_BYTES, "right")) - 1
        b = int(ends[k]) if k >= 0 and ends[k] > a else int(ends[min(np.searchsorted(ends, a, "right"), len(ends) - 1)])
        yield raw[a:b]
        a = b


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(column, "und").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


# ---------------------------------------------------------------- counts over all blocks


def hashed_counts(docs: DataFrame, masks: list[np.ndarray], most: int) -> DataFrame:
    """(h, n): counts by hash of the phrases one word longer than the masks reach."""
    sent = [docs.sparkSession.sparkContext.broadcast(m) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [b.value for b in sent]
        for block in blocks(batches):
            *_, level = levels(block, masks, most)
            yield pa.RecordBatch.from_arrays([pa.array(level.hash.astype(np.int64)), pa.array(level.counts())], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_bits(counted: DataFrame, least: int, bits: int = BITS) -> np.ndarray:
    """The bitmap of the hashes that count ``least`` and more: 64 bits a row, at most 2**(bits - 6) rows to the driver."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = counted.filter(F.col("n") >= least).groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[np.asarray(rows.column("i").combine_chunks())] = np.asarray(rows.column("b").combine_chunks()).view(U64)
    return out


def exact_counts(docs: DataFrame, masks: list[np.ndarray], most: int) -> DataFrame:
    """(lang, k, phrase, a) of all phrases that the masks let through, and k = 0 with the number of a language's words."""
    sent = [docs.sparkSession.sparkContext.broadcast(m) for m in masks]

    def batch(lang: pa.Array, k: np.ndarray, phrase: pa.Array, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, pa.array(k, pa.int32()), phrase, pa.array(a, pa.int64())], names=["lang", "k", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [b.value for b in sent]
        for block in blocks(batches):
            whole, names = np.bincount(block.lang, minlength=len(block.names)), pa.array(block.names, pa.string())
            yield batch(names, np.zeros(len(whole), np.int64), pa.array([""] * len(whole)), whole)
            for level, mask in zip(levels(block, masks, most), masks, strict=False):
                n = level.counts()
                kept = np.flatnonzero((n > 0) & passes(mask, level.hash))
                kinds = block.kinds[level.words[kept]]
                words = [block.words.take(pa.array(kinds[:, i] % len(block.words))) for i in range(kinds.shape[1])] if len(kept) else [pa.array([], pa.string())]
                yield batch(names.take(pa.array(kinds[:, 0] // max(1, len(block.words)))), np.full(len(kept), kinds.shape[1]), pc.binary_join_element_wise(*words, " "), n[kept])

    return docs.mapInArrow(run, "lang string, k int, phrase string, a long").groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, most: int = 3, least: int = 10, bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, a): all phrases of up to ``most`` words (text, lang) that stand ``least`` times, and for each
    language k = 0 with the number of its words. Written once to the shared folder."""
    let_workers_import(docs.sparkSession)
    masks: list[np.ndarray] = []
    with shuffles_freed(docs.sparkSession):
        for _ in range(most):
            masks.append(frequent_bits(hashed_counts(docs, masks, most), least, bits))
        found = exact_counts(docs, masks, most).filter((F.col("k") == 0) & (F.col("a") > 0) | (F.col("a") >= least))
        return materialise(found, f"{work_dir(docs.sparkSession)}/phrases")


def scored(grams: DataFrame, most: int = 3) -> DataFrame:
    """(lang, phrase, k, a, l, r, score): each phrase of two and more words with its weakest cut.

    The score is floor(1000000 a a / (l r)) in decimals of 38 digits, exact up to 10**16 occurrences. Of equal scores
    the shortest first part counts.
    """
    part = grams.filter("k > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), F.array_join(F.slice(words, F.lit(1), c), " ").alias("first"), F.array_join(F.slice(words, c + 1, F.col("k") - c), " ").alias("rest")))
    cut = grams.filter("k > 1").select("lang", "phrase", "k", "a", F.inline(cuts))
    cut = cut.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    cut = cut.withColumn("score", score)
    return cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def within_longer(grams: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of each phrase that lies inside longer ones the largest count among them."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return grams.filter("k > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, most: int = 3, least: int = 10, first: int = 2000, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to ``most`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs. Null
    texts are empty, null languages ``und``; an empty table gives no rows. Phrases stand within a piece, overlaps
    count, repeated rows count each. A phrase inside a longer frequent one that has half its occurrences is left out.
    Order: score, occurrences (both downwards), phrase by its bytes. Very long texts are worked on in blocks.
    """
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    grams = frequent_phrases(own, most, least, bits)
    inner = within_longer(grams)
    left = scored(grams, most).join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    total = grams.filter("k = 0").select("lang", F.col("a").alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's best are found in shares first, so no task gets all of them
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= first).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

