"""Byte-pair encoding and decoding by a pair occurrence index.

A worker cuts texts into pre-tokens and encodes each distinct one once. All new pre-tokens of a block of
texts are encoded together: their symbols lie in one array, linked left and right, and an index maps every
adjacent pair that has a merge rank to all its positions. Ranks are taken in ascending order from a heap;
all positions of a rank merge in one numpy step, and the lists of the pairs that arise are extended.
A merge never makes a pair of a lower rank than its own, so ascending ranks give each word its own result.

Encodings equal those of the ``tokenizers`` library for a byte-level vocabulary (its file's path is a
parameter): special tokens in a text are cut out first and keep their id. Whole texts are encoded; null is
empty. The memory of seen pre-tokens is bounded and holds no result of its own. Each row is encoded by itself:
repeated rows and rows without an id come out alike, other columns pass ``encode_documents`` (an added name that
is taken gets underscores in front) and are not read for digests. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import free_name

#: The vocabulary's published pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that Unicode versions sort differently into letters, numbers and others; where a text has one, the
#: library cuts it. All planes above the first count, but for the emoji blocks.
_UNSETTLED = "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U00010000-\U0001efff\U00020000-\U0010ffff]"
#: Characters of text whose new pre-tokens are encoded together, and pre-tokens remembered.
BLOCK_CHARS, MEMORY = 8_000_000, 300_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Ids, merges and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        of = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([ids[s] for s in symbols], np.int64)
        self.size = max([*ids.values(), *self.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right = keys // self.size, keys % self.size
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        tokens = [b""] * self.size
        for s, i in ids.items():
            tokens[i] = bytes(of[c] for c in s)
        for s, i in self.special.items():
            tokens[i] = s.encode()
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.token_length[ids]
        at = np.repeat(self.token_start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.token_bytes[at].tobytes()


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and each word's number of ids."""
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum())
    symbol = vocabulary.first[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(lengths)
    # neighbours by position; n stands for none (its symbol never ranks)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[lengths > 0] - 1] = n
    starts = ends - lengths
    before[starts[lengths > 0]] = n
    symbol = np.append(symbol, -1)
    after, before = np.append(after, n), np.append(before, n)
    alive = np.ones(n + 1, bool)
    alive[n] = False
    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def index(at: np.ndarray) -> None:
        """Enter the pairs that start at these positions."""
        at = at[after[at] < n]
        rank = vocabulary.rank(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            groups = zip(rank[np.append(0, cut)].tolist(), np.split(at, cut), strict=True)
        else:
            groups = [(int(rank[0]), at)]
        for r, some in groups:
            if r in places:
                places[r].append(some)
            else:
                places[r] = [some]
                heapq.heappush(heap, r)

    index(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = places.pop(r)
        at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
        left, right, made = vocabulary.left[r], vocabulary.right[r], vocabulary.made[r]
        at = at[alive[at] & (symbol[at] == left)]
        at = at[symbol[after[at]] == right]
        if left == right and len(at) > 1:
            # in a row of equal symbols every second pair merges, from the left
            chained = np.append(False, after[at[:-1]] == at[1:])
            begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = made
        alive[gone] = False
        follow = after[gone]
        after[at] = follow
        before[follow] = at
        before[n] = n
        ahead = before[at]
        index(np.concatenate([at, ahead[ahead < n]]) if len(at) > 1 or ahead[0] < n else at)
    kept = alive[:n]
    owner = np.repeat(np.arange(len(words)), lengths)
    return symbol[:n][kept], np.bincount(owner[kept], minlength=len(words))


def _explicit_pattern() -> str:
    """``PATTERN`` with its classes spelt out as ranges, for the standard ``re`` module, which is faster."""
    first_plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x20000)]))

    def ranges(pattern: str) -> str:
        codes = np.array([ord(c) for c in regex.findall(pattern, first_plane)])
        cut = np.flatnonzero(np.diff(codes) != 1)
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.append(0, cut + 1)], codes[np.append(cut, len(codes) - 1)], strict=True))

    letter, number, blank = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


class TextEncoder:
    """Ids of whole texts from ids of distinct pre-tokens, which ``encode`` gives for lists of new ones."""

    def __init__(self, special: dict[str, int], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], path: str):
        self.find = re.compile(_explicit_pattern()).findall
        self.unsettled = re.compile(_UNSETTLED).search
        self.path, self.library = path, None
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.encode = encode
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.new: list[str] = []
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _cut_by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _places(self, text: str) -> np.ndarray:
        words = self.find(text) if text.isascii() or not self.unsettled(text) else self._cut_by_library(text)
        got = list(map(self.place.get, words))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    w = words[k]
                    if (x := self.place.get(w)) is None:
                        x = self.place[w] = len(self.place)
                        self.new.append(w)
                    got[k] = x
        return np.array(got, np.int32)

    def places(self, text: str) -> np.ndarray:
        """The text's pre-tokens by number; a special token is its id, from -1 downwards."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._places(text)
        parts = self.cut(text)
        return np.concatenate([np.array([-1 - self.special[p]], np.int32) if k % 2 else self._places(p) for k, p in enumerate(parts)])

    def settle(self) -> None:
        """Encode what is new."""
        if self.new:
            ids, count = self.encode(self.new)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.new = []

    def of(self, places: np.ndarray) -> np.ndarray:
        special = np.flatnonzero(places < 0)
        if not len(special):
            count = self.count[places]
            at = np.repeat(self.start[places] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            return self.ids[at].astype(np.uint32)
        parts, last = [], 0
        for k in special:
            parts += [self.of(places[last:k]), np.array([-1 - places[k]], np.uint32)]
            last = k + 1
        return np.concatenate([*parts, self.of(places[last:])])

    def stream(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Batches with the ids of each row's text, in blocks whose new pre-tokens are settled together."""
        for batch in batches:
            texts = batch.column(column)
            held: list[np.ndarray] = []
            size, first = 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                held.append(self.places(text))
                size += len(text)
                if size >= BLOCK_CHARS:
                    self.settle()
                    yield batch.slice(first, i + 1 - first), [self.of(p) for p in held]
                    held, size, first = [], 0, i + 1
                    if len(self.place) > MEMORY:
                        self.reset()
            self.settle()
            if held:
                yield batch.slice(first), [self.of(p) for p in held]
            if len(self.place) > MEMORY:
                self.reset()


_ENCODERS: dict[tuple[str, str], object] = {}


def pair_index_encoder(path: str) -> tuple[TextEncoder, Vocabulary]:
    """The worker's encoder for a vocabulary file; kept from task to task."""
    if ("own", path) not in _ENCODERS:
        vocabulary = Vocabulary(path)
        _ENCODERS["own", path] = TextEncoder(vocabulary.special, lambda words: encode_words(vocabulary, [w.encode("utf-8", "replace") for w in words]), path), vocabulary
    return _ENCODERS["own", path]


def library_encoder(path: str) -> TextEncoder:
    """The same with the ``tokenizers`` library's ids for each distinct pre-token."""
    if ("library", path) not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            return np.array([x for w in ids for x in w], np.int64), np.array([len(w) for w in ids], np.int64)

        _ENCODERS["library", path] = TextEncoder(special, encode, path)
    return _ENCODERS["library", path]


def encode_documents(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (text from those ids) added."""
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = pair_index_encoder(vocabulary_path)
        for batch, rows in encoder.stream(batches, place):
            text = [vocabulary.decode(x).decode("utf-8", "replace") for x in rows]
            own = [pa.array([x.astype(np.int32) for x in rows], pa.list_(pa.int32())), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, ids, decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {ids} array<int>, {decoded} string")


def encoding_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, as digests made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = pair_index_encoder(vocabulary_path)
        for batch, rows in encoder.stream(batches, 1):
            sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]
            back = [hashlib.sha256(vocabulary.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
