"""MinHash near-dedup by an LSH forest, with every link confirmed on the full shingle sets.

Documents link when their sets of 5-word shingles have a Jaccard likeness of ``percent`` or more; the
result is each document's component in the graph of links.

1. One pass over the texts makes, per document, the size of its set, a 128-bit hash of the set, and 64
   MinHash values. Equal sets (copies) become one class here, so a group of copies is one row from now on.
2. The forest: each of ``TREES`` trees sorts the classes by its own sequence of MinHash values: three whole
   ones (a region), then sixteen by 4 bits each. The trees are one table, range-partitioned and sorted, so a
   crowded region spreads over as many partitions as it needs. Rows next to each other have the longest common
   prefixes and are candidates. Depth adapts: where more than ``LEAF`` rows share a prefix it grows by a value
   at a time until fewer do, and the rows of such a leaf are candidates of one another, and each of the first
   row of its region and of the crowded prefix above its leaf. Work and candidates are linear in the rows.
3. A packed sketch of the values travels with each row; it drops candidates far below the threshold, and in
   each tree names a row's likeliest. The others are left to step 5.
4. Confirmation: the texts of classes with candidates are set aside once; the likeliest candidates of each
   class are confirmed first, then only those that would join different components, until none is left.
5. The rest: regions whose rows are still in different components are compared in full, in blocks of
   ``BLOCK`` rows: signatures rule pairs out, whole sets decide on the others, in the same task, which gives
   only the links that join components. Each pair is looked at in the first region that it shares. This is
   square in the rows of such a region, and only there. A region of n rows is dealt in pairs of blocks, so each
   of its rows (with its signature; its text only where it has a likely partner) goes to n / ``BLOCK`` of them:
   to one up to that size, and beyond it the shuffle is square as well. What is given out is linear in its rows.

A pair at the threshold shares a region in at least one tree with probability 1 - (1 - 0.75**3)**20, over
0.9999. Nulls: a null or blank text has an empty set and is linked with nothing; a document without an id
is never linked and is kept. Rows are judged by their own text: repeated rows share set and component, rows
that share an id but not a text are nodes of their own. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import LOWER, U64, RollingHash, drop_path, materialise, mix64, row_key, text_chunks, whole_groups, words_of, work_dir
from weftwise.llm.components import connected_components

SIZE = 64
TREES, DEPTH = 20, 3
#: Rows that may share a prefix before it grows, and rows before it that every row is compared with.
LEAF, ADJACENT = 6, 2
#: Rows and shingles of a region's block that are compared with one another at a time.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
#: Parts of so many rows are compared many at a time.
SMALL = 32
#: Rows of a region that a task sorts at a time.
HELD = 1 << 20
#: A signature of SIZE values has a standard deviation of 0.054 at the threshold; 4.6 of these below it.
LEAST_ESTIMATE = 0.5
_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64) * U64(2)
_MUL = _RNG.integers(0, 2**62, SIZE, dtype=np.uint64) * U64(2) + U64(1)
#: Tree t's first values are its own; the deeper ones are drawn from all.
_DEEP = [_RNG.permutation([c for c in range(SIZE) if not DEPTH * t <= c < DEPTH * (t + 1)])[:16] for t in range(TREES)]
_FOLD = U64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the offsets of each text's set."""
    low = LOWER[data]
    start, end, first = words_of(low, offsets)
    word = mix64(RollingHash(low).of(start, end) ^ (end - start).astype(U64))
    counts = np.diff(first)
    texts = len(counts)
    long_ = np.maximum(counts - width + 1, 0)
    begin = np.repeat(first[:-1], long_) + np.arange(long_.sum()) - np.repeat(np.cumsum(long_) - long_, long_)
    hashes = np.zeros(len(begin), U64)
    for j in range(width):
        hashes = hashes * _FOLD + word[begin + j]
    owner = np.repeat(np.arange(texts), long_)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        own = np.zeros(len(few), U64)
        for j in range(width - 1):
            has = counts[few] > j
            own[has] = own[has] * _FOLD + word[first[few[has]] + j]
        hashes = np.concatenate([hashes, own ^ (counts[few].astype(U64) << U64(40))])
        owner = np.concatenate([owner, few])
    hashes = mix64(hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def _signatures(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                sets, at = shingles(data, offsets, width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                values = np.zeros((j - i, SIZE), np.uint32)
                one, two = np.zeros(j - i, U64), np.zeros(j - i, U64)
                if len(full):
                    heads = at[full]
                    one[full] = np.add.reduceat(mix64(sets ^ U64(0x51ED270B)), heads)
                    two[full] = np.add.reduceat(mix64(sets ^ U64(0xC2B2AE3D27D4EB4F)), heads)
                    for c in range(SIZE):
                        values[full, c] = np.minimum.reduceat((sets ^ _XOR[c]) * _MUL[c], heads) >> U64(32)
                flat = pa.Array.from_buffers(pa.binary(4 * SIZE), j - i, [None, pa.py_buffer(values.tobytes())])
                keys = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), flat.cast(pa.binary())], names=["doc_id", "th", "n_shingles", "f1", "f2", "sig"])

    return sign


def _folded(values: np.ndarray, columns) -> np.ndarray:
    h = np.zeros(len(values), U64)
    for c in columns:
        h = mix64(h * _FOLD + values[:, c].astype(U64) + U64(1))
    return h


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SIZE)


def _region(values: np.ndarray, tree: int) -> np.ndarray:
    return mix64(_folded(values, range(DEPTH * tree, DEPTH * (tree + 1))) + U64(tree))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a tree: region, the order within it (16 values by 4 bits), class, sketch."""
    shift = (np.arange(15, -1, -1, dtype=U64)) * U64(4)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = _values(batch.column(1))
        nibble = (values & 15).astype(U64)
        sketch = (nibble.reshape(n, 4, 16) << shift[::-1]).sum(axis=2, dtype=U64).view(np.int64)
        flat = [pa.array(sketch[:, k]) for k in range(4)]
        for t in range(TREES):
            deep = (nibble[:, _DEEP[t]] << shift).sum(axis=1, dtype=U64)
            yield pa.RecordBatch.from_arrays([pa.array(_region(values, t).view(np.int64)), pa.array(deep.view(np.int64)), batch.column(0), *flat], names=["region", "deep", "c", "s0", "s1", "s2", "s3"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a tree: region, and all columns but the signature, which is the first."""
    for batch in batches:
        if batch.num_rows:
            values = _values(batch.column(0))
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(_region(values, t).view(np.int64)), *batch.columns[1:]], names=["region", *batch.schema.names[1:]])


def _estimate(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Likeness from two sketches of 4 words: equal nibbles, less those equal by chance."""
    same = np.zeros(len(p), np.int64)
    ones = U64(0x1111111111111111)
    for k in range(4):
        x = p[:, k] ^ q[:, k]
        x |= x >> U64(2)
        x |= x >> U64(1)
        same += 16 - np.bitwise_count(x & ones).astype(np.int64)
    return ((same / SIZE - 1 / 16) / (15 / 16)).astype(np.float32)


def _leaves(region: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order: the first row of each one's region, of its leaf, and of the crowded prefix above that leaf."""
    n = len(region)
    differs = (deep[1:] ^ deep[:-1]).view(U64)
    # the values in common with the row before, by the leading zeros of the difference
    common = np.full(n, -1)
    common[1:] = 16 - sum(((differs >> U64(4 * k)) != 0).astype(np.int64) for k in range(16))
    common[1:][region[1:] != region[:-1]] = -1
    at, leaf = np.arange(n), np.full(n, -1)
    first = above = np.maximum.accumulate(np.where(common < 0, at, 0))
    for depth in range(17):
        heads = np.flatnonzero(common < depth)
        sizes = np.diff(np.append(heads, n))
        head = np.repeat(heads, sizes)
        small = np.repeat(sizes <= LEAF, sizes)
        leaf = np.where((leaf < 0) & (small | (depth == 16)), head, leaf)
        above = np.where(leaf < 0, head, above)
        if small.all():
            break
    return first, leaf, above


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's likeliest candidate, from rows sorted by region and order; a region of over ``HELD`` rows is taken in parts."""
    for batch in whole_groups(batches, 1, HELD):
        region, deep, c = (np.asarray(batch.column(k)) for k in range(3))
        s = np.stack([np.asarray(batch.column(k)).view(U64) for k in range(3, 7)], axis=1)
        first, leaf, above = _leaves(region, deep)
        at = np.arange(len(c))
        best, other = np.zeros(len(c), np.float32), at.copy()
        for before in (first, above, *(np.where(at - lag >= (first if lag <= ADJACENT else leaf), at - lag, at) for lag in range(1, LEAF))):
            i = np.flatnonzero(before != at)
            likely = _estimate(s[before[i]], s[i])
            better = likely > best[i]
            best[i[better]], other[i[better]] = likely[better], before[i[better]]
        i = np.flatnonzero(best >= LEAST_ESTIMATE)
        a, b = c[other[i]], c[i]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(best[i])], names=["a", "b", "likely"])


def _confirm(percent: int, width: int):
    """(a, b, text of a, text of b) to (a, b, whether they link), on the whole sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 200
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                sides = []
                for c in (2, 3):
                    hashes, owners = [], []
                    for i, j, data, offsets in text_chunks(part.column(c)):
                        h, at = shingles(data, offsets, width)
                        hashes.append(h)
                        owners.append(np.repeat(np.arange(i, j), np.diff(at)))
                    sides.append((np.concatenate(hashes), np.concatenate(owners)))
                n = part.num_rows
                h, w = (np.concatenate([sides[0][x], sides[1][x]]) for x in (0, 1))
                o = np.lexsort((h, w))
                h, w = h[o], w[o]
                shared = np.bincount(w[1:][(h[1:] == h[:-1]) & (w[1:] == w[:-1])], minlength=n)
                union = np.bincount(w, minlength=n) - shared
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((100 * shared >= percent * union) & (shared > 0))], names=["a", "b", "linked"])

    return confirm


class _Block:
    """Rows of one part (region, p, q): those of block p with those of block q, or of one block with one another."""

    def __init__(self, region: int, p: int, q: int, own: np.ndarray, label: np.ndarray, size: np.ndarray, values: np.ndarray, percent: int):
        self.same, self.own, self.p, self.label, self.size, self.values, self.percent = p == q, own, p, label.copy(), size, values, percent
        regions = [int(_region(values[:1], t).view(np.int64)[0]) for t in range(TREES)]
        self.tree = regions.index(region)
        self.at = np.arange(len(own))
        # rows of the commonest label are not compared with one another
        names, counts = np.unique(label, return_counts=True)
        self.common = label == names[counts.argmax()]

    def asking(self) -> np.ndarray:
        return self.at[~self.common]

    def likely(self, i: int) -> np.ndarray:
        """The rows that row i may link with, across labels; each pair comes up once in the part and in one region only."""
        ok = self.label != self.label[i]
        if self.same:
            ok &= self.common | (self.at > i)
        else:
            ok &= self.own != self.p if self.own[i] == self.p else self.common & (self.own == self.p)
        ok &= 100 * np.minimum(self.size, self.size[i]) >= self.percent * np.maximum(self.size, self.size[i])
        j = np.flatnonzero(ok)
        if not len(j):
            return j
        equal = self.values[j] == self.values[i]
        j, equal = j[near := equal.sum(axis=1) >= LEAST_ESTIMATE * SIZE], equal[near]
        earlier = equal[:, : DEPTH * self.tree].reshape(len(j), self.tree, DEPTH).all(axis=2).any(axis=1)
        return j[~earlier]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """Where the parts of sorted rows begin, and the end."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in range(3):
        x = np.asarray(batch.column(k))
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _parts(batch: pa.RecordBatch, percent: int, beyond: int = 0) -> Iterator[tuple[int, int, _Block]]:
    """The parts with several labels; of those of one block only such of over ``beyond`` rows."""
    region, p, q, own, label, size = (np.asarray(batch.column(k)) for k in (0, 1, 2, 3, 5, 6))
    values, edge = _values(batch.column(7)), _edges(batch)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        part = slice(lo, hi)
        if (hi - lo > beyond or p[lo] != q[lo]) and (label[part] != label[lo]).any():
            yield lo, hi, _Block(int(region[lo]), int(p[lo]), int(q[lo]), own[part], label[part], size[part], values[part], percent)


def _small_pairs(batch: pa.RecordBatch, percent: int, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_Block.likely`` for all parts of one block with at most ``SMALL`` rows at once, as pairs of rows."""
    region, label, size = (np.asarray(batch.column(k)) for k in (0, 5, 6))
    values, counts = _values(batch.column(7)), np.diff(edge)
    small = (counts <= SMALL) & (np.asarray(batch.column(1))[edge[:-1]] == np.asarray(batch.column(2))[edge[:-1]])
    heads = edge[:-1][small]
    tree = np.zeros(len(values), np.int64)
    for t in range(TREES):
        tree[heads[_region(values[heads], t).view(np.int64) == region[heads]]] = t
    at = np.flatnonzero(np.repeat(small, counts))
    end, tree = np.repeat(edge[1:], counts), np.repeat(tree[edge[:-1]], counts)
    own = np.arange(TREES)
    for lag in range(1, int(counts[small].max(initial=1))):
        at = at[at + lag < end[at]]
        for k in range(0, len(at), 1 << 16):
            i = at[k : k + (1 << 16)]
            j = i + lag
            ok = (label[i] != label[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            equal = values[i] == values[j]
            shared = equal[:, : DEPTH * TREES].reshape(len(i), TREES, DEPTH).all(axis=2)
            ok = (equal.sum(axis=1) >= LEAST_ESTIMATE * SIZE) & ~(shared & (own < tree[i][:, None])).any(axis=1)
            yield i[ok], j[ok]


def _asked(percent: int):
    """The rows of each part that have a likely partner in it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            wanted = np.zeros(batch.num_rows, bool)
            for i, j in _small_pairs(batch, percent, _edges(batch)):
                wanted[i] = wanted[j] = True
            for lo, hi, block in _parts(batch, percent, SMALL):
                own = wanted[lo:hi]
                for i in block.asking().tolist():
                    if len(j := block.likely(i)):
                        own[i] = own[j] = True
            yield batch.filter(pa.array(wanted))

    return ask


def _linked(percent: int, width: int):
    """The links of each part that join different labels, on whole sets; each text's set is made once a part."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            c, a, b = np.asarray(batch.column(4)), [], []
            for lo, hi, block in _parts(batch, percent):
                made = [shingles(data, offsets, width) for _, _, data, offsets in text_chunks(batch.column(8).slice(lo, hi - lo))]
                size = np.concatenate([np.diff(x[1]) for x in made])
                at = np.append(0, np.cumsum(size))
                names, flat = np.unique(np.concatenate([x[0] for x in made]), return_inverse=True)
                has = np.zeros(len(names), bool)
                for i in block.asking().tolist():
                    j = block.likely(i)
                    if not len(j):
                        continue
                    mine = flat[at[i] : at[i + 1]]
                    has[mine] = True
                    begin = np.cumsum(size[j]) - size[j]
                    place = np.repeat(at[j] - begin, size[j]) + np.arange(size[j].sum())
                    shared = np.add.reduceat(has[flat[place]].astype(np.int64), begin)
                    has[mine] = False
                    for k in j[(shared > 0) & (100 * shared >= percent * (size[i] + size[j] - shared))].tolist():
                        if block.label[k] != block.label[i]:
                            a.append(c[lo + i])
                            b.append(c[lo + k])
                            block.join(i, k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


PART = "region long, p long, q long, own long, c long, label long, size long, sig binary"


def _rest_of_regions(classes: DataFrame, labels: DataFrame, plain: DataFrame, percent: int, width: int, work: str) -> DataFrame:
    """The links (a, b) that join components which share a region of a tree."""
    known = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("sig", "c", F.coalesce("label", "c").alias("label"), F.col("n_shingles").alias("size"))
    known = materialise(known, f"{work}/known")
    rows = known.mapInArrow(_regions, "region long, c long, label long, size long")
    mixed = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    mixed = materialise(mixed.select("region", blocks.alias("blocks")), f"{work}/mixed")
    inside = known.select("sig", "c").mapInArrow(_regions, "region long, c long").join(mixed.hint("merge"), "region")
    inside = inside.withColumn("own", F.pmod(F.xxhash64("c"), "blocks")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    inside = inside.select("region", F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), "own", "c").join(known.hint("merge"), "c")
    dealt = lambda df: df.repartition("region", "p", "q").sortWithinPartitions("region", "p", "q")
    names = [c.split()[0] for c in PART.split(", ")]
    asked = materialise(dealt(inside.select(names)).mapInArrow(_asked(percent), PART), f"{work}/asked")
    texts = _texts(classes, plain, asked.select("c").distinct())
    return materialise(dealt(asked.join(texts.hint("merge"), "c").select(*names, "text")).mapInArrow(_linked(percent, width), "a long, b long"), f"{work}/links")


def _texts(classes: DataFrame, plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, text) of the classes ``wanted`` (c): one text of each. They grow with the corpus, so they are never broadcast."""
    keys = classes.select("c", "doc_id", "th").join(wanted.hint("merge"), "c")
    return plain.join(keys.hint("merge"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("c", "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, stays) for every row of ``docs``; see the module's text.

    ``kept`` is doc_id = component_id. ``stays`` is true on one row of each component, or on its repeated rows:
    that of the lowest id and, of several texts with that id, the lowest ``text_hash`` (xxhash64 of id and text).
    """
    spark, work = docs.sparkSession, work_dir(docs.sparkSession)
    _, th = row_key(docs[id_col], docs[text_col])
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), th.alias("th"), docs[text_col].alias("text"))
    signed = materialise(plain.mapInArrow(_signatures(width), "doc_id long, th long, n_shingles long, f1 long, f2 long, sig binary"), f"{work}/signed")
    plain = plain.filter("doc_id is not null")
    # one number a class; it holds once the table is written
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = materialise(classes.select("f1", "f2", F.monotonically_increasing_id().alias("c"), "one.doc_id", "one.th", "sig", "n_shingles"), f"{work}/classes")
    forest = classes.select("c", "sig").mapInArrow(_trees, "region long, deep long, c long, s0 long, s1 long, s2 long, s3 long")
    ordered = forest.repartitionByRange("region", "deep", "c").sortWithinPartitions("region", "deep", "c")
    found = ordered.mapInArrow(_neighbours, "a long, b long, likely float").groupBy("a", "b").agg(F.max("likely").alias("likely"))
    pairs = materialise(found, f"{work}/pairs")
    nodes = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    texts = materialise(_texts(classes, plain, nodes), f"{work}/texts")
    both = pairs.union(pairs.select("b", "a", "likely"))
    best = both.groupBy("a").agg(F.max(F.struct("likely", "b")).alias("x"), F.min(F.when(F.col("likely") >= percent / 100, F.col("b"))).alias("y"))
    best = best.select("a", F.explode(F.array("x.b", "y")).alias("b")).filter("b is not null")
    ask = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels, links, tested, k = None, None, None, 0
    while True:
        k += 1
        ta, tb = texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
        answer = ask.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(percent, width), "a long, b long, linked boolean")
        answer = materialise(answer, f"{work}/tested{k}")
        tested = answer if tested is None else tested.union(answer)
        links = tested.filter("linked").select("a", "b")
        labels = connected_components(links, f"{work}/components{k}")
        rest = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        for side in "ab":
            rest = rest.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
        rest = rest.select("a", "b", "likely", *[F.coalesce(f"l{x}", x).alias(f"l{x}") for x in "ab"]).filter("la != lb")
        rest = materialise(rest, f"{work}/rest{k}")
        if rest.isEmpty():
            break
        if k == 1:  # the likeliest between any two components first: it often settles the others
            top = rest.groupBy(F.least("la", "lb").alias("p"), F.greatest("la", "lb").alias("q")).agg(F.max(F.struct("likely", "a", "b")).alias("x"))
            ask = top.select("x.a", "x.b")
        else:
            ask = rest.select("a", "b")
    drop_path(spark, f"{work}/texts")
    more = _rest_of_regions(classes, labels, plain, percent, width, f"{work}/regions")
    if not more.isEmpty():
        labels = connected_components(links.union(more), f"{work}/components{k + 1}")
    for name in ("pairs", "regions", *(f"{x}{i}" for x in ("tested", "rest") for i in range(1, k + 1))):
        drop_path(spark, f"{work}/{name}")
    # the row that stands for each class's component
    one = classes.select("c", F.struct("doc_id", "th").alias("one"))
    members = labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
    first = members.join(one.withColumnRenamed("c", "node"), "node").groupBy("label").agg(F.min("one").alias("one"))
    first = members.join(first, "label").select(F.col("node").alias("c"), F.col("one").alias("first"))
    known = classes.select("f1", "f2", "c", F.struct("doc_id", "th").alias("one")).join(first, "c", "left").select("f1", "f2", F.coalesce("first", "one").alias("first"))
    # an empty set's hash is no class's, and a document without an id stands alone
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = signed.select("doc_id", "th", "n_shingles", "f1", "f2").join(known, ["f1", "f2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.col("th").alias("text_hash"), (alone | F.struct("doc_id", "th").eqNullSafe(F.col("first"))).alias("stays"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "stays")
