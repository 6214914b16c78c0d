"""Document fingerprints by a randomised edit embedding.

Every text is walked by the same random walk: at step j the walk stands on a character, writes a hash of it
and moves on or stays by a random bit that depends on j and the character only. Two texts that differ by a few
edits fall back into step soon after each edit, so the Hamming distance of what they write follows their edit
distance. A fingerprint samples ``BINS`` positions of the written string: in each bin the position of lowest
priority that the walk reached, which is the same position for texts of about equal length (consistent
sampling), so the share of equal samples estimates the likeness. Bands of samples give candidates, and the
full fingerprint verifies them.

The walks of many texts go in lockstep in numpy, longest first; a step costs a few vector operations, and
finished texts drop out. Whole texts are walked. Null is empty; empty texts are alike. Equal texts have equal
fingerprints. Repeated rows each have a successor of their own; an id that is null sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import materialise, mix64, whole_groups, work_dir
from weftwise.llm.components import connected_components

BINS = 128
#: Sampled positions in a band.
BAND = 4
#: Classes of a band that are compared with one another at a time.
BLOCK = 4096
#: Characters that walk together.
STEP_CHARS = 4_000_000
_COMPACT = 256


def _odd(j: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class _Walk:
    """The shared random walk: per step a multiplier, and where samples are taken."""

    def __init__(self) -> None:
        self.size = 0

    def reach(self, steps: int) -> None:
        if steps <= self.size:
            return
        self.size = max(steps, 2 * self.size, 1 << 14)
        j = np.arange(self.size)
        self.move = _odd(j, 1)
        write = _odd(j, 2)
        bin_ = (mix64(j.astype(np.uint64) + np.uint64(3)) % np.uint64(BINS)).astype(np.int64)
        priority = mix64(j.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))
        order = np.lexsort((j, bin_))
        best = priority[order].copy()
        head = np.flatnonzero(np.append(True, bin_[order][1:] != bin_[order][:-1]))
        for a, b in zip(head, np.append(head[1:], self.size), strict=True):
            best[a:b] = np.minimum.accumulate(best[a:b])
        record = order[best == priority[order]]
        self.sample: dict[int, tuple[int, np.uint32]] = {int(k): (int(bin_[k]), write[k]) for k in record}


_WALK = _Walk()


def _walked(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Samples of the texts that begin at ``start`` in ``codes``, each one closed by a zero."""
    n = len(start)
    out = np.zeros((n, BINS), np.uint8)
    at, who = start.copy(), np.arange(n)
    shift, high = np.uint32(31), np.uint32(24)
    j = 0
    while len(at):
        _WALK.reach(j + _COMPACT)
        move, sample = _WALK.move, _WALK.sample
        for k in range(j, j + _COMPACT):
            c = codes[at]
            if k in sample:
                b, odd = sample[k]
                on = c != 0
                out[who[on], b] = ((c[on] * odd) >> high) | np.uint32(1)
            at += (c * move[k]) >> shift
        j += _COMPACT
        on = codes[at] != 0
        at, who = at[on], who[on]
    return out


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """A row of ``BINS`` samples for each text; 0 where the walk took none."""
    out = np.zeros((len(texts), BINS), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        j, size = i, 0
        while j < len(order) and (j == i or size + lengths[order[j]] <= STEP_CHARS):
            size += int(lengths[order[j]]) + 1
            j += 1
        some = order[i:j]
        points = np.frombuffer("\0".join([*(texts[k] for k in some), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = (mix64(points.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        ends = np.cumsum(lengths[some] + 1)
        codes[ends - 1] = 0
        out[some] = _walked(codes, ends - lengths[some] - 1)
        i = j
    return out


def likeness(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The share of equal samples among those that either fingerprint has; 1 for two empty texts."""
    some = (p != 0) | (q != 0)
    n = some.sum(axis=1)
    return np.where(n == 0, 1.0, ((p == q) & some).sum(axis=1) / np.maximum(n, 1))


def _bands(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p.reshape(len(p), -1, BAND) == q.reshape(len(q), -1, BAND)).all(axis=2).sum(axis=1)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the samples in hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprint_texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes().hex() for p in prints], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, fingerprint string")


def _linked(least: float):
    """Rows of parts (band, p, q, own, c, fingerprint) to the links that join them; pairs that are joined already are skipped."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            band, p, q, own, c = (np.asarray(batch.column(k)) for k in range(5))
            prints = np.frombuffer(bytes.fromhex("".join(batch.column(5).to_pylist())), np.uint8).reshape(-1, BINS)
            new = np.ones(len(c), bool)
            new[1:] = (band[1:] != band[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            edge = np.append(np.flatnonzero(new), len(c)).tolist()
            a, b = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                label, rows = np.arange(lo, hi), np.arange(lo, hi)
                for i in (rows if p[lo] == q[lo] else rows[own[lo:hi] == p[lo]]).tolist():
                    j = rows[(label != label[i - lo]) & ((rows > i) if p[lo] == q[lo] else (own[lo:hi] != p[lo]))]
                    for k in j[likeness(prints[j], prints[i : i + 1]) >= least].tolist():
                        if label[k - lo] != label[i - lo]:
                            a.append(c[i])
                            b.append(c[k])
                            label[label == label[k - lo]] = label[i - lo]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def near_groups(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, group_id): the smallest id reachable over fingerprints of ``least`` likeness that share a band.

    ``prints`` is what ``fingerprint_documents`` gives. Equal fingerprints are one class from the start. The classes
    of a band are compared in parts of ``BLOCK``, within a task, which gives links only; a band without samples names
    none. Two texts of ``least`` 0.8 share one of the bands but in one case in ten million. Ids that are null go.
    """
    work = work_dir(prints.sparkSession)
    prints = prints.filter("doc_id is not null").select("doc_id", "fingerprint")
    classes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("c")), f"{work}/classes")
    width = 2 * BAND
    cut = F.transform(F.sequence(F.lit(0), F.lit(BINS // BAND - 1)), lambda k: F.struct(k.alias("k"), F.substr("fingerprint", (k * width + 1).cast("int"), F.lit(width)).alias("x")))
    bands = F.transform(F.filter(cut, lambda y: y["x"] != "0" * width), lambda y: F.xxhash64(y["k"], y["x"]))
    rows = classes.select("c", F.explode(bands).alias("band"))
    shared = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "blocks")
    inside = rows.join(materialise(shared, f"{work}/bands").hint("merge"), "band")
    inside = inside.withColumn("own", F.pmod(F.xxhash64("c"), "blocks")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    inside = inside.select("band", F.least("own", "k").alias("p"), F.greatest("own", "k").alias("q"), "own", "c").join(classes.hint("merge"), "c")
    dealt = inside.select("band", "p", "q", "own", "c", "fingerprint").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    links = materialise(dealt.mapInArrow(_linked(least), "a long, b long").distinct(), f"{work}/links")
    labels = connected_components(links, f"{work}/components")
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("fingerprint", F.coalesce("label", "c").alias("group_id"))
    return prints.join(named, "fingerprint").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_bands long"


def _edited_rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each edited with the text after it."""
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
    prints = fingerprint_texts(texts + edited)
    p, q = prints[: len(edited)], prints[len(texts) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([x.tobytes().hex() for x in p], pa.string()), pa.array([x.tobytes().hex() for x in q], pa.string()), pa.array(likeness(p, q)), pa.array(likeness(p, prints[1 : len(texts)])), pa.array(_bands(p, q)),
        ],
        names=[c.split()[0] for c in ROW.split(", ")],
    )


def _walk_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by id; a task's first and last text are given out too, for the seams between tasks."""
    task = TaskContext.get().partitionId()
    held: tuple | None = None

    def with_seam(rows: pa.RecordBatch | None, seam: str | None, id_: int | None, text: str | None) -> pa.RecordBatch:
        n = rows.num_rows if rows is not None else 1
        names = [c.split()[0] for c in ROW.split(", ")]
        own = rows.columns if rows is not None else [pa.array([id_], pa.int64())] + [pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64())]
        return pa.RecordBatch.from_arrays([*own, pa.array([task] * n, pa.int32()), pa.array([seam] * n, pa.string()), pa.array([text] * n, pa.string())], names=[*names, "task", "seam", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if held is None:
            yield with_seam(None, "first", ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        if len(ids) > 1:
            yield with_seam(_edited_rows(ids, texts), None, None, None)
    if held is not None:
        yield with_seam(None, "last", *held)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its second half replaced by the next document's start, and their likeness."""
    spark = docs.sparkSession
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = materialise(ordered.mapInArrow(_walk_in_order, f"{ROW}, task int, seam string, text string"), f"{work_dir(spark)}/walked")
    tasks = sorted(r["task"] for r in done.filter("seam = 'first'").select("task").collect())  # one row a task
    after = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, follows int")
    last = done.filter("seam = 'last'").select("task", "doc_id", "text")
    first = done.filter("seam = 'first'").select(F.col("task").alias("follows"), F.col("text").alias("next"))
    seams = last.join(after, "task").join(first, "follows").select("doc_id", "text", "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                yield _edited_rows([id_, None], [text, following])

    return done.filter("seam is null").select(*[c.split()[0] for c in ROW.split(", ")]).union(seams.mapInArrow(close, ROW))
