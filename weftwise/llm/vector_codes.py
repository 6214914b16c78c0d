"""Vector code compression: product quantisation in whole numbers.

Vectors become integers, are cut into parts, and each part is told by its nearest entry of a codebook that a few
rounds of means refine. A round sends the codebooks (a fixed number of entries) to every task; Arrow batches compute
all squared distances by norm expansion, |x|^2 - 2 x.c + |c|^2, in exact 64-bit matrix products; a task adds up
the parts of each entry, so what is shuffled is one row for each task and entry, however many vectors share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import let_workers_import, materialise, work_dir

#: Rows of one matrix product.
STEP = 4096


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every vector without null or non-finite components.

    Components beyond what 64-bit distances of such a vector can hold, sqrt(2**61 / components), are set to that bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2)
            flat, at = vec.values, np.asarray(vec.offsets).astype(np.int64)
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(x)
            if flat.null_count:
                good &= np.asarray(flat.is_valid())
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = np.asarray(vec.is_valid()) & (bad[at[1:]] == bad[at[:-1]])
            size = np.diff(at)
            most = np.array([isqrt((2**61 - 1) // max(1, n)) for n in range(int(size.max(initial=0)) + 1)], np.float64)
            bound = np.zeros(len(x))
            bound[at[0] : at[-1]] = np.repeat(most[size], size)
            with np.errstate(all="ignore"):
                v = np.clip(np.floor(np.where(good, x, 0.0) * scale), -bound, bound).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)).take(pa.array(np.flatnonzero(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(np.flatnonzero(keep))) for k in (0, 1)), v], names=["vec_id", "label", "v"])

    kind = vectors.schema[label_col].dataType.simpleString()
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, f"vec_id long, label {kind}, v array<int>")


def matrices(batches: Iterator[pa.RecordBatch], column: int, dim: int, parts: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of at most ``STEP`` rows with one int64 matrix a part; parts are filled up with zeros."""
    width = -(-dim // parts)
    for whole in batches:
        for i in range(0, whole.num_rows, STEP):
            batch = whole.slice(i, STEP)
            x = np.zeros((batch.num_rows, width * parts), np.int64)
            x[:, :dim] = np.asarray(batch.column(column).flatten()).reshape(-1, dim)
            yield batch, [np.ascontiguousarray(x[:, k * width : (k + 1) * width]) for k in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries of each row, and its squared distance; all exact in int64."""
    d = (book * book).sum(1) - 2 * (x @ book.T)
    code = d.argmin(1)
    return code, (x * x).sum(1) + d[np.arange(len(x)), code]


def entry_sums(vectors: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): number and sum of the parts that are nearest to each entry, those of each task merged."""
    parts, entries, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, xs in matrices(batches, 0, dim, parts):
            for k, x in enumerate(xs):
                code, _ = nearest(x, books[k])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                used = code[order][first]
                n[k, used] += np.diff(first, append=len(code))
                total[k, used] += np.add.reduceat(x[order], first)
        part, entry = np.nonzero(n)
        sums = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), *(pa.array(sums[:, i]) for i in range(width))], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    cut = vectors.select("v").mapInArrow(run, ", ".join(["part int", "entry int", "n long", *(f"s{i} long" for i in range(width))]))
    return cut.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))


def refined(vectors: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """Each entry as the floored mean of its parts; entries without any stay. The driver gets one row an entry."""
    out = books.copy()
    for row in entry_sums(vectors, books, dim).collect():
        out[row[0], row[1]] = np.array(row[3:], np.int64) // row[2]
    return out


def assigned(vectors: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part and the sum of the squared distances."""
    parts, entries, _ = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{entries - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, names = sent.value, np.array([f"{k:0{digits}x}" for k in range(entries)])
        for batch, xs in matrices(batches, 2, dim, parts):
            found = [nearest(x, books[k]) for k, x in enumerate(xs)]
            code = names[found[0][0]]
            for c, _ in found[1:]:
                code = np.char.add(code, names[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long")


def books_digest(books: np.ndarray, dim: int) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between; zeros that fill up the last part aren't in it."""
    parts, _, width = books.shape
    cut = [np.delete(books[k], np.s_[max(0, dim - k * width) :], axis=1) for k in range(parts)]
    return hashlib.sha256(",".join(str(x) for c in cut for x in c.ravel().tolist()).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, code, error, label, label_error, codebooks_sha256) of every vector that is kept, and the final codebooks.

    Vectors that are null or hold null or non-finite components are dropped. The codebooks begin as the parts of the
    smallest ids' vectors (repeated ids: the smaller vector first; null ids last); with fewer vectors they are
    smaller. Repeated rows each have a row. The dimension is that of the smallest id's vector that isn't empty; a
    vector of another length can't be told by these codebooks: its code and errors are null and it counts in none.
    Dimensions that ``parts`` doesn't divide are filled up with zeros. Other columns are left out; without any vector
    the result is empty and there are no codebooks.
    """
    spark = vectors.sparkSession
    let_workers_import(spark)
    work = work_dir(spark)
    kept = materialise(whole_vectors(vectors, id_col, vector_col, label_col, scale), f"{work}/kept")
    by_id = [F.col("vec_id").asc_nulls_last(), "v"]
    head = kept.filter("size(v) > 0").orderBy(*by_id).select("v").first()
    if head is None:
        none = lambda kind: F.lit(None).cast(kind)
        return kept.select("vec_id", none("string").alias("code"), none("long").alias("error"), "label", none("long").alias("label_error"), none("string").alias("codebooks_sha256")), None
    dim = len(head["v"])
    width, fits = -(-dim // parts), F.size("v") == dim
    start = np.array([r["v"] for r in kept.filter(fits).orderBy(*by_id).limit(entries).select("v").collect()], np.int64)
    books = np.zeros((parts, len(start), width), np.int64)
    for k in range(parts):
        own = start[:, k * width : (k + 1) * width]
        books[k, :, : own.shape[1]] = own
    for _ in range(rounds):
        books = refined(kept.filter(fits), books, dim)
    coded = assigned(kept.filter(fits), books, dim)
    odd = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialise(coded.unionByName(odd), f"{work}/coded")
    # a label's sum is kept within a long; the table of labels is written, so Spark knows its size
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    labels = materialise(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), f"{work}/labels")
    joined = coded.join(labels, coded["label"].eqNullSafe(labels["of"]))
    label_error = F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error")
    return joined.select("vec_id", "code", "error", "label", label_error, F.when(F.col("code").isNotNull(), F.lit(books_digest(books, dim))).alias("codebooks_sha256")), books
