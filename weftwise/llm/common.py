"""Helpers shared by the training-data operators: shared work folder, Arrow text buffers, hashing.

All hashing here is 64-bit and vectorised with numpy over the contiguous byte buffers that Arrow
hands to a Python worker, so no operator loops over characters or words in Python.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy step works on; small enough to stay in the processor's caches.
CHUNK_BYTES = 1 << 20


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, if it is there on their node."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep) if env.get("PYTHONPATH") else []
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares (``spark.checkpoint.dir``); it goes when the session's JVM ends.

    Only where that setting is unset and all runs in one process (tests, local mode) a temporary local folder is taken.
    """
    let_workers_import(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="weftwise-")
        spark.sparkContext.setCheckpointDir(base)
    work = f"{base.rstrip('/')}/weftwise-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(work)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return work


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While this is open, Spark deletes the shuffle files of each query as soon as its result is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (extra columns may clash with ours)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two longs that name a document row; repeated rows share it, and a null id has one of its own."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long")), F.xxhash64(doc_id, text)


# ---------------------------------------------------------------- Arrow buffers


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over whole texts, about ``max_bytes`` at a time; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not n:
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first ``keys`` columns, cut only where a group ends (or grows beyond ``most`` rows)."""

    def last(batch: pa.RecordBatch) -> int:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in range(keys):
            x = np.asarray(batch.column(k))
            new[1:] |= x[1:] != x[:-1]
        return int(np.flatnonzero(new)[-1])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = last(batch)
        if held and not cut and all(held[-1].column(k)[0] == batch.column(k)[0] for k in range(keys)):
            held.append(batch)
            if most and sum(x.num_rows for x in held) >= most:
                yield pa.concat_batches(held)
                held = []
            continue
        held.append(batch.slice(0, cut))
        whole = pa.concat_batches(held)
        if whole.num_rows:
            yield whole
        held = [batch.slice(cut)]
    if held:
        yield pa.concat_batches(held)


# ---------------------------------------------------------------- hashing

#: A prime; remainders and their products fit 64 bits. Two bases give hashes of 62 bits.
_PRIME = (1 << 31) - 1
_BASES = (1_203_554_417, 1_790_268_731)
#: Bytes count from 1, so that zeros count. Sums of so many products with a remainder stay below 2**63.
_BYTE_CODE = np.arange(1, 257, dtype=np.uint64)
_SUMMED = 1 << 23
#: Numbers that are worked on at a time; small enough for the processor's caches.
_STRIDE = 1 << 14


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` in place as a smaller number of the same remainder: below 2**32 for numbers below 2**62."""
    high = x >> U64(31)
    x &= U64(_PRIME)
    x += high
    return x


def _remainder(x: np.ndarray) -> np.ndarray:
    """``x``, below 2**63, in place modulo the prime."""
    x = _folded(_folded(x))
    x -= U64(_PRIME) * (x >= U64(_PRIME))
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 64)
        known = np.empty(size, np.uint32)
        known[0], m = 1, 1
        while m < size:
            c = min(m, size - m)
            known[m : m + c] = _remainder(known[:c] * U64(pow(base, m, _PRIME)))
            m *= 2
        _POWERS[base] = known
    return known[:n]


class RollingHash:
    """Hash of any byte range of a buffer in constant time, equal for equal bytes wherever they stand.

    A polynomial over a prime field, with two bases: unlike one modulo a power of two it has no texts (such as
    Thue and Morse's) that meet under every base.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.parts = [(np.empty(n + 1, U64), _powers(base, n), _powers(pow(base, -1, _PRIME), n + 1)) for base in _BASES]
        for total, _, _ in self.parts:
            total[0] = 0
        for i in range(0, n, _STRIDE):
            code = _BYTE_CODE[data[i : i + _STRIDE]]
            for total, power, _ in self.parts:
                term = code * power[i : i + _STRIDE]
                part = np.cumsum(term if n < _SUMMED else _remainder(term), out=total[i + 1 : i + 1 + len(code)])
                part += total[i]

    @staticmethod
    def _of(low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> np.ndarray:
        d = _folded(_folded(high - low))
        d *= shift
        return _remainder(d)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (self._of(total[start], total[end], shift[start]) for total, _, shift in self.parts)
        return one << U64(31) | two

    def every(self, k: int) -> np.ndarray:
        """The hash of the ``k`` bytes at each start."""
        n = len(self.parts[0][0]) - k
        out = np.empty(max(0, n), U64)
        for i in range(0, n, _STRIDE):
            j = min(n, i + _STRIDE)
            one, two = (self._of(total[i:j], total[i + k : j + k], shift[i:j]) for total, _, shift in self.parts)
            one <<= U64(31)
            np.bitwise_or(one, two, out=out[i:j])
        return out


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of anything but ASCII blanks) and each text's first word's index."""
    edge = np.empty(len(data) + 1, bool)
    blank = _BLANK[data]
    inner = ~blank
    edge[:-1] = inner
    edge[-1] = False
    begin = inner.copy()
    begin[1:] &= blank[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inner[heads]
    start = np.flatnonzero(begin)
    stop = edge[1:].copy()
    np.logical_not(stop, out=stop)
    if len(heads):
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stop[tails] = True
    stop &= inner
    end = np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)
