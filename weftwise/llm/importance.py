"""Quality by importance resampling: two hashed n-gram models, their ratio, and a sample by Gumbel top-k.

1. Words and pairs of neighbouring words of whole texts are hashed into ``BUCKETS`` counters: over all
   documents for the raw model, and over the labelled good ones for the target model. The target documents
   are a bounded sample: the ``TARGET_ROWS`` labelled rows of lowest hash; all else counts every document.
   Each task adds up its own counters, so a row a task and used bucket is shuffled, whatever the texts hold.
2. A document's log ratio is the sum over its n-grams of log target - log raw, both smoothed by ``SMOOTHING``
   counts, so that a rare n-gram's sampling error weighs little. An n-gram counts once for each time it occurs.
3. Gumbel noise, a hash of the document's id and text, is added and the highest ``share`` of documents are
   kept: drawing without replacement in proportion to the ratio. The cut is found by counting in four passes
   over 16 bits each of the sortable key (65,536 rows to the driver at most), so nothing is sorted or gathered.

Null and empty texts have no n-grams and a ratio of 0; they are never kept. Ties at the cut go by id and text hash.
Without target rows all ratios are 0. Repeated rows have equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import LOWER, U64, RollingHash, materialise, mix64, row_key, text_chunks, words_of, work_dir

BUCKETS, TARGET_ROWS, SMOOTHING = 1 << 18, 20_000, 8.0


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the text that it is in."""
    low = LOWER[data]
    start, end, first = words_of(low, offsets)
    # a word's closing punctuation is no part of it, unless it is nothing else
    tail = np.isin(low[end - 1], np.frombuffer(b".,;:!?", np.uint8)) & (end - start > 1) if len(end) else np.zeros(0, bool)
    word = mix64(RollingHash(low).of(start, end - tail))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same = owner[1:] == owner[:-1]
    pair = mix64(word[:-1] * U64(0x9FB21C651E98DF25) + word[1:])[same]
    return (np.concatenate([word, pair]) % U64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters of (text, whether it is a target)."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, offsets in text_chunks(batch.column(0)):
            bucket, owner = hashed_ngrams(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = wanted[i:j][owner]
            if own.any():
                target += np.bincount(bucket[own], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of each bucket; of ``target_ids`` (one column), the ``TARGET_ROWS`` of lowest hash count."""
    wanted = lowest_hashes(target_ids.toDF("__id").filter("__id is not null").distinct(), "__id", TARGET_ROWS)
    wanted = F.broadcast(wanted.withColumn("__target", F.lit(True)))
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text")).join(wanted, "__id", "left").select("text", F.coalesce("__target", F.lit(False)).alias("target"))
    counted = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = counted.toPandas()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    # the target is smoothed towards the raw model, so an n-gram it never saw costs more the commoner it is in raw text
    share = (raw + 1e-3) / (raw + 1e-3).sum()
    expected = share * target.sum()
    return np.log((target + SMOOTHING) / (expected + SMOOTHING)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ngrams, log_ratio, gumbel_key, th, sortable) of every row; ``sortable`` is the key as a long of the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                bucket, owner = hashed_ngrams(data, offsets)
                n = np.bincount(owner, minlength=j - i)
                ratio = np.bincount(owner, weights=weights[bucket], minlength=j - i)
                seed = mix64(np.asarray(batch.column(2))[i:j].view(U64) ^ U64(0x5851F42D4C957F2D))
                uniform = ((seed >> U64(11)).astype(np.float64) + 0.5) / 2**53
                key = ratio - np.log(-np.log(uniform)) + 0.0
                # a double's bits in the order of doubles, so that no two keys fall together
                bits = key.view(np.int64)
                sortable = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(ratio), pa.array(key), batch.column(2).slice(i, j - i), pa.array(sortable)],
                    names=["doc_id", "n_ngrams", "log_ratio", "gumbel_key", "th", "sortable"],
                )

    _, th = row_key(docs[id_col], docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), th.alias("th")).mapInArrow(run, "doc_id long, n_ngrams long, log_ratio double, gumbel_key double, th long, sortable long")


def _cut(scored: DataFrame, k: int) -> tuple[int, int]:
    """The sortable key of the k-th highest row, and how many rows of that very key are within the k."""
    prefix, left = 0, k
    unsigned = scored.select(F.col("sortable").bitwiseXOR(F.lit(-(2**63)).cast("long")).alias("u"))
    for shift in (48, 32, 16, 0):
        some = unsigned if shift == 48 else unsigned.filter(F.expr(f"shiftrightunsigned(u, {shift + 16}) = {prefix}"))
        digits = some.groupBy(F.expr(f"cast(shiftrightunsigned(u, {shift}) & 65535 as int)").alias("digit")).count().collect()
        for digit, n in sorted(((r["digit"], r["count"]) for r in digits), reverse=True):
            if n >= left:
                prefix = prefix << 16 | digit
                break
            left -= n
    return prefix - 2**63, left


def resample(docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ngrams, log_ratio, gumbel_key, kept) of every row; ``share`` of the rows with n-grams is kept."""
    weights = fit(docs, target_ids, id_col, text_col)
    scored = score(docs, weights, id_col, text_col)
    scored = materialise(scored, f"{work_dir(docs.sparkSession)}/scored")
    some = scored.filter("n_ngrams > 0")
    k = round(share * some.count())
    if k == 0:
        return scored.select("doc_id", "n_ngrams", "log_ratio", "gumbel_key", F.lit(False).alias("kept"))
    cut, ties = _cut(some.select("sortable"), k)
    at_cut = some.filter(F.col("sortable") == cut).select("doc_id", "th").orderBy("doc_id", "th").limit(ties)
    last = at_cut.groupBy().agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("d"), "th")).alias("m")).first()["m"]
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("d"), F.col("th").alias("th"))
    kept = (F.col("n_ngrams") > 0) & ((F.col("sortable") > cut) | ((F.col("sortable") == cut) & (key <= F.struct(F.lit(last["d"]).alias("d"), F.lit(last["th"]).alias("th")))))
    return scored.select("doc_id", "n_ngrams", "log_ratio", "gumbel_key", F.coalesce(kept, F.lit(False)).alias("kept"))


def good_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of labelled rows of quality 1 and not toxic: those of lowest hash, so ``rows`` at most."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return lowest_hashes(good, "doc_id", rows)


def lowest_hashes(ids: DataFrame, column: str, rows: int) -> DataFrame:
    """A bounded sample of distinct ids that doesn't depend on their order."""
    return ids.orderBy(F.xxhash64(F.col(column).cast("long")), column).limit(rows)
