"""Best-fit packing of tokenised documents into sequences of a fixed size.

The plan is made on the histogram of piece lengths, which has ``size`` rows at most whatever the corpus
holds; the pieces themselves are never gathered.

1. Each task tokenises whole texts, appends the separator id, cuts what is longer than a sequence (the
   first piece takes the remainder) and numbers its pieces within each length.
2. From the histogram, the planner fills sequences exactly: for each length, longest first, it looks the
   gap up in indexes of single lengths, of sums of two and of sums of three, as far as the counts allow,
   and consumes as many such combinations as there are. What has no exact complement goes best-fit: to the
   fullest open sequence that still takes it.
3. A piece's number within its length over the whole corpus (its task's offset plus its own number) names
   its slot in the plan. Offsets are sums over one row a task and length; hot lengths need no shuffle of pieces.

Null texts are empty (the separator alone); repeated rows are packed as they come, each on its own, and so are
rows without an id. Which of several pieces of one length takes which slot depends on the tasks' order and has no
meaning. Other columns are not read. An empty table gives no rows; a text of any length is cut into pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwise.llm.bpe import pair_index_encoder
from weftwise.llm.common import materialise, work_dir

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _pieces(vocabulary_path: str, size: int, separator: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = pair_index_encoder(vocabulary_path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch, rows in encoder.stream(batches, 1):
            whole = [np.append(x, np.uint32(separator)).astype("<u4") for x in rows]
            n = np.array([len(x) for x in whole], np.int64)
            first = np.where(n <= size, n, (n - 1) % size + 1)
            count = (n - first) // size + 1
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            length = np.where(piece == 0, first[row], size)
            sums = [zlib.crc32(whole[r][s : s + k].tobytes()) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            # the number of each piece within its length and task
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            head = np.maximum.accumulate(np.where(np.append(True, sorted_[1:] != sorted_[:-1]), np.arange(len(order)), 0))
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(order)) - head + seen[sorted_]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return cut


class _Planner:
    """Sequences as (lengths in order, how many such sequences), from counts by length."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.left = size, counts.copy()
        self.made: list[tuple[list[int], int]] = []

    def _take(self, lengths: list[int]) -> None:
        """Consume a combination as often as the counts allow."""
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.left[x] -= times * k
        self.made.append((lengths, times))

    def _pairs(self) -> np.ndarray:
        """For each sum, whether two available lengths make it (two of one length need two pieces)."""
        have = self.left[: self.size] > 0
        some = np.flatnonzero(have)
        out = np.zeros(2 * self.size, bool)
        if len(some):
            bits = have.astype(np.float64)
            n = 1 << int(2 * self.size - 1).bit_length()
            spectrum = np.fft.rfft(bits, n)
            sums = np.rint(np.fft.irfft(spectrum * spectrum, n)).astype(np.int64)[: 2 * self.size]
            alone = some[self.left[some] < 2]
            sums[2 * alone] -= 1
            out = sums > 0
        return out

    def _pair(self, total: int) -> list[int] | None:
        a = np.arange(max(1, total - self.size + 1), total // 2 + 1)
        ok = (self.left[a] > 0) & (self.left[total - a] > 0)
        if total % 2 == 0 and len(ok):
            ok[-1] &= self.left[total // 2] > 1
        found = np.flatnonzero(ok)
        return [total - int(a[found[0]]), int(a[found[0]])] if len(found) else None

    def _triple(self, total: int, pairs: np.ndarray) -> list[int] | None:
        """The longest length whose rest two more make; ``pairs`` may be stale, so each is tried."""
        a = np.arange(min(total - 2, self.size - 1), (total - 1) // 3, -1)
        for x in a[(self.left[a] > 0) & pairs[total - a]].tolist():
            self.left[x] -= 1
            two = self._pair(total - x)
            self.left[x] += 1
            if two:
                return [x, *two]
        return None

    def plan(self) -> list[tuple[list[int], int]]:
        size = self.size
        if self.left[size]:
            self._take([size])
        residual = np.zeros(size + 1, np.int64)
        pairs = self._pairs()
        for x in range(size - 1, 0, -1):
            changed = 0
            while self.left[x]:
                gap = size - x
                self.left[x] -= 1
                if self.left[gap] > 0:
                    found = [gap]
                elif (found := self._pair(gap)) is None:
                    found = self._triple(gap, pairs)
                self.left[x] += 1
                if found is None:
                    break
                self._take([x, *found])
                changed += 1
            residual[x], self.left[x] = self.left[x], 0
            if changed:
                pairs = self._pairs()
        self._best_fit(residual)
        return [m for m in self.made if m[1]]

    def _best_fit(self, counts: np.ndarray) -> None:
        """Longest first, each to the fullest open sequence that takes it; equal sequences move together."""
        open_: dict[int, list[tuple[list[int], int]]] = {}
        gaps: list[int] = []

        def put(lengths: list[int], times: int) -> None:
            gap = self.size - sum(lengths)
            if gap == 0:
                self.made.append((lengths, times))
                return
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((lengths, times))

        for x in np.flatnonzero(counts)[::-1].tolist():
            left = int(counts[x])
            while left:
                k = bisect_left(gaps, x)
                if k < len(gaps):
                    gap = gaps[k]
                    lengths, times = open_[gap].pop()
                    now = min(left, times)
                    if now < times:
                        open_[gap].append((lengths, times - now))
                    if not open_[gap]:
                        del open_[gap]
                        gaps.pop(k)
                    put([*lengths, x], now)
                    left -= now
                else:
                    each = self.size // x
                    full, rest = divmod(left, each)
                    if full:
                        put([x] * each, full)
                    if rest:
                        put([x] * rest, 1)
                    left = 0
        for groups in open_.values():
            self.made += groups


def plan_slots(counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The plan as slots: for each length, ranges of its pieces' numbers with their sequences and offsets."""
    slots = defaultdict(list)
    used = np.zeros(size + 1, np.int64)
    sequence = 0
    for lengths, times in _Planner(counts, size).plan():
        offset = 0
        for x in lengths:
            slots["length"].append(x)
            slots["low"].append(int(used[x]))
            slots["sequence"].append(sequence)
            slots["offset"].append(offset)
            used[x] += times
            offset += x
        sequence += times
    if not np.array_equal(used, counts):
        raise AssertionError("the plan must use every piece once")
    table = {k: np.array(v, np.int64) for k, v in slots.items()} or {k: np.zeros(0, np.int64) for k in ("length", "low", "sequence", "offset")}
    order = np.lexsort((table["low"], table["length"]))
    return {k: v[order] for k, v in table.items()}


def pack_documents(docs: DataFrame, vocabulary_path: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    work = work_dir(docs.sparkSession)
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    pieces = materialise(plain.mapInArrow(_pieces(vocabulary_path, size, separator), PIECES), f"{work}/pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    counts = np.zeros(size + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # ``size`` rows at most
        counts[length] = n
    slots = plan_slots(counts, size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots["length"] << 44
        key += slots["low"]
        for batch in batches:
            c = {k: np.asarray(batch.column(k)) for k in ("length", "number")}
            at = np.searchsorted(key, (c["length"] << 44) + c["number"], "right") - 1
            own = [pa.array(slots["sequence"][at] + c["number"] - slots["low"][at]), pa.array(slots["offset"][at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *own], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = pieces.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("skip") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
