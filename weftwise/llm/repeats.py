"""Suffix-array dedup: removal of every byte that a long repeated string covers.

Contract: a byte goes if a ``length``-byte string over it also starts anywhere else in the table,
the same text included; strings are judged on the input. Matches never cross documents.

How it scales. Every window of ``length`` bytes names one anchor in itself: its leftmost lowest
k-gram hash. Equal windows name the same anchor, so only texts that share an anchor can share a
window. Consecutive windows with one anchor make a *run*, one narrow row (hashes and offsets).

1. Runs with an anchor that nobody else has are unique and leave (pre-aggregated count).
2. Runs whose whole bytes are repeated keep one representative: any copy's windows are repeats.
3. Runs that share the anchor but not all bytes (the ends of matches, places of edits) are brought
   together by anchor, once for each distinct text, and put in a run-length index (``run_index``);
   its matching statistics mark matches of ``length`` and more. Blocks are cut between anchors, so
   each holds a few MB whatever the corpus holds. An anchor with more distinct texts than
   ``hot_spans`` (a line that very many documents share) is not gathered at all: its windows are
   hashed and counted, which aggregates before the shuffle and splits over all tasks.
4. Marks are gathered by document (bounded by the document) and cut out of its bytes.

Nulls: a null text is empty; a null id is a document of its own kind. Repeated rows are further
occurrences, so their bytes go, if long enough. Texts below ``length`` bytes stay. Other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.llm.common import U64, RollingHash, drop_path, free_name, materialise, mix64, row_key, text_chunks, work_dir
from weftwise.llm.run_index import RunLengthIndex

K = 32
#: Positions are packed below the hashes, so one step handles at most 2**24 bytes.
STEP = (1 << 24) - 1
BLOCK_BYTES = 3_000_000
HOT_SPANS = 4096
RUN_SCHEMA = "d long, th long, ah long, rh long, s int, e int, cnt long"


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with one anchor: (text index, start, end, anchor hash, run hash, count)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, np.int64))
    n, span = len(data), length - K + 1
    if n < length:
        return none
    hashes = RollingHash(data)
    grams = mix64(hashes.every(K))
    low = (grams & ~U64(STEP)) | np.arange(len(grams), dtype=U64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if rest := span - size:
        low = np.minimum(low[:-rest], low[rest:])
    anchor = (low & U64(STEP)).astype(np.int64)
    first, stop = offsets[:-1], offsets[1:] - length + 1
    long_ = np.flatnonzero(stop > first)
    if not len(long_):
        return none
    first, stop = first[long_], stop[long_]
    edge = np.zeros(len(anchor) + 1, np.int8)
    edge[1:-1] = anchor[1:] != anchor[:-1]
    edge[first] = 1
    edge[stop] = 1
    edge[len(anchor)] = 0
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(anchor))
    text = np.searchsorted(first, start, "right") - 1
    inside = (text >= 0) & (start < stop[np.maximum(text, 0)])
    start, end, text = start[inside], end[inside] - 1 + length, text[inside]
    at = anchor[start]
    own = mix64(hashes.of(start, end) ^ mix64(((at - start) << 32 | (end - start)).astype(U64)))
    key = grams[at]
    # the same run again right behind itself (periodic text) becomes one row with a count
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(new)))
    end = end[np.append(head[1:], len(new)) - 1] if len(head) else end
    return long_[text[head]], start[head], end, key[head], own[head], count


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """``_runs`` with offsets from each text's start; a huge text is taken in overlapping steps."""
    if len(data) <= STEP:
        t, s, e, a, r, c = _runs(data, offsets, length)
        yield t, s - offsets[t], e - offsets[t], a, r, c
        return
    for i in range(len(offsets) - 1):
        for at in range(offsets[i], max(offsets[i + 1] - length + 1, offsets[i] + 1), STEP - length + 1):
            part = data[at : min(at + STEP, offsets[i + 1])]
            t, s, e, a, r, c = _runs(part, np.array([0, len(part)]), length)
            yield t + i, s + at - offsets[i], e + at - offsets[i], a, r, c


def _emit_runs(length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = (np.asarray(batch.column(k)) for k in (0, 1))
            for i, _, data, offsets in text_chunks(batch.column(2)):
                for t, s, e, a, r, c in _pieces(data, offsets, length):
                    if len(t):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(d[i + t]), pa.array(th[i + t]), pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(c)],
                            names=["d", "th", "ah", "rh", "s", "e", "cnt"],
                        )

    return emit


def _take_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the requested spans: (d, th, text, [s, e, ah, rh]) to one row a span."""
    for batch in batches:
        d, th, text, asked = (batch.column(k) for k in range(4))
        text = text.cast(pa.binary())
        counts = np.diff(np.asarray(asked.offsets))
        flat = asked.flatten()
        s, e, ah, hot = (np.asarray(flat.field(k)) for k in range(4))
        out, k = [], 0
        for row, n in enumerate(counts):
            whole = text[row].as_buffer()
            out.extend(whole.slice(s[j], e[j] - s[j]).to_pybytes() for j in range(k, k + n))
            k += n
        # in parts, so that no batch of spans outgrows its buffer
        who, whom = np.repeat(np.asarray(d), counts), np.repeat(np.asarray(th), counts)
        for p in range(0, len(out), 20_000):
            q = slice(p, p + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(who[q]), pa.array(whom[q]), pa.array(s[q]), pa.array(ah[q]), pa.array(hot[q]), pa.array(out[q], pa.binary())], names=["d", "th", "s", "ah", "hot", "span"])


SPAN_SCHEMA = "d long, th long, s int, ah long, hot boolean, span binary"
MARK_SCHEMA = "d long, th long, s int, e int"


def _joined(d: np.ndarray, th: np.ndarray, s: np.ndarray, spans: list[bytes]):
    """Spans of one document that touch or overlap become one string, so no byte is there twice."""
    o = np.lexsort((s, th, d))
    d, th, s = d[o], th[o], s[o]
    lengths = np.array([len(x) for x in spans], np.int64)[o]
    flat = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum(np.append(0, np.array([len(x) for x in spans], np.int64)))[:-1][o]
    e = s + lengths
    fresh = np.ones(len(o), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (th[1:] != th[:-1])
    # the furthest end so far within the document, by lifting each document above the one before
    lift = (np.cumsum(fresh) - 1) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + lift)
    had = np.append(-1, reach[:-1])
    skip = np.where(fresh, 0, np.maximum(0, had - (s + lift)))
    fresh[1:] |= (s + lift)[1:] > had[1:]
    keep = np.maximum(0, lengths - skip)
    source = np.repeat(begin + np.minimum(skip, lengths) - np.append(0, np.cumsum(keep)[:-1]), keep) + np.arange(keep.sum())
    data = flat[source]
    head = np.flatnonzero(fresh)
    total = np.add.reduceat(keep, head)
    return d[head], th[head], s[head], data, np.cumsum(total)


def _mark_block(d, th, s, spans, length: int) -> pa.RecordBatch | None:
    d, th, s, data, ends = _joined(d, th, s, spans)
    match = RunLengthIndex(data, ends, length).matching_statistics()
    at = np.flatnonzero(match >= length)
    if not len(at):
        return None
    which = np.searchsorted(ends, at, "right")
    reach = at + match[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (which[1:] != which[:-1]) | (at[1:] > np.maximum.accumulate(reach)[:-1])
    head = np.flatnonzero(fresh)
    stop = np.maximum.reduceat(reach, head)
    w = which[head]
    shift = s[w] - np.append(0, ends[:-1])[w]
    return pa.RecordBatch.from_arrays([pa.array(d[w]), pa.array(th[w]), pa.array((at[head] + shift).astype(np.int32)), pa.array((stop + shift).astype(np.int32))], names=["d", "th", "s", "e"])


def _index_blocks(length: int, block_bytes: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: pa.Table):
            if rows.num_rows:
                c = {k: rows.column(k).to_numpy() for k in ("d", "th", "s")}
                if (out := _mark_block(c["d"], c["th"], c["s"].astype(np.int64), rows.column("span").to_pylist(), length)) is not None:
                    yield out

        for batch in batches:  # sorted by anchor
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                rows = pa.Table.from_batches(held)
                ah = rows.column("ah").to_numpy()
                bytes_ = np.cumsum(pc.binary_length(rows.column("span")).to_numpy().astype(np.int64))
                change = np.flatnonzero(ah[1:] != ah[:-1]) + 1
                at = 0
                while len(change):  # blocks of whole anchors; the last anchor may go on in the next batch
                    ok = change[bytes_[change - 1] - (bytes_[at - 1] if at else 0) >= block_bytes]
                    if not len(ok) or ok[0] <= at:
                        break
                    yield from flush(rows.slice(at, ok[0] - at))
                    at = int(ok[0])
                    change = change[change > at]
                held = rows.slice(at).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return mark


def _hot_windows(length: int):
    """Two hashes of every window of a span."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = U64(0xA0761D6478BD642F)
        for batch in batches:
            d, th, s = (np.asarray(batch.column(k)) for k in range(3))
            for i, _, data, offsets in text_chunks(batch.column("span")):
                if len(data) < length:
                    continue
                h = RollingHash(data).every(length)
                text = np.searchsorted(offsets, np.arange(len(h)), "right") - 1
                fits = np.flatnonzero(np.arange(len(h)) + length <= offsets[text + 1])
                text, at, h = text[fits], fits, h[fits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[i + text]), pa.array(th[i + text]), pa.array((s[i + text] + at - offsets[text]).astype(np.int32)), pa.array(mix64(h).view(np.int64)), pa.array(mix64(h ^ salt).view(np.int64))],
                    names=["d", "th", "s", "h1", "h2"],
                )

    return emit


def repeat_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, block_bytes: int = BLOCK_BYTES, hot_spans: int = HOT_SPANS) -> DataFrame:
    """Rows (d, th, s, e): byte ranges of repeated strings, ``d`` and ``th`` being the document's ``row_key``.

    Ranges may overlap. Every range is the union of windows of ``length`` bytes that start elsewhere too.
    """
    if length <= K:
        raise ValueError(f"length must be over {K}")
    spark, work = docs.sparkSession, work_dir(docs.sparkSession)
    d, th = row_key(docs[id_col], docs[text_col])
    keyed = docs.select(d.alias("d"), th.alias("th"), docs[text_col].alias("text"))
    runs = materialise(keyed.filter(F.octet_length("text") >= length).mapInArrow(_emit_runs(length), RUN_SCHEMA), f"{work}/runs")
    by_anchor = runs.groupBy("ah").agg(F.sum("cnt").alias("n"), (F.min("rh") != F.max("rh")).alias("mixed")).filter("n >= 2")
    # counts are written before they are joined, so that the join's tasks for an anchor of very many runs can be split
    by_anchor = materialise(by_anchor.select("ah", "mixed"), f"{work}/anchors")
    shared = materialise(runs.join(by_anchor.hint("merge"), "ah"), f"{work}/shared")
    drop_path(spark, f"{work}/runs")
    whole = shared.filter("not mixed").select("d", "th", "s", "e")
    mixed = shared.filter("mixed")
    classes = mixed.groupBy("ah", "rh").agg(F.sum("cnt").alias("copies"), F.min("d").alias("one"))
    classes = materialise(classes, f"{work}/classes")
    # counts by anchor leave only the hot ones; where there are some, they are joined as a table of their own
    hot = materialise(classes.groupBy("ah").count().filter(F.col("count") > hot_spans).select("ah", F.lit(True).alias("hot")), f"{work}/hot")
    if hot.isEmpty():
        classes = classes.withColumn("hot", F.lit(False))
    else:
        classes = classes.join(hot.hint("merge"), "ah", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    known = materialise(mixed.join(classes.hint("merge"), ["ah", "rh"]), f"{work}/known")
    for name in ("anchors", "classes", "hot"):
        drop_path(spark, f"{work}/{name}")
    whole = whole.union(known.filter("copies >= 2").select("d", "th", "s", "e"))
    asked = known.filter("copies = 1 or (d = one)").groupBy("d", "th").agg(F.collect_list(F.struct("s", "e", "ah", "hot")).alias("asked"))
    spans = materialise(keyed.join(asked, ["d", "th"]).select("d", "th", "text", "asked").mapInArrow(_take_spans, SPAN_SCHEMA), f"{work}/spans")
    marks = spans.filter("not hot").repartition("ah").sortWithinPartitions("ah").mapInArrow(_index_blocks(length, block_bytes), MARK_SCHEMA)
    windows = spans.filter("hot").mapInArrow(_hot_windows(length), "d long, th long, s int, h1 long, h2 long")
    # spans of one place that several anchors' groups ask for give one window once
    often = windows.groupBy("h1", "h2").agg((F.min(F.struct("d", "th", "s")) != F.max(F.struct("d", "th", "s"))).alias("twice")).filter("twice").select("h1", "h2")
    hot = windows.join(often, ["h1", "h2"]).select("d", "th", "s", (F.col("s") + length).cast("int").alias("e"))
    return whole.union(marks).union(hot)


def _cut(length_col: bool):
    """Apply marks: rows (..., text, marks) to the kept text and its figures."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text = batch.column(names.index("__text"))
            raw = (text.fill_null("") if text.null_count else text).cast(pa.binary())
            marks = batch.column(names.index("__marks"))
            offs, flat = np.asarray(marks.offsets), np.asarray(marks.flatten())
            kept, removed, spans, sha = [], [], [], []
            for i in range(batch.num_rows):
                whole = raw[i].as_py()
                m = flat[offs[i] - offs[0] : offs[i + 1] - offs[0]]
                out, gone, runs_, at = [], 0, 0, 0
                if len(m):
                    m = np.sort(m)
                    s, e = m >> 31, m & 0x7FFFFFFF
                    reach = np.maximum.accumulate(e)
                    head = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
                    for a, b in zip(s[head].tolist(), reach[np.append(head[1:], len(s)) - 1].tolist(), strict=True):
                        out.append(whole[at:a])
                        gone, runs_, at = gone + b - a, runs_ + 1, b
                out.append(whole[at:])
                rest = b"".join(out)
                kept.append(rest.decode("utf-8", "ignore"))
                removed.append(gone)
                spans.append(runs_)
                sha.append(hashlib.sha256(rest).hexdigest())
            keep = [k for k, c in enumerate(names) if c not in ("__text", "__marks")]
            own = [pa.array(kept, pa.string()), pa.array(np.diff(np.append(0, np.cumsum(removed)))), pa.array(spans, pa.int64()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + own, names=[names[k] for k in keep] + ["__kept", "__removed", "__spans", "__sha"])

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **options) -> DataFrame:
    """``docs`` with text less its repeated bytes, and n_bytes, n_removed, n_spans, kept_sha256 added.

    ``kept_sha256`` is of the remaining bytes; the text column leaves out characters that a cut halves.
    An added column that ``docs`` has already gets underscores in front.
    """
    marks = repeat_marks(docs, id_col, text_col, length, **options)
    gathered = marks.groupBy("d", "th").agg(F.collect_set((F.col("s").cast("long") * 2**31 + F.col("e")).cast("long")).alias("__marks"))
    d, th = row_key(docs[id_col], docs[text_col])
    rest = [c for c in docs.columns if c != text_col]
    keyed = docs.select(d.alias("__d"), th.alias("__th"), *[docs[c] for c in rest], docs[text_col].alias("__text"))
    both = keyed.join(gathered.withColumnsRenamed({"d": "__d", "th": "__th"}), ["__d", "__th"], "left")
    both = both.select(*rest, F.octet_length("__text").cast("long").alias("__n"), "__text", F.coalesce("__marks", F.array().cast("array<long>")).alias("__marks"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name not in ("__text", "__marks")) + ", __kept string, __removed long, __spans long, __sha string"
    out = both.mapInArrow(_cut(True), schema)
    named = {c: free_name(docs, c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    return out.select(
        *[F.when(F.lit(True), F.col("__kept")).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce("__n", F.lit(0)).cast("long").alias(named["n_bytes"]), F.col("__removed").alias(named["n_removed"]), F.col("__spans").alias(named["n_spans"]), F.col("__sha").alias(named["kept_sha256"]),
    )
