"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document of smaller id, or further
ahead in the same one. Suffixes that matter only in their first `length` bytes need no full order, only equality.

1. Buckets. The string at each offset (a window) is put into the bucket of one q-gram inside it, the one of smallest
   hash. Equal windows share a bucket whatever surrounds them, and runs of neighbouring windows have the same
   q-gram, so one row stands for a run.
2. First refinement. A bucket is split by the identifier of the run's whole hull, its bytes up to the end of its last
   window: all windows of a run but the earliest of its class are repeats. Runs alone in their bucket are done.
3. Second refinement, only for the earliest runs of buckets that hold several classes: a bucket for each window at its
   own later offset. All but the earliest window of such a bucket are repeats.

A run is identified by the hash of its q-gram and by that of its hull, a window by its own. Hulls and windows carry two hashes of
different kinds: 33 and 64 bits of a rolling sum modulo 2**64, for which no bound is proved (words made of two letters by a rule
can agree), and 31 bits of one modulo a prime, on which two given strings agree with a chance of their length / 2**31 at most. Within a map task, runs and windows met before are marked there and not
sent, so a hot passage sends one row for each task; what is left is sorted and read as a stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, Prime, Roll, append_columns, as_long, column, lean, small_batches
from weftgraph.llm.ngram_join import packed
from weftgraph.session import materialize

Q = 32
CHUNK_BYTES = 2_000_000
#: Runs or windows gathered by a map task before they are sent.
FLUSH_ROWS = 1_500_000
#: Two kinds of hash; the second has 31 bits, as every byte of a row counts on disk.
PRIME_BITS = U64((1 << 31) - 1)
_roll, _prime = Roll(13), Prime(29)
RUN = "key long, hull long, doc long, start int, n int"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (w - size)], m[w - size :]) if w > size else m


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text number, offset of the first window, number of windows, bucket and hull of each run.

    The number is negative where the bucket's q-gram occurs again within a window's reach: such a run may repeat itself.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
    prefix = _roll.prefix(data)
    grams, reach = _roll.grams(prefix, Q), length - Q + 1
    least = _sliding_min(grams, reach)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    valid = np.zeros(len(least) + 1, bool)
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = least[1:] != least[:-1]
    for s, e in zip(ends - sizes, ends):
        if e - s >= length:
            valid[s : e - length + 1] = True
            change[s] = True
    change[1:] |= valid[1:] != valid[:-1]
    at = np.flatnonzero(change)
    first, n = at[:-1], np.diff(at)
    first, n = first[valid[first]], n[valid[first]]
    end = first + n - 1 + length
    hull = (_roll.spans(prefix, first, end) & ~PRIME_BITS) | _prime.spans(_prime.prefix(data), first, end)
    text = np.searchsorted(ends, first, side="right")
    front = np.flatnonzero((grams[: len(least)] == least) & valid[:-1])
    again = np.zeros(len(front), bool)
    for gap in range(1, reach + 1):
        again |= grams[front] == grams[np.minimum(front + gap, len(grams) - 1)]
    again[front == len(grams) - 1] = False
    own = np.zeros(len(first), bool)
    own[np.searchsorted(first, front[again], side="right") - 1] = True
    return text, first - (ends - sizes)[text], np.where(own, -n, n), least[first], hull


def _earliest(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, doc and start, and whether each row of it is its group's first; rows of the very same place count as first."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, s = doc[order], start[order]
    return order, (d == d[lead]) & (s == s[lead])


def _batch(key, hull, doc, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(as_long(key)), None if hull is None else pa.array(as_long(hull)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "hull", "doc", "start", "n"])


def _covered(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
    """Runs known as repeats, joined where they touch; their hull is null, their key spreads them by document."""
    if not len(doc):
        return None
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(start + n, at)
    key = doc[at] * 31 + start[at]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(at), pa.int64()), pa.array(doc[at]), pa.array(start[at].astype(np.int32)), pa.array((end - start[at]).astype(np.int32))], ["key", "hull", "doc", "start", "n"])


def _sent(parts: list[tuple]):
    key, hull, doc, start, n = (np.concatenate(c) for c in zip(*parts))
    order, first = _earliest([key, hull], doc, start)
    kept, gone = np.sort(order[first]), order[~first]  # neighbours of one document compress each other
    yield _batch(key[kept], hull[kept], doc[kept], start[kept], n[kept])
    if (c := _covered(doc[gone], start[gone], np.abs(n[gone]))) is not None:
        yield c


def _find_runs(length: int):
    def flush(texts, ids, parts):
        text, start, n, key, hull = runs(texts, length)
        parts.append((key, hull, np.array(ids, np.int64)[text] if len(text) else np.zeros(0, np.int64), start, n))

    def run(batches):
        parts, held, texts, ids, size = [], 0, [], [], 0
        for b in batches:
            for d, t in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
                if d is None or t is None:
                    continue
                texts.append(t.encode("utf-8", "surrogatepass"))
                ids.append(d)
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    flush(texts, ids, parts)
                    held += len(parts[-1][0])
                    texts, ids, size = [], [], 0
                    if held >= FLUSH_ROWS:
                        yield from _sent(parts)
                        parts, held = [], 0
        if texts:
            flush(texts, ids, parts)
        if parts:
            yield from _sent(parts)

    return run


def _refine(batches):
    """Rows sorted by key, hull (nulls first), doc, start: out come repeats (again false) and earliest runs of buckets with several classes, or that may repeat themselves (again true)."""
    key0 = hull0 = place0 = pending = None
    shared = False
    for b in batches:
        if not b.num_rows:
            continue
        known = np.asarray(column(b, "hull").is_null())
        doc, start, n = (column(b, c).to_numpy() for c in ("doc", "start", "n"))
        out_doc, out_start, out_n, out_again = [doc[known]], [start[known]], [n[known]], [np.zeros(known.sum(), bool)]
        live = ~known
        if live.any():
            key, hull = column(b, "key").to_numpy()[live], column(b, "hull").drop_null().to_numpy()
            doc, start, n = doc[live], start[live], n[live]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_key[0] = key[0] != key0
            new_class = new_key.copy()
            new_class[1:] |= hull[1:] != hull[:-1]
            new_class[0] |= hull[0] != hull0
            lead = np.maximum.accumulate(np.where(new_class, np.arange(len(key)), -1))
            lead_doc = np.where(lead >= 0, doc[np.maximum(lead, 0)], place0[0] if place0 else -1)
            lead_start = np.where(lead >= 0, start[np.maximum(lead, 0)], place0[1] if place0 else -1)
            repeat = ~new_class & ((doc != lead_doc) | (start != lead_start))
            rep = np.flatnonzero(new_class)
            # a class shares its bucket if it is not the bucket's first, or another class follows
            second = ~new_key[rep]
            follows = np.zeros(len(rep), bool)
            follows[:-1] = second[1:]
            if len(rep) and second[0] and pending is not None and not shared:
                out_doc.append(pending[0])
                out_start.append(pending[1])
                out_n.append(pending[2])
                out_again.append(np.ones(1, bool))
            alone = n[rep] < 0  # may repeat itself
            n = np.abs(n)
            pick = rep[second | follows | alone]
            out_doc += [doc[repeat], doc[pick]]
            out_start += [start[repeat], start[pick]]
            out_n += [n[repeat], n[pick]]
            out_again += [np.zeros(repeat.sum(), bool), np.ones(len(pick), bool)]
            if len(rep):
                k = rep[-1]
                pending, shared = (doc[k : k + 1], start[k : k + 1], n[k : k + 1]), bool(second[-1] or alone[-1])
            key0, hull0, place0 = key[-1], hull[-1], (lead_doc[-1], lead_start[-1])
        cols = [np.concatenate(c) for c in (out_doc, out_start, out_n, out_again)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3])], ["doc", "start", "n", "again"])


def _find_windows(length: int):
    def run(batches):
        unpack, parts, held = zstandard.ZstdDecompressor(), [], 0
        for b in batches:
            for d, z, spans in zip(column(b, "doc").to_pylist(), column(b, "packed").to_pylist(), column(b, "spans").to_pylist()):
                data = np.frombuffer(unpack.decompress(z), np.uint8)
                first, n = np.array([s["start"] for s in spans]), np.array([s["n"] for s in spans])
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = at[at + length <= len(data)]
                key = _roll.spans(_roll.prefix(data), at, at + length)
                parts.append((key, _prime.spans(_prime.prefix(data), at, at + length), np.full(len(at), d), at, np.ones(len(at), np.int64)))
                held += len(at)
                if held >= FLUSH_ROWS:
                    yield from _sent(parts)
                    parts, held = [], 0
        if parts:
            yield from _sent(parts)

    return run


def _cut(length: int):
    def one(z: bytes | None, spans) -> tuple:
        data = zstandard.ZstdDecompressor().decompress(z) if z else b""
        gone = []
        for s in sorted((s["start"], s["start"] + s["n"] - 1 + length) for s in spans or ()):
            s = (s[0], min(s[1], len(data)))
            if gone and s[0] <= gone[-1][1]:
                gone[-1][1] = max(gone[-1][1], s[1])
            elif s[0] < s[1]:
                gone.append([*s])
        keep, at = [], 0
        for s, e in gone:
            keep.append(data[at:s])
            at = e
        keep = b"".join(keep) + data[at:]
        return len(data), len(data) - len(keep), gone, keep

    def run(b: pa.RecordBatch) -> list:
        made = [one(z, s) for z, s in zip(column(b, "packed").to_pylist(), column(b, "spans").to_pylist())]
        n, removed, gone, keep = zip(*made) if made else ((), (), (), ())
        return [list(n), list(removed), [[{"start": s, "end": e} for s, e in g] for g in gone], list(keep)]

    return run


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, start, n): runs of n windows from byte `start` that also start earlier. docs: doc_id long, text string."""
    small_batches(docs.sparkSession)
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_find_runs(length)), RUN)
    bucketed = sent.repartition("key").sortWithinPartitions("key", "hull", "doc", "start")
    found = materialize(bucketed.mapInArrow(lean(_refine), "doc long, start int, n int, again boolean"), "runs")
    again = found.where("again").groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = again.join(packed(docs.where("text is not null")), F.col("doc") == F.col("doc_id"))
    windows = texts.select("doc", "packed", "spans").mapInArrow(lean(_find_windows(length)), RUN)
    windows = windows.repartition("key").sortWithinPartitions("key", "hull", "doc", "start").mapInArrow(lean(_refine), "doc long, start int, n int, again boolean")
    return found.where("not again").select("doc", "start", "n").unionByName(windows.where("not again").select("doc", "start", "n"))


def _numbered(docs: DataFrame) -> DataFrame | None:
    """docs with an order-preserving number in place of doc_id where several texts share an id; None if none do."""
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if several.isEmpty():
        return None
    h = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(5), "text").alias("h2")).distinct()
    if h.groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    ranged = h.repartitionByRange("doc_id", "h", "h2").sortWithinPartitions("doc_id", "h", "h2")
    numbers = materialize(ranged.select(F.col("doc_id").alias("id"), "h", "h2", F.monotonically_increasing_id().alias("number")), "numbers")
    on = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h")) & (F.xxhash64(F.lit(5), "text") == F.col("h2"))
    return materialize(docs.join(numbers, on, "left").select("doc_id", "number", "text"), "numbered")


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, gone: array of maximal removed byte spans, kept: binary) for every row of docs.

    Null texts count as empty. Texts shorter than `length` bytes keep all. A null id is left alone and takes part in
    nothing. Rows that repeat a doc_id and its text are one document: the text is no repeat of itself, and each row loses
    the same spans. Different texts with one doc_id are documents of their own, in the order of a hash. No rows, no result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = _numbered(rows)
    own = rows if numbered is None else numbered.select(F.col("number").alias("doc_id"), "text")
    spans = repeats(own, length).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    if numbered is None:
        texts = packed(rows).withColumn("id", F.col("doc_id"))
    else:
        texts = packed(numbered.select(F.struct("number", F.col("doc_id").alias("id")).alias("doc_id"), "text")).select("packed", F.col("doc_id.number").alias("doc_id"), F.col("doc_id.id").alias("id"))
    joined = texts.join(spans, F.col("doc_id") == F.col("doc"), "left").select(F.col("id").alias("doc_id"), "packed", "spans")
    made = append_columns(joined, "n_bytes long, n_removed long, gone array<struct<start:long,end:long>>, kept binary", _cut(length))
    return made.select("doc_id", "n_bytes", "n_removed", "gone", "kept")
