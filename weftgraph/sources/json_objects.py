"""The objects inside large JSON files, read by many tasks.

Spark's text reader cuts a file at `}`, so byte ranges of one file go to several tasks, from any store that Spark reads. Whether a `}` closes an
object, and how deep it lies, hangs on all that stands before it in the file; that is found by a scan over chunks, whose
flow says how a chunk changes depth if it starts inside or outside of a string. A chunk starts behind a `}`, so no escape crosses its border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.scan import FAN, entries
from weftgraph.session import materialize, numbered

CHUNK = 1_000_000
TOKEN = re.compile(r'\\.|["{}]', re.DOTALL)


def _walk(text: str, inside: bool, depth: int, level: int) -> tuple[bool, int, list[int], list[int]]:
    """Whether the text ends inside a string, and how deep; where objects of that level begin, and where they end."""
    begins, ends = [], []
    for m in TOKEN.finditer(text):
        t = m.group()
        if t == '"':
            inside = not inside
        elif inside or len(t) > 1:
            continue
        elif t == "{":
            if depth == level:
                begins.append(m.start())
            depth += 1
        else:
            depth -= 1
            if depth == level:
                ends.append(m.end())
    return inside, depth, begins, ends


def _longs(*x: int) -> bytes:
    return np.array(x, np.int64).tobytes()


def _deeper(a: bytes | None, b: bytes | None) -> bytes | None:
    """Flows: whether a file starts here; then, for a start outside and inside of a string, whether it ends inside, and the change of depth."""
    if a is None or b is None:
        return a or b
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    if y[0]:
        return b
    after = lambda k: (y[1 + 2 * x[k]], x[k + 1] + y[2 + 2 * x[k]])
    return _longs(x[0], *after(1), *after(3))


def _depth(state: bytes, flow: bytes | None) -> bytes:
    if flow is None:
        return state
    (inside, depth), f = np.frombuffer(state, np.int64), np.frombuffer(flow, np.int64)
    return _longs(f[1], f[2]) if f[0] else _longs(f[1 + 2 * inside], depth + f[2 + 2 * inside])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, held, n = None, 0, [], 0

        def chunk():
            text = "".join(held)
            out, into = _walk(text, False, 0, -1), _walk(text, True, 0, -1)
            flow = _longs(key[1] == 0 and part == 0, out[0], out[1], into[0], into[1])
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([part], pa.int64()), pa.array([text]), pa.array([flow], pa.binary())], ["path", "at", "part", "text", "flow"])

        for b in batches:
            for path, at, value in zip(*(c.to_pylist() for c in b.columns)):
                if (path, at) != key or n >= size:
                    if held:
                        yield chunk()
                    part = part + 1 if (path, at) == key else 0
                    key, held, n = (path, at), [], 0
                held.append(value + "}")
                n += len(value) + 1
        if held:
            yield chunk()

    return run


def read_objects(spark: SparkSession, path: str, level: int = 1, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(path, number, text): the objects that lie in `level` others, in files of UTF-8 JSON, numbered from 0 in the order of files and places.

    A file may hold any white space, and braces and quotes in its strings. An object that is never closed is left out.
    """
    lines = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    kept = numbered(lines.mapInArrow(_chunks(chunk), "path string, at long, part long, text string, flow binary"), "path", "at", "part", name="id")
    kept = materialize(kept, "chunks")
    state = entries(kept.select("id", "flow"), _deeper, _depth, _longs(0, 0), fan)

    def cut(batches):
        """Whole objects (k >= 0 and whole), and at a chunk's ends what it has of objects that cross its borders: k is -1 for one begun before."""
        for b in batches:
            out = []
            for name, at, part, i, text, entry in zip(*(b.column(c).to_pylist() for c in ("path", "at", "part", "id", "text", "entry"))):
                inside, depth = np.frombuffer(entry, np.int64).tolist() if at or part else (0, 0)  # a file starts anew
                _, deep, begins, ends = _walk(text, bool(inside), depth, level)
                if depth > level:  # inside of an object
                    out.append((name, i, -1, False, text[: ends[0]] if ends else text))
                    ends = ends[1:]
                for k, begin in enumerate(begins):
                    out.append((name, i, k, k < len(ends), text[begin : ends[k] if k < len(ends) else None]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["path", "id", "k", "whole", "text"])

    found = materialize(kept.join(state, "id").mapInArrow(cut, "path string, id long, k long, whole boolean, text string"), "objects")
    # an object begun in an earlier chunk is the last one begun before
    begun = kept.select("id").join(found.where("k >= 0 and not whole").select("id", "k"), "id", "left").select("id", F.when(F.col("k").isNotNull(), F.concat(F.hex("id"), F.lit("."), F.hex("k"))).cast("binary").alias("flow"))
    last = entries(begun, lambda a, b: b or a, lambda s, f: f or s, None, fan)
    open_ = found.where("k < 0").join(last, "id").where("entry is not null").select("path", F.conv(F.split_part(F.col("entry").cast("string"), F.lit("."), F.lit(1)), 16, 10).cast("long").alias("own"), F.conv(F.split_part(F.col("entry").cast("string"), F.lit("."), F.lit(2)), 16, 10).cast("long").alias("k"), "id", "text")
    parts = found.where("k >= 0 and not whole").select("path", F.col("id").alias("own"), "k", "id", "text").unionByName(open_)
    pieces = F.array_sort(F.collect_list(F.struct("id", "text")))
    joined = parts.groupBy("path", "own", "k").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
    whole = found.where("whole").select("path", F.col("id").alias("own"), "k", "text").unionByName(joined.select("path", "own", "k", "text").where("endswith(text, '}')"))
    return numbered(whole, "own", "k").select("path", "number", "text")
