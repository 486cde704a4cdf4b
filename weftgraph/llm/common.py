"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

U64 = np.uint64
#: Rows and bytes of one Arrow batch; bounds what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 8000, 4_000_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at the end of a task gives freed memory back, as idle workers would keep it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def append_columns(df: DataFrame, ddl: str, fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with the columns of ddl, computed by fn for each Arrow batch. A column of df whose name clashes, in whatever case, is replaced."""
    new = _parse_datatype_string(ddl)
    made = {f.name.lower() for f in new}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made])
    names, kinds = [f.name for f in df.schema] + [f.name for f in new], [_arrow(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(fn(b), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names)

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, *new.fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Roll:
    """Hashes of byte ranges: differences of prefix sums of value(byte) * base**offset modulo 2**64, brought to offset 0 and mixed."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, seed: int = 1) -> None:
        self.value = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
        self.power = self.inverse = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("power", self.BASE), ("inverse", self.INVERSE)):
                x = np.full(size, U64(base))
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """data: uint8. Sums before each offset, one more than there are bytes."""
        self._powers(len(data))
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (prefix[end] - prefix[start]) * self.inverse[start]
        return mix64(x + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, prefix: np.ndarray, q: int) -> np.ndarray:
        """The hash of the q bytes at each offset."""
        n = len(prefix) - q
        return mix64((prefix[q:] - prefix[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


class Prime:
    """Hashes of byte ranges as Roll's, but modulo the prime 2**31 - 1: 31 bits that no structure of a text makes equal, as powers of two do Roll's.

    For a base drawn at random, two different ranges of n bytes are equal with a chance of n / 2**31 at most.
    """

    P = (1 << 31) - 1

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, self.P, 256, dtype=np.int64).astype(U64)
        self.base = int(rng.integers(1 << 20, self.P))
        self.power = self.inverse = np.ones(1, U64)

    @classmethod
    def _mod(cls, x: np.ndarray) -> np.ndarray:
        """x modulo P, for x below 2**62."""
        p = U64(cls.P)
        x = (x & p) + (x >> U64(31))
        x = (x & p) + (x >> U64(31))
        return np.where(x == p, U64(0), x)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, self.P))):
                x = np.ones(1, U64)
                while len(x) <= max(n, 1 << 16):
                    x = np.concatenate([x, self._mod(x * U64(pow(base, len(x), self.P)))])
                setattr(self, name, x)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums before each offset; below 2**62 for fewer than 2**31 bytes."""
        self._powers(len(data))
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self._mod(self.value[data] * self.power[: len(data)]), out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mod(self._mod(prefix[end] - prefix[start]) * self.inverse[start])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """A table for each run of rows with equal keys (longs), from batches sorted by them."""
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for s, e in zip(cuts, cuts[1:]):
            yield t.slice(s, e - s)
        carry = t.slice(cuts[-1])
    if carry is not None and carry.num_rows:
        yield carry


def whole_groups_many(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, many at a time, from batches sorted by key (a long)."""
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        if t.num_rows:
            k = t.column(key).to_numpy()
            change = np.flatnonzero(k != k[-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield t.slice(0, cut)
            carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry


def blocks_of(members: DataFrame, rows: int, size: int, part: str = "component") -> DataFrame:
    """(component, part, blocks): into how many blocks of at most about `rows` members and `size` bytes each part of a component is cut."""
    sums = members.groupBy(*dict.fromkeys(["component", part])).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    blocks = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("b") / size), F.lit(1)).alias("blocks")
    return sums.select(*dict.fromkeys(["component", part]), blocks)


def block_pairs(members: DataFrame, rows: int, size: int) -> DataFrame:
    """members (node, component, bytes) with the tasks that compare a component's members: columns i, j and side.

    A component of at most `rows` members and `size` bytes is one task (0, 0). A larger one is cut into blocks by a
    hash, and every pair of blocks i <= j is a task, so that no task ever holds more than two blocks. side says
    which of the two blocks a row belongs to.
    """
    m = members.join(blocks_of(members, rows, size), "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    return _paired(m, F.lit(0).cast("long"), F.col("blocks"), "node", "component")


def block_pairs_beside(members: DataFrame, rows: int, size: int) -> DataFrame:
    """As block_pairs for members with a column main, whose pairs among main rows need no task: blocks of main rows meet only those of others.

    Where n of a component's rows are main and m are not, some n * m / rows + m * m / rows rows are dealt, not (n + m)^2 / rows.
    The rows keep their columns.
    """
    parts = blocks_of(members, rows, size, "main").groupBy("component")
    parts = parts.agg(F.sum(F.when(F.col("main"), F.col("blocks")).otherwise(0)).alias("mains"), F.sum("blocks").alias("blocks"))
    m = members.join(parts, "component")
    h = F.xxhash64("node")
    m = m.withColumn("own", F.when(F.col("main"), F.pmod(h, F.nullif("mains", F.lit(0)))).otherwise(F.col("mains") + F.pmod(h, F.nullif(F.col("blocks") - F.col("mains"), F.lit(0)))))
    m = m.where(~F.col("main") | (F.col("mains") < F.col("blocks")))  # no others, nothing to meet
    return _paired(m, F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0)).cast("long"), F.col("blocks"), *members.columns)


def _paired(m: DataFrame, first: Column, blocks: Column, *keep: str) -> DataFrame:
    """m, a row for each block from `first` on that its own block meets."""
    m = m.withColumn("other", F.explode(F.sequence(first, blocks - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return m.select(*keep, i.alias("i"), j.alias("j"), (F.col("own") == j).cast("int").alias("side"))
