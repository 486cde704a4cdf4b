"""Greedy consecutive batches of ordered rows, over many tasks.

Where a batch ends hangs on all rows before it. Rows are dealt by ranges of their order and cut into blocks. What a block does is known
before that: if the batch open at its start ends at its row j, the next ones follow from j. j is at most `rows`, so a
block's flow is a table of that many places, made by pointers: from each row to the first that no longer fits, by binary search in
the prefix sums, followed by all places together until they leave the block. Flows compose, see scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.scan import FAN, entries
from weftgraph.session import materialize

CHUNK = 65_536


@dataclass
class Fill:
    """A block of n rows of `total` tokens. prefix: the tokens before each of its first rows, as far as a batch can reach.

    If the open batch ends at row j, the block leaves used[j] tokens and count[j] rows in the batch open at its end, and made[j] batches have begun.
    """

    n: int
    total: int
    prefix: np.ndarray
    used: np.ndarray
    count: np.ndarray
    made: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate([np.array([self.n, self.total], np.int64), self.prefix, self.used, self.count, self.made]).tobytes()

    @staticmethod
    def unpack(b: bytes | None) -> Fill | None:
        if not b:
            return None
        x = np.frombuffer(b, np.int64)
        return Fill(int(x[0]), int(x[1]), *x[2:].reshape(4, -1))

    @staticmethod
    def of(tokens: np.ndarray, most: int, rows: int) -> Fill | None:
        n = len(tokens)
        if not n:
            return None
        sums = np.concatenate([[0], np.cumsum(tokens)])
        at, made = np.arange(min(n - 1, rows) + 1), np.ones(min(n - 1, rows) + 1, np.int64)
        nxt = _next(sums, most, rows)
        while (live := nxt[at] < n).any():
            at, made = np.where(live, nxt[at], at), made + live
        return Fill(n, int(sums[-1]), sums[: len(at)], sums[-1] - sums[at], n - at, made)

    def first(self, used: np.ndarray, count: np.ndarray, most: int, rows: int) -> np.ndarray:
        """The first row that no longer fits a batch of so many tokens and rows, n if all do."""
        prefix = np.append(self.prefix, self.total) if len(self.prefix) == self.n else self.prefix  # else no batch reaches further
        return np.maximum(np.minimum(np.searchsorted(prefix, most - used, "right") - 1, rows - count), 0)


def _next(sums: np.ndarray, most: int, rows: int) -> np.ndarray:
    """From each row the one that begins the next batch, or the number of rows."""
    n = len(sums) - 1
    return np.maximum(np.minimum(np.searchsorted(sums, sums[:-1] + most, "right") - 1, np.arange(n) + rows), np.arange(n) + 1)


def then(a: bytes | None, b: bytes | None, most: int, rows: int) -> bytes | None:
    x, y = Fill.unpack(a), Fill.unpack(b)
    if x is None or y is None:
        return a or b
    j = y.first(x.used, x.count, most, rows)
    stays = j >= y.n
    k = np.minimum(j, len(y.used) - 1)
    used, count = np.where(stays, x.used + y.total, y.used[k]), np.where(stays, x.count + y.n, y.count[k])
    made, prefix = x.made + np.where(stays, 0, y.made[k]), x.prefix
    if len(prefix) == x.n:  # a batch may reach beyond x
        room = rows + 1 - x.n
        prefix, used, count, made = np.concatenate([prefix, x.total + y.prefix[:room]]), np.concatenate([used, y.used[:room]]), np.concatenate([count, y.count[:room]]), np.concatenate([made, y.made[:room]])
    return Fill(x.n + y.n, x.total + y.total, prefix, used, count, made).pack()


def after(state: bytes, flow: bytes | None, most: int, rows: int) -> bytes:
    """state: tokens and rows of the open batch, and its number."""
    f = Fill.unpack(flow)
    if f is None:
        return state
    used, count, batch = np.frombuffer(state, np.int64)
    j = int(f.first(used, count, most, rows)) if count else 0
    if count and j >= f.n:
        return np.array([used + f.total, count + f.n, batch], np.int64).tobytes()
    return np.array([f.used[j], f.count[j], batch + f.made[j] - (not count)], np.int64).tobytes()


def batches(docs: DataFrame, order: str, tokens: Column, most: int, rows: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(order, n_tokens, batch): docs by `order`, in consecutive batches of at most `most` tokens and `rows` rows, numbered from 0.

    A row of more tokens than a batch holds is a batch of its own. Rows of equal order go by their tokens. A null count is 0. No rows, no result.
    """
    slim = docs.select(order, F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    kind = dict(slim.dtypes)[order]
    dealt = slim.repartitionByRange(order, "n_tokens").sortWithinPartitions(order, "n_tokens")

    def cut(frames):
        at, part, before, held, n = TaskContext.get().partitionId(), 0, None, [], 0
        row = lambda data, size: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary()), pa.array([before], pa.binary())], ["id", "part", "data", "flow"])

        def block(t):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            flow = Fill.of(t.column("n_tokens").to_numpy(), most, rows)
            return row(sink.getvalue().to_pybytes(), t.num_rows), flow.pack() if flow else None

        for b in frames:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                t = pa.Table.from_batches(held)
                for i in range(0, n - n % chunk, chunk):
                    out, flow = block(t.slice(i, chunk).combine_chunks())
                    yield out
                    before, part = then(before, flow, most, rows), part + 1
                rest = t.slice(n - n % chunk)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            out, flow = block(pa.Table.from_batches(held).combine_chunks())
            yield out
            before, part = then(before, flow, most, rows), part + 1
        yield row(None, 0)

    blocks = materialize(dealt.mapInArrow(cut, "id long, part long, data binary, flow binary"), "blocks")
    start = np.zeros(3, np.int64).tobytes()
    entry = entries(blocks.where("data is null").select("id", "flow"), lambda a, b: then(a, b, most, rows), lambda s, f: after(s, f, most, rows), start, fan)

    def fill(frames):
        for b in frames:
            for data, before, state in zip(*(b.column(c).to_pylist() for c in ("data", "flow", "entry"))):
                t = pa.ipc.open_stream(data).read_all()
                used, count, batch = np.frombuffer(after(state, before, most, rows), np.int64)
                sizes = t.column("n_tokens").to_numpy()
                sums = np.concatenate([[0], np.cumsum(sizes)])
                n, nxt = len(sizes), _next(sums, most, rows)
                begins = np.zeros(n, np.int64)
                at = max(int(min(np.searchsorted(sums, most - used, "right") - 1, rows - count)), 0) if count else 0
                while at < n:  # a step for each batch
                    begins[at] = 1
                    at = nxt[at]
                number = batch + np.cumsum(begins) - (0 if count else 1)
                yield pa.RecordBatch.from_arrays([t.column(order).combine_chunks(), pa.array(sizes), pa.array(number)], [order, "n_tokens", "batch"])

    parts = blocks.where("data is not null").join(entry, "id").select("data", "flow", "entry")
    return parts.mapInArrow(fill, f"`{order}` {kind}, n_tokens long, batch long")
