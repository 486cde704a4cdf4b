"""Scans over ordered blocks: what each block finds when all before it has been seen.

A block is summed up by a flow, which says what it does to a state; flows compose. A tree of at most `fan` children a node composes
them upwards and hands states downwards, so the top task sees `fan` rows, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import materialize

FAN = 256
#: then(first, second): the flow of both, either may be None; after(state, flow): the state behind it.
Then = Callable[[bytes | None, bytes | None], bytes | None]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows (up, id, flow, entry) with equal up."""
    up, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != up and rows:
                yield up, rows
                rows = []
            up = row[0]
            rows.append(row)
    if rows:
        yield up, rows


def entries(flows: DataFrame, then: Then, after: Then, start: bytes | None = None, fan: int = FAN) -> DataFrame:
    """(id, entry) for each row of flows (id long from 0, flow binary): the state in front of it, in the order of ids."""

    def upwards(batches):
        for up, rows in _groups(batches):
            flow = None
            for r in rows:
                flow = then(flow, r[2])
            yield pa.RecordBatch.from_arrays([pa.array([up], pa.int64()), pa.array([flow], pa.binary())], ["id", "flow"])

    def downwards(batches):
        for _, rows in _groups(batches):
            state, out = rows[0][3], []
            for r in rows:
                out.append(state)
                state = after(state, r[2])
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.binary())], ["id", "entry"])

    levels = [flows]
    while (levels[-1].agg(F.max("id")).first()[0] or 0) >= fan:
        up = levels[-1].select(F.expr(f"id div {fan}").alias("up"), "id", "flow", F.lit(None).cast("binary").alias("entry"))
        levels.append(materialize(up.repartition("up").sortWithinPartitions("up", "id").mapInArrow(upwards, "id long, flow binary"), "flows"))
    entry = None
    for level in reversed(levels):
        level = level.withColumn("up", F.expr(f"id div {fan}"))
        level = level.withColumn("entry", F.lit(start).cast("binary")) if entry is None else level.join(entry.select(F.col("id").alias("up"), "entry"), "up")
        walk = level.select("up", "id", "flow", "entry").repartition("up").sortWithinPartitions("up", "id")
        entry = materialize(walk.mapInArrow(downwards, "id long, entry binary"), "entries")
    return entry
