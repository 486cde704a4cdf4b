"""Gap sessionisation: vectorised lockstep over islands, with sessions carried across the borders of blocks.

An island is a stretch of a client's timely clicks between two borders that need no memory, a final click or a gap. Inside
an island a session also ends by its length, and where one starts hangs on where the one before it started.

1. Blocks. Clicks, once each, are dealt by ranges of (client, time, click) and cut into blocks of bounded size, so that a hot
   client's clicks, or one endless island, lie in many blocks. A block is kept as packed arrays.
2. Lockstep. In a block all islands stand in one array under a composite key that rises from island to island by more than
   a session's length; in each step every active island finds the start of its next session by one binary search. No loop over clients.
3. Borders. A block's flow says which session is open at its end, given the one open at its start: a step function of that
   one's start, constant if the block holds a border. Flows compose, so the session open at each block's start is found by a
   tree of at most FAN children a node, upwards by composition and downwards by application. The top task sees FAN rows at most.
4. Sessions. With that, each block gives its sessions; those that touch its ends are summed up with their other parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import column, lean, small_batches, whole_groups
from weftgraph.session import materialize

MINUTE = 60_000_000
CHUNK, FAN = 65_536, 256
NEVER = np.iinfo(np.int64).max
CLICKS = ["client_id", "click_id", "us", "late", "final", "cents"]


@dataclass
class Rules:
    """Microseconds: a gap of `gap` or more and a session longer than `length` end a session."""

    gap: int
    length: int


@dataclass
class State:
    """The session open at a place of the stream, and the last timely click before it."""

    client: int
    session: int
    start: int
    last: int
    final: int

    def pack(self) -> bytes:
        return np.array([self.client, self.session, self.start, self.last, self.final], np.int64).tobytes()

    @staticmethod
    def unpack(b: bytes | None) -> State | None:
        return State(*np.frombuffer(b, np.int64).tolist()) if b else None


@dataclass
class Flow:
    """What a stretch of the stream does to the open session.

    If it goes on into the stretch, it ends at the first click after x = its start + length: piece k holds for x from until[k - 1]
    on and below until[k], and leaves session[k] open. Beyond the last piece the session stays open if `through`.
    Piece 0 also holds where a session starts at the first click.
    """

    client: int
    first: int
    last_client: int
    last: int
    final: int
    through: int
    until: np.ndarray
    start: np.ndarray
    session: np.ndarray

    def pack(self) -> bytes:
        head = [self.client, self.first, self.last_client, self.last, self.final, self.through]
        return np.concatenate([np.array(head, np.int64), self.until, self.start, self.session]).tobytes()

    @staticmethod
    def unpack(b: bytes | None) -> Flow | None:
        if not b:
            return None
        x = np.frombuffer(b, np.int64)
        return Flow(*x[:6].tolist(), *x[6:].reshape(3, -1))

    @staticmethod
    def of(client: np.ndarray, us: np.ndarray, click: np.ndarray, final: np.ndarray, r: Rules) -> Flow | None:
        n = len(us)
        if not n:
            return None
        ends = int(client[0]), int(us[0]), int(client[-1]), int(us[-1]), int(final[-1])
        lo = islands(client, us, final, r.gap)
        if len(lo) > 1:
            at = _last_starts(us[lo[-1] :], np.zeros(1, np.int64), r.length) + lo[-1]
            return Flow(*ends, 0, np.array([NEVER]), us[at], click[at])
        stop = int(np.searchsorted(us, us[0] + r.length, "right"))
        first = np.flatnonzero(np.concatenate([[True], us[1:] != us[:-1]])[: stop + 1])
        at = _last_starts(us, first, r.length)
        return _merged(Flow(*ends, int(stop == n), us[first], us[at], click[at]))

    def joins(self, client: int, last: int, final: int, r: Rules) -> bool:
        """Whether the session of that last click goes on into this stretch, its length aside."""
        return client == self.client and not final and self.first - last < r.gap

    def after(self, s: State | None, r: Rules) -> State:
        k = int(np.searchsorted(self.until, s.start + r.length, "right")) if s and self.joins(s.client, s.last, s.final, r) else 0
        session, start = (int(self.session[k]), int(self.start[k])) if k < len(self.until) else (s.session, s.start)
        return State(self.last_client, session, start, self.last, self.final)

    def then(self, b: Flow | None, r: Rules) -> Flow:
        if b is None:
            return self
        ends = self.client, self.first, b.last_client, b.last, b.final
        if not b.joins(self.last_client, self.last, self.final, r):
            return Flow(*ends, 0, np.array([NEVER]), b.start[:1], b.session[:1])
        k = np.searchsorted(b.until, self.start + r.length, "right")
        inner, k = k < len(b.until), np.minimum(k, len(b.until) - 1)
        until, start, session = self.until, np.where(inner, b.start[k], self.start), np.where(inner, b.session[k], self.session)
        if self.through:
            more = b.until > self.until[-1]
            until, start, session = (np.concatenate(x) for x in ((until, b.until[more]), (start, b.start[more]), (session, b.session[more])))
        return _merged(Flow(*ends, self.through and b.through, until, start, session))


def _merged(f: Flow) -> Flow:
    """Neighbouring pieces with the same session are one."""
    keep = np.concatenate([f.session[1:] != f.session[:-1], [True]])
    f.until, f.start, f.session = f.until[keep], f.start[keep], f.session[keep]
    return f


def islands(client: np.ndarray, us: np.ndarray, final: np.ndarray, gap: int) -> np.ndarray:
    """Where islands start."""
    new = np.ones(len(us), bool)
    new[1:] = (client[1:] != client[:-1]) | final[:-1] | (us[1:] - us[:-1] >= gap)
    return np.flatnonzero(new)


def _last_starts(us: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The last session's start in one island, for each of several first starts; all advance together."""
    while True:
        after = np.searchsorted(us, us[at] + length, "right")
        live = after < len(us)
        if not live.any():
            return at
        at = np.where(live, after, at)


def lockstep(us: np.ndarray, lo: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """All session starts, in order. lo: where islands start; first: the first session start of each (its end, if there is none)."""
    hi = np.append(lo[1:], len(us))
    base = np.cumsum(np.append(0, us[hi - 1] - us[lo] + length + 1))[:-1]
    key = us - np.repeat(us[lo] - base, hi - lo)
    live = first < hi
    at, hi, starts = first[live], hi[live], []
    while len(at):
        starts.append(at)
        at = np.searchsorted(key, key[at] + length, "right")
        live = at < hi
        at, hi = at[live], hi[live]
    return np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)


def _packed_clicks(cols: list[np.ndarray]) -> bytes:
    client, click, us, late, final, cents = cols
    parts = [np.diff(client, prepend=0), np.diff(us, prepend=0), click, cents, late.astype(np.uint8), final.astype(np.uint8)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def _unpacked_clicks(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    x = np.frombuffer(raw, np.int64, 4 * n).reshape(4, n)
    flags = np.frombuffer(raw, np.uint8, 2 * n, 32 * n).reshape(2, n).astype(bool)
    return [np.cumsum(x[0]), x[2], np.cumsum(x[1]), flags[0], flags[1], x[3]]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    def arrays(b):
        us = column(b, "ts").cast(pa.timestamp("us", b.schema.field("ts").type.tz)).cast(pa.int64())
        return [np.asarray(c) if c.type != pa.bool_() else c.to_numpy(zero_copy_only=False) for c in (column(b, "client_id"), column(b, "click_id"), us, column(b, "late"), column(b, "final"), column(b, "cents"))]

    held, n = [], 0
    for b in batches:
        held.append(arrays(b))
        n += b.num_rows
        if n >= rows:
            whole = [np.concatenate(c) for c in zip(*held)]
            for i in range(0, n - rows + 1, rows):
                yield [c[i : i + rows] for c in whole]
            held, n = [[c[n - n % rows :] for c in whole]], n % rows
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _blocks(r: Rules, rows: int):
    """Of a sorted range: a row for each block, with the flow of what lies before it in the range, and one without clicks for the range's end."""

    def run(batches):
        at, before, part = TaskContext.get().partitionId(), None, 0
        row = lambda n, data: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([at], pa.int64()), ([part], pa.int64()), ([n], pa.int64()), ([data], pa.binary()), ([before.pack() if before else None], pa.binary()))], ["id", "part", "n", "data", "flow"])
        for cols in _chunks(batches, rows):
            yield row(len(cols[0]), _packed_clicks(cols))
            client, click, us, _, final, _ = (c[~cols[3]] for c in cols)
            flow = Flow.of(client, us, click, final, r)
            before, part = (before.then(flow, r) if before else flow), part + 1
        yield row(0, None)

    return run


def _upwards(r: Rules):
    def run(batches):
        for g in whole_groups(batches, ["up"]):
            flow = None
            for b in g.column("flow").to_pylist():
                f = Flow.unpack(b)
                flow = flow.then(f, r) if flow else f
            yield pa.RecordBatch.from_arrays([pa.array([g.column("up")[0].as_py()], pa.int64()), pa.array([flow.pack() if flow else None], pa.binary())], ["id", "flow"])

    return run


def _downwards(r: Rules):
    def run(batches):
        for g in whole_groups(batches, ["up"]):
            state, out = State.unpack(g.column("entry")[0].as_py()), []
            for b in g.column("flow").to_pylist():
                out.append(state.pack() if state else None)
                f = Flow.unpack(b)
                state = f.after(state, r) if f else state
            yield pa.RecordBatch.from_arrays([g.column("id").combine_chunks(), pa.array(out, pa.binary())], ["id", "entry"])

    return run


def _entries(ends: DataFrame, r: Rules, fan: int) -> DataFrame:
    """(id, entry): the session open where each range starts."""
    levels = [ends]
    while (levels[-1].agg(F.max("id")).first()[0] or 0) >= fan:
        up = levels[-1].withColumn("up", F.expr(f"id div {fan}")).repartition("up").sortWithinPartitions("up", "id")
        levels.append(materialize(up.mapInArrow(_upwards(r), "id long, flow binary"), "flows"))
    entry = None
    for level in reversed(levels):
        level = level.withColumn("up", F.expr(f"id div {fan}"))
        level = level.withColumn("entry", F.lit(None).cast("binary")) if entry is None else level.join(entry.select(F.col("id").alias("up"), "entry"), "up")
        walk = level.select("id", "up", "flow", "entry").repartition("up").sortWithinPartitions("up", "id")
        entry = materialize(walk.mapInArrow(_downwards(r), "id long, entry binary"), "entries")
    return entry


PARTS = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, final boolean, whole boolean, place long, path array<long>"


def _parts(r: Rules):
    """Of blocks with the session open at the start of their range: their sessions, whole or in part."""

    def run(batches):
        for b in batches:
            for at, part, n, data, before, entry in zip(*(column(b, c).to_pylist() for c in ("id", "part", "n", "data", "flow", "entry"))):
                state, flow = State.unpack(entry), Flow.unpack(before)
                state = flow.after(state, r) if flow else state
                out = _sessions(_unpacked_clicks(data, n), state, r, at << 32 | part)
                if out.num_rows:
                    yield out

    return run


def _sessions(cols: list[np.ndarray], s: State | None, r: Rules, place: int) -> pa.RecordBatch:
    late = cols[3]
    client, click, us, _, final, cents = (c[~late] for c in cols)
    n = len(us)
    lo = islands(client, us, final, r.gap) if n else np.zeros(0, np.int64)
    first = lo.copy()
    known = s is not None and n > 0 and s.client == client[0]
    joined = known and not s.final and us[0] - s.last < r.gap
    if joined:
        end = lo[1] if len(lo) > 1 else n
        first[0] = np.searchsorted(us[:end], s.start + r.length, "right")
    starts = lockstep(us, lo, first, r.length) if n else lo
    # stretches of clicks: what the open session still takes (perhaps nothing), then the sessions that start here
    bounds = np.concatenate([[0], starts, [n]])
    a, e = bounds[:-1], bounds[1:]
    k = len(a)
    reason = np.full(k, None, object)
    if n:
        nxt = np.minimum(e, n - 1)
        prev = np.maximum(e - 1, 0)
        gone = us[nxt] - us[prev] >= r.gap
        reason[:] = np.where(final[prev], "end", np.where(gone, "gap", "length"))
        other = client[nxt] != client[prev]
        reason[other] = np.where(final[prev[other]], "end", "none")
        if e[0] == 0:  # the open session takes no click here
            reason[0] = None if not known else "end" if s.final else "gap" if us[0] - s.last >= r.gap else "length"
    reason[-1] = None  # what follows lies in another block
    # late clicks follow the timely ones of their time, and go to the session of the timely click before them
    behind = (np.cumsum(~late) - 1)[late]
    own = np.maximum(behind, 0)
    who = cols[0][late]
    fits = (behind >= 0) & (client[own] == who) if n else np.zeros(len(who), bool)
    to = np.where(fits, np.searchsorted(starts, own, "right"), 0)
    if s is not None:
        fits |= (behind < 0) & (who == s.client)
    n_late = np.bincount(to[fits], minlength=k)
    sums = np.concatenate([[0], np.cumsum(cents)])
    has = e > a
    ids, begun, whose = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    ids[1:], begun[1:], whose[1:] = click[starts], us[starts], client[starts]
    if s is not None:
        ids[0], begun[0], whose[0] = s.session, s.start, s.client
    whole = np.ones(k, bool)
    whole[[0, -1]] = False
    keep = np.ones(k, bool)
    keep[0] = s is not None and bool(has[0] or n_late[0] or reason[0] is not None)
    last = us[np.maximum(e - 1, 0)] if n else np.zeros(k, np.int64)
    ended = final[np.maximum(e - 1, 0)] if n else np.zeros(k, bool)
    cols = [
        pa.array(whose), pa.array(ids), pa.array(begun), pa.array(last, mask=~has), pa.array(e - a), pa.array(n_late), pa.array(sums[e] - sums[a]),
        pa.array(reason, pa.string()), pa.array(ended, mask=~has), pa.array(whole), pa.array(np.full(k, place, np.int64)),
        pa.ListArray.from_arrays(pa.array(np.append(a, n).astype(np.int32)), pa.array(click)),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PARTS.split(", ")]).filter(pa.array(keep))


def sessionise(clicks: DataFrame, final: Column, gap: int = 10 * MINUTE, length: int = 40 * MINUTE, lateness: int = 360 * MINUTE, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path) for each session of clicks.

    clicks: click_id, client_id (long), ts, arrived_at (timestamps), value (double); final: a condition on them. Times in microseconds. A
    click arriving over `lateness` after ts is late; one without arrival is not. path holds click ids by ts, click_id.
    Rows with a null click_id, client_id or ts take no part; of other rows that share a click_id, the smallest (client, ts, ...) counts.
    A null, NaN or infinite value counts as 0. Clicks of the same ts go by click_id; late ones of a client before its first
    timely click are in no session. Other columns are not read. No rows, no result.
    """
    small_batches(clicks.sparkSession)
    r = Rules(gap, length)
    late = F.coalesce(F.col("arrived_at") > F.col("ts") + F.make_dt_interval(secs=F.lit(lateness / 1e6)), F.lit(False))
    cents = F.when(F.abs("value") < 9e16, F.floor(F.col("value") * 100 + 0.5)).otherwise(0).cast("long")
    used = clicks.select(F.col("click_id").cast("long").alias("click_id"), F.struct(F.col("client_id").cast("long").alias("client_id"), "ts", late.alias("late"), F.coalesce(final, F.lit(False)).alias("final"), cents.alias("cents")).alias("c"))
    once = used.where("click_id is not null and c.client_id is not null and c.ts is not null").groupBy("click_id").agg(F.min("c").alias("c")).select("click_id", "c.*")
    dealt = once.repartitionByRange("client_id", "ts", "late", "click_id").sortWithinPartitions("client_id", "ts", "late", "click_id")
    blocks = materialize(dealt.mapInArrow(lean(_blocks(r, chunk)), "id long, part long, n long, data binary, flow binary"), "blocks")
    entry = _entries(blocks.where("data is null").select("id", "flow"), r, fan)
    # a row for each range: no broadcast, as their number grows with the input
    parts = blocks.where("data is not null").join(entry.hint("shuffle_hash"), "id").select("id", "part", "n", "data", "flow", "entry")
    parts = materialize(parts.mapInArrow(lean(_parts(r)), PARTS), "parts")
    names = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents"]
    pieces = F.array_sort(F.collect_list(F.struct("place", "path")))
    sums = [F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *(F.sum(c).alias(c) for c in names[4:])]
    ended = F.max(F.when(F.col("n_clicks") > 0, F.struct("place", "final")))["final"]
    joined = parts.where("not whole").groupBy("client_id", "session_id").agg(*sums, F.coalesce(F.max("closed_by"), F.when(ended, "end").otherwise("none")).alias("closed_by"), F.flatten(F.transform(pieces, lambda p: p["path"])).alias("path"))
    return parts.where("whole").select(*names, "closed_by", "path").unionByName(joined.select(*names, "closed_by", "path"))
