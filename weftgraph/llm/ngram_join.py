"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct word shingles, hashed to 64 bits. Two documents link when their sets' Jaccard
similarity reaches the threshold.

1. Entry. Sets of sizes a and b that link differ in at most (a + b)(1 - t) / (1 + t) shingles. Shingles are hashed
   into more bands than that, for size classes that hold both partners, so at least one band is equal in both. Where a
   set fills more bands than it can differ in, an equal one is among those, and its empty bands are left out.
   Documents with an equal band meet in a bucket; buckets with the same members count once.
2. Bound. Shingles hashed into groups, the more the larger the set, give each set a vector of counts. The overlap of two sets is at most the sum over
   groups of the smaller count. Within a bucket, documents whose bound reaches the needed overlap are chained (no
   pairs are made of those that are connected anyway). Components of the chains hold all links.
3. R-tree. The count vectors of a component are packed into a tree of bounding boxes; a set's overlap with any set below
   a node is at most the sum over coordinates of the smaller of its own count and the box's upper edge. What is left
   is verified on the shingles themselves; links give the final components.

Buckets and components above a bounded size are compared block by block, so no task holds an unbounded group. A large
component is first compared inside its blocks; of the classes found there one row each meets those of other blocks; and
only where a component still holds several classes do the rows outside its largest class meet all others. A group of
near copies, however large, is one class by then, so the work of verification on it grows with its rows, not with their square. A band
that more than BUCKET_ROWS sets share goes the same way before: it is cut into blocks while it is read, each a bucket; then one row of
each class in which these and all other buckets have put its sets meets the others; and only in bands where classes are left do
the rows outside the largest meet all others. Sets that are near each other cost in proportion to their number; what is left
to compare by pairs of blocks are sets that share a band and have no chain between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, Prime, Roll, append_columns, as_long, block_pairs, block_pairs_beside, blocks_of, column, lean, mix64, small_batches, whole_groups, whole_groups_many
from weftgraph.operators.components import connected_components
from weftgraph.session import materialize

GROUPS = 64
#: Sizes from which a count vector has four times as many groups, so that a group holds few shingles and bounds tightly.
FINER_FROM = (400, 1600, 6400)
PAIR_CELLS = 4_000_000
BUCKET_ROWS = 4000
LEAF = 16
CHUNK_BYTES = 500_000
#: Sets that a map task remembers to find exact copies.
KNOWN_SETS = 100_000
BLOCK_ROWS, BLOCK_BYTES = 500, 8_000_000
#: Blocks of rows that must meet the rows of other blocks: larger ones are copied less often.
PAIR_ROWS = 2000
SALTS = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_roll, _prime = Roll(7), Prime(7)


def chunks(texts: Iterable[str | bytes | None], words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Positions and sorted distinct shingle hashes, some texts at a time; with fewer words the whole sequence is one shingle; without words none."""
    todo, at, size = [], [], 0
    for i, t in enumerate(texts):
        todo.append((t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"").lower())
        at.append(i)
        size += len(todo[-1])
        if size >= CHUNK_BYTES:
            yield at, _chunk(todo, words)
            todo, at, size = [], [], 0
    if todo:
        yield at, _chunk(todo, words)


def shingle_sets(texts: Iterable[str | bytes | None], words: int) -> list[np.ndarray]:
    return [s for _, sets in chunks(texts, words) for s in sets]


def _chunk(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    start, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    word = _roll.spans(_roll.prefix(data), start, end) + mix64(_prime.spans(_prime.prefix(data), start, end))  # two kinds of hash
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    cut = np.searchsorted(start, bounds + 1)
    mult = mix64(np.arange(1, words + 1, dtype=np.uint64)) | U64(1)
    n = len(word) - words + 1
    full = mix64(sum((word[k : k + n] * mult[k] for k in range(1, words)), word[:n] * mult[0])) if n > 0 else np.zeros(0, U64)
    out = []
    for a, b in zip(cut, cut[1:]):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(mix64(sum((word[a + k : a + k + 1] * mult[k] for k in range(b - a)), np.array([b - a], U64))))
        else:
            out.append(np.zeros(0, U64))
    return out


class Bands:
    """Size classes, each with a number of bands above the most shingles in which two linked sets can differ."""

    def __init__(self, threshold: Fraction) -> None:
        self.t, self.upper, self.count, self.made = threshold, [0], [1], {}

    def of(self, n: int) -> int:
        while self.upper[-1] < n:
            top = int((self.upper[-1] + 1) / self.t)
            self.upper.append(top)
            most = self.differ(top, top)
            self.count.append(most + most // 8 + 2)  # some more than needed, so that enough are filled
        return int(np.searchsorted(self.upper, n))

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of these sizes differ."""
        return int((a + b) * (1 - self.t) / (1 + self.t))

    def keys(self, s: np.ndarray) -> np.ndarray:
        """A hash for each band of the set's own class, and of the next, where larger partners are.

        If the filled bands outnumber the most shingles in which a linked set differs, one of them is equal in both,
        and the empty ones, which unlike sets share, are left out.
        """
        c, out = self.of(len(s)), []
        self.of(self.upper[c] + 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(s)])
        for k in (c, c + 1):
            edges, tag = self._edges(k)
            cut = np.searchsorted(s, edges)
            cut[-1] = len(s)
            hashes, filled = mix64((sums[cut[1:]] - sums[cut[:-1]]) ^ tag), cut[1:] > cut[:-1]
            most = self.differ(len(s), min(int(len(s) / self.t), self.upper[k]))
            out.append(hashes[filled] if filled.sum() > most else hashes)
        return np.concatenate(out)

    def _edges(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The least hash of each band of a class (bands are stretches of equal length), and the bands' tags."""
        if k not in self.made:
            bands = self.count[k]
            low = np.array([-(-(b << 32) // bands) << 32 for b in range(bands)] + [2**64 - 1], U64)
            self.made[k] = low, (np.arange(bands, dtype=np.uint64) + U64(k << 32)) * U64(0xD6E8FEB86659FD93)
        return self.made[k]


BAND_ROWS = "key long, doc long, other long, n long, vec binary"


def _rows(key: np.ndarray, doc: np.ndarray, other=None, n=None, vec=None) -> pa.RecordBatch:
    rest = [pa.nulls(len(doc), k) if x is None else pa.array(x, k) for x, k in ((other, pa.int64()), (n, pa.int64()), (vec, pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), *rest], ["key", "doc", "other", "n", "vec"])


def _bands_of(words: int, threshold: Fraction):
    """A row for each document (n, and vec if it has words), for each copy of a set met before (other), and for each band of the rest."""

    def run(batches):
        bands, known = Bands(threshold), {}
        for b in batches:
            ids, texts = column(b, "doc_id").to_pylist(), column(b, "text")
            for at, sets in chunks((x.as_py() for x in texts), words):
                doc, vec, copies, fresh, keys = [ids[i] for i in at], [], [], [], []
                for d, s in zip(doc, sets):
                    vec.append(None)
                    if d is None or not len(s):
                        continue
                    print_ = s.tobytes() if len(s) < 3 else np.array([len(s), s.sum(), (s * s).sum()], U64).tobytes()
                    if (f := known.setdefault(print_, d)) != d:
                        copies.append((d, f))
                        continue
                    vec[-1] = _vector(s)
                    keys.append(bands.keys(s))
                    fresh.append(d)
                spread = [hash(d) % (1 << 60) if d is not None else at[i] for i, d in enumerate(doc)]
                yield _rows(spread, doc, n=[len(s) for s in sets], vec=vec)
                if copies:
                    u, v = zip(*copies)
                    yield _rows([x % (1 << 60) for x in u], u, other=v)
                if fresh:
                    yield _rows(as_long(np.concatenate(keys)), np.repeat(np.array(fresh, np.int64), [len(k) for k in keys]))
            if len(known) > KNOWN_SETS:
                known.clear()

    return run


def _vector(s: np.ndarray) -> bytes:
    """Counts by group; if a count does not fit, all are the largest, which bounds nothing out."""
    groups = GROUPS * 4 ** sum(len(s) >= k for k in FINER_FROM)
    c = np.bincount((s % U64(groups)).astype(np.int64), minlength=groups)
    return (c if c.max() < 65535 else np.full(len(c), 65535)).astype("<u2").tobytes()


def _starts(doc: np.ndarray, most: int) -> np.ndarray:
    """Where the blocks of a hot band begin: at rows picked by their id's hash, so that bands of the same sets have the same blocks, and after `most` rows."""
    at = np.unique(np.concatenate([[0], np.flatnonzero(mix64(doc.astype(U64)) % U64(max(most // 2, 1)) == 0)]))
    return np.concatenate([np.arange(s, e, most) for s, e in zip(at, np.append(at[1:], len(doc)))])


def _buckets(most: int):
    """Of rows sorted by key and doc: band rows become (bucket, doc) for every band with several documents; all others pass.

    The bucket's number is made of its members. A band of more than `most` members becomes a bucket for each of its blocks, with a
    row (bucket, hot) that says which band it is of; no more than some blocks of it are held at a time.
    """
    names = ["bucket", "doc", "other", "n", "vec", "hot"]

    def batch(bucket, doc=None, hot=None):
        cols = [pa.array(bucket), *(pa.nulls(len(bucket), pa.int64()) if x is None else pa.array(x) for x in (doc, None, None)), pa.nulls(len(bucket), pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(bucket), pa.int64()) if hot is None else pa.array(hot)], names)

    def numbers(doc, at, size):
        return as_long(mix64(np.add.reduceat(mix64(doc.astype(U64)), at) + size.astype(U64)))

    def cut(key, doc):
        at = _starts(doc, most)
        size = np.diff(np.append(at, len(doc)))
        number = numbers(doc, at, size)
        yield batch(np.repeat(number, size), doc)
        yield batch(number, hot=np.full(len(at), key))

    def made(k, d, begun):
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(k)))
        large = size > most
        large[:1] |= begun
        if (small := (size > 1) & ~large).any():
            pick = np.repeat(small, size)
            yield batch(np.repeat(numbers(d, at, size), size)[pick], d[pick])
        for g in np.flatnonzero(large):
            yield from cut(k[at[g]], d[at[g] : at[g] + size[g]])

    def run(batches):
        key, doc, begun = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for b in batches:
            other, n = column(b, "other"), column(b, "n")
            band = np.asarray(other.is_null()) & np.asarray(n.is_null())
            p = b.filter(pa.array(~band))
            if p.num_rows:
                none = pa.nulls(p.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, *(column(p, c) for c in names[1:5]), none], names)
            key = np.concatenate([key, column(b, "key").to_numpy()[band]])
            doc = np.concatenate([doc, column(b, "doc").filter(pa.array(band)).to_numpy()])
            if len(key) and key[0] != key[-1]:
                last = np.searchsorted(key, key[-1])
                yield from made(key[:last], doc[:last], begun)
                key, doc, begun = key[last:], doc[last:], False
            if len(key) > 2 * most:  # a single band
                last = _starts(doc, most)[-1]
                yield from cut(key[0], doc[:last])
                key, doc, begun = key[last:], doc[last:], True
        yield from made(key, doc, begun)

    return run


def _matrix(vectors: list[bytes], groups: int) -> np.ndarray:
    """Count vectors as rows of so many groups; finer ones are folded."""
    if all(len(v) == 2 * groups for v in vectors):
        return np.frombuffer(b"".join(vectors), "<u2").reshape(len(vectors), groups).astype(np.int32)
    return np.array([np.frombuffer(v, "<u2").reshape(-1, groups).sum(0) for v in vectors], np.int32)


def _bounded(threshold: Fraction):
    """Chains of documents that share a bucket and whose bound reaches what they need."""
    t = float(threshold)

    def near(c, n, i, j):
        need = t / (1 + t) * (n[i] + n[j]) - 1e-9
        fits = (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9) & (np.minimum(c[i], c[j]).sum(-1) >= need)
        return fits | (n[i] < 0) | (n[j] < 0)

    def chained(doc, n, c, at, size):
        """Pairs within the buckets of sizes `size` that start at `at`."""
        us, vs, step = [], [], max(1, PAIR_CELLS // c.shape[1])
        for m in np.unique(size[(size > 1) & (size <= 16)]):
            lo, (p, q) = at[size == m], np.triu_indices(m, 1)
            i, j = (lo[:, None] + p).ravel(), (lo[:, None] + q).ravel()
            for k in range(0, len(i), step):
                hit = near(c, n, i[k : k + step], j[k : k + step])
                us.append(doc[i[k : k + step][hit]])
                vs.append(doc[j[k : k + step][hit]])
        for s in np.flatnonzero(size > 16):
            rows = np.arange(at[s], at[s] + size[s])
            while len(rows) > 1:  # grow one component at a time; a row is compared with those not yet in any
                wave, rows = rows[:1], rows[1:]
                while len(wave) and len(rows):
                    hit = np.concatenate([near(c, n, rows[k : k + step], wave[:1]) for k in range(0, len(rows), step)])
                    us.append(doc[rows[hit]])
                    vs.append(np.full(hit.sum(), doc[wave[0]]))
                    wave, rows = np.concatenate([wave[1:], rows[hit]]), rows[~hit]
        return us, vs

    def run(batches):
        for g in whole_groups_many(batches, "bucket"):
            key, doc, n, vec = g.column("bucket").to_numpy(), g.column("doc").to_numpy(), g.column("n").to_numpy(), g.column("vec")
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size, us, vs = np.diff(np.append(at, len(key))), [], []
            groups = np.minimum.reduceat(pc.binary_length(vec).to_numpy() // 2, at)
            for k in np.unique(groups):  # a bucket is compared as finely as all its members allow
                rows, own = np.flatnonzero(np.repeat(groups == k, size)), size[groups == k]
                made = chained(doc[rows], n[rows], _matrix(vec.take(pa.array(rows)).to_pylist(), int(k)), np.cumsum(own) - own, own)
                us += made[0]
                vs += made[1]
            if us and len(u := np.concatenate(us)):
                v = np.concatenate(vs)
                pair = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])

    return run


class RTree:
    """Count vectors packed by size and counts; boxes keep upper edges and the size range, level by level."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.levels = [(vectors, sizes, sizes)]
        while len(self.levels[-1][0]) > LEAF:
            high, small, large = self.levels[-1]
            at = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))

    def search(self, vector: np.ndarray, size: int, t: float) -> np.ndarray:
        """Positions whose overlap bound reaches what a set of this size needs."""
        found = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, small, large = self.levels[depth]
            found = found[(large[found] >= t * size - 1e-9) & (small[found] * t <= size + 1e-9)]
            need = np.maximum(small[found], t * size)
            bound = np.minimum(high[found], vector).sum(1)
            found = found[bound >= t / (1 + t) * (need + size) - 1e-9]
            if depth:
                found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
                found = found[found < len(self.levels[depth - 1][0])]
        return found


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    where = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) % U64(GROUPS)).astype(np.int64)
    return np.bincount(where * GROUPS + group, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS)


def linked(sets: list[np.ndarray], side: np.ndarray, ids: np.ndarray, threshold: Fraction, label: np.ndarray) -> np.ndarray:
    """The labels, after those of linked sets are made the smallest of them; sets of one label are not compared, and with two sides only those across."""
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i])))
    sets, side, root = [sets[i] for i in order], side[order], label[order]
    vectors, sizes = _counts(sets), np.array([len(s) for s in sets])
    tree = RTree(vectors, sizes)
    across, t, p, q = side.min() != side.max(), float(threshold), threshold.numerator, threshold.denominator
    for i in range(len(sets)):
        near = tree.search(vectors[i], int(sizes[i]), t)
        near = near[near < i]
        if across:
            near = near[side[near] != side[i]]
        while len(near := near[root[near] != root[i]]):
            j, near = near[-1], near[:-1]
            a, b = sets[j], sets[i]
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if q * common >= p * (len(a) + len(b) - common):
                root[(root == root[i]) | (root == root[j])] = min(root[i], root[j])
    out = np.empty_like(root)
    out[order] = root
    return out


def _verify(words: int, threshold: Fraction):
    """Classes (v, smaller) that classes (u) of a task turn out to be part of."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for g in whole_groups(batches, ["component", "i", "j"]):
            ids, side, label = g.column("node").to_numpy(), g.column("side").to_numpy(), g.column("class").to_numpy()
            if (label == label[0]).all():
                continue
            sets = shingle_sets((unpack.decompress(z.as_py()) for z in g.column("packed")), words)
            made = linked(sets, side, ids, threshold, label)
            if (pick := made != label).any():
                u, v = np.unique(np.stack([label[pick], made[pick]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _pack(b: pa.RecordBatch) -> list:
    pack = zstandard.ZstdCompressor(level=6)
    return [[None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in column(b, "text").to_pylist()]]


def packed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, packed): texts as zstd frames, a third of what a shuffle of texts would move."""
    return append_columns(docs.select("doc_id", "text"), "packed binary", _pack).select("doc_id", "packed")


def _classes(sized: DataFrame, rows: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """(node, component): of the rows of sized (node, component, bytes), those that link with a row of smaller id in what is connected."""

    def verified(tasks: DataFrame, texts: DataFrame, **more: Column) -> DataFrame:
        texts = materialize(tasks, "blocks").join(texts, F.col("node") == F.col("doc_id")).drop("doc_id").withColumns(more)
        texts = texts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
        return materialize(texts.mapInArrow(lean(_verify(words, threshold)), "u long, v long"), "links")

    def renamed(members: DataFrame, links: DataFrame) -> DataFrame:
        # dealt by class and a salt made of the row, so that the rows of a large class are spread
        known = links.select(F.col("u").alias("class"), F.col("v").alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        # no broadcast: planned by the size of what is on disk, the salted lookup would be many times that
        return salted.join(known.hint("merge"), ["class", "salt"], "left").withColumn("class", F.coalesce("whole", "class")).drop("whole", "salt")

    def joined(links: DataFrame) -> DataFrame:
        return links if links.isEmpty() else connected_components(links).select(F.col("node").alias("u"), F.col("component").alias("v"))

    # 1. inside each block; a row is in one block only, so what a task finds are classes
    dealt = sized.join(blocks_of(sized, BLOCK_ROWS, BLOCK_BYTES), "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    texts = packed(rows.where("text is not null"))
    inside = verified(dealt.select("node", "component", "i"), texts, j=F.col("i"), side=F.lit(0), **{"class": F.col("node")})
    found = inside.select(F.col("u").alias("node"), F.col("v").alias("component"))
    large = materialize(dealt.where("blocks > 1").select("node", "component", "bytes"), "large")
    if large.isEmpty():
        return found
    texts = materialize(texts.join(large, F.col("doc_id") == F.col("node"), "left_semi"), "texts")
    # 2. a row of each class with those of other blocks; a class is named after its smallest row
    first = materialize(renamed(large.withColumn("class", F.col("node")), inside), "classes")
    among = verified(block_pairs(first.where("class = node").drop("class"), PAIR_ROWS, BLOCK_BYTES), texts, **{"class": F.col("node")})
    left = materialize(renamed(first, joined(among)), "classes")
    # 3. where classes are left, all rows outside the largest with all rows of others
    sizes = left.groupBy("component", "class").count().groupBy("component")
    sizes = materialize(sizes.agg(F.max_by("class", F.struct("count", "class")).alias("largest"), F.count("*").alias("n")).where("n > 1"), "several")
    if not sizes.isEmpty():
        rest = left.join(sizes, "component").withColumn("main", F.col("class") == F.col("largest")).select("node", "component", "bytes", "class", "main")
        tasks = block_pairs_beside(rest, PAIR_ROWS, BLOCK_BYTES).select("node", "component", "class", "i", "j", "side")
        left = renamed(left, joined(verified(tasks, texts)))
    whole = left.select("node", F.col("class").alias("component"))
    return found.join(whole, "node", "left_anti").unionByName(whole)


def _with_hot(members: DataFrame, blocks: DataFrame, vectors: DataFrame, chains: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, component) of what chains (u, v) connect, and of chains between the blocks (bucket, hot) of hot bands.

    members (bucket, doc) are those of all buckets, chains those found inside them.
    """
    found = connected_components(chains)
    if blocks.isEmpty():
        return found
    # bands of the same blocks count once
    sign = blocks.groupBy("hot").agg(F.bit_xor("bucket").alias("x"), F.sum(F.pmod(F.xxhash64("bucket"), F.lit(1 << 40))).alias("s"), F.count("*").alias("k"))
    bands = blocks.join(sign.groupBy("x", "s", "k").agg(F.min("hot").alias("hot")), "hot").select("hot", "bucket")
    rows = materialize(members.join(bands, "bucket").select("hot", F.col("doc").alias("node")).distinct(), "hot")

    def several() -> DataFrame:
        """The rows of bands that hold more than one class, with their class."""
        placed = rows.join(found, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        open_ = placed.groupBy("hot").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
        # dealt by band and a salt made of the row, so that the rows of a hot band are spread
        open_ = open_.select("hot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        return materialize(placed.join(open_.hint("merge"), ["hot", "salt"]).select("node", F.col("hot").alias("component"), "class", F.lit(1).alias("bytes")), "open")

    def bounded(tasks: DataFrame) -> DataFrame:
        met = tasks.select(F.xxhash64("component", "i", "j").alias("bucket"), F.col("node").alias("doc")).join(vectors, "doc")
        made = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_bounded(threshold)), "u long, v long")
        made = materialize(made, "chains")
        return connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(made))

    left = several()
    if not left.isEmpty():
        found = bounded(block_pairs(left.groupBy("component", "class").agg(F.min("node").alias("node"), F.min("bytes").alias("bytes")), PAIR_ROWS, BLOCK_BYTES))
        left = several()
        if not left.isEmpty():
            sizes = left.groupBy("component", "class").count().groupBy("component").agg(F.max_by("class", F.struct("count", "class")).alias("largest"))
            beside = left.join(sizes, "component").withColumn("main", F.col("class") == F.col("largest")).select("node", "component", "bytes", "main")
            found = bounded(block_pairs_beside(beside, PAIR_ROWS, BLOCK_BYTES))
    return found


def join(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id long, text string).

    Words are runs of characters other than space and U+0009 to U+000D, A-Z in lower case. Documents without words, null
    texts and null ids link with nothing. Rows that repeat a doc_id share its component, with all that any of
    their texts links with. No rows, no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands = rows.mapInArrow(lean(_bands_of(words, threshold)), BAND_ROWS)
    met = bands.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(lean(_buckets(BUCKET_ROWS)), "bucket long, doc long, other long, n long, vec binary, hot long")
    met = materialize(met, "buckets")
    vectors = met.where("vec is not null").groupBy("doc").agg(F.max("n").alias("n"), F.max_by("vec", "n").alias("vec"), F.min(F.xxhash64("n", "vec")).alias("a"), F.max(F.xxhash64("n", "vec")).alias("b"))
    # an id with several sets: a size below 0 says that nothing is known of it, so that it is bounded out nowhere
    vectors = vectors.select("doc", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(-1).alias("n"), "vec")
    members = met.where("bucket is not null and hot is null").select("bucket", "doc").distinct()
    chains = members.join(vectors, "doc").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_bounded(threshold)), "u long, v long")
    same = met.where("other is not null").select(F.col("doc").alias("u"), F.col("other").alias("v"))
    blocks = met.where("hot is not null").select("bucket", "hot").distinct()
    # written first: components start in Python too, and a task would keep a worker for each of the two
    chains = materialize(chains.unionByName(same), "chains")
    candidates = _with_hot(members, blocks, vectors, chains, threshold)
    sized = candidates.join(rows.select("doc_id", F.octet_length("text").alias("bytes")), F.col("node") == F.col("doc_id")).groupBy("node", "component").agg(F.max("bytes").alias("bytes"))
    found = _classes(sized, rows, words, threshold)
    counts = met.where("n is not null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"))
    out = counts.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
