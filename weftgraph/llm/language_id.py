"""Language identification by hyperdimensional profiles.

Each letter of Unicode has a random vector of +1 and -1 of its own, drawn from its code point and a seed. A trigram's vector binds
(multiplies) its letters' vectors, the first rotated by two and the second by one; a document bundles (adds) its
trigrams' vectors, weighted by log(1 + count); a language's prototype bundles the unit vectors of its documents. The language
with the largest cosine is predicted, ties to the smaller name. Runs of characters that are not letters count as one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, append_columns, column, lean, mix64, small_batches

CHUNK_CHARS = 400_000
DIMS = 2048
#: Documents x trigrams and trigrams x dimensions held at once.
CELLS = 2_000_000
#: With fewer than one filled cell in so many, filled cells are added up one by one.
SPARSE = 24
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(points: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = np.arange(-(-dims // 64), dtype=np.uint64)
    bits = mix64(mix64(points.astype(U64)[:, None] + U64(seed << 32)) + words * U64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8), axis=1)[:, :dims] * 2).astype(np.int8) - 1


def _distinct(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, all below `most`, and the place of each code among them."""
    if most > CELLS:
        return np.unique(codes, return_inverse=True)
    flag = np.zeros(most, bool)
    flag[codes] = True
    return np.flatnonzero(flag), (np.cumsum(flag, dtype=np.int32) - 1)[codes]


class Encoder:
    def __init__(self, dims: int, seed: int) -> None:
        self.dims, self.seed = dims, seed

    def chunk(self, texts: list[str]) -> np.ndarray:
        low = [f" {x.lower()} " for x in texts]
        point = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        doc, first = np.repeat(np.arange(len(low)), sizes), np.zeros(len(point), bool)
        first[np.cumsum(sizes) - sizes] = True
        letter = letters()[point]
        keep = letter | first
        keep[1:] |= letter[:-1]
        point, doc = np.where(letter, point, 32)[keep], doc[keep]
        flag = np.zeros(int(point.max()) + 1, bool)
        flag[point] = True
        points = np.flatnonzero(flag)
        place, n = np.cumsum(flag) - 1, len(points)
        x = place[point]
        inside = doc[:-2] == doc[2:]
        codes, gram = _distinct(((x[:-2] * n + x[1:-1]) * n + x[2:])[inside], n**3)
        doc, wide = doc[2:][inside], max(1, CELLS // self.dims)
        out = np.zeros((len(low), self.dims), np.float32)
        v = letter_vectors(points, self.dims, self.seed)
        by_place = [np.roll(v, 2, 1), np.roll(v, 1, 1), v]
        grams = lambda c: (by_place[0][c // (n * n)] * by_place[1][c // n % n] * by_place[2][c % n]).astype(np.float32)
        if len(gram) * SPARSE < len(low) * len(codes):
            entry, count = np.unique(doc * len(codes) + gram, return_counts=True)
            row, weight = entry // len(codes), np.log1p(count.astype(np.float32))
            for k in range(0, len(entry), wide):
                r = row[k : k + wide]
                at = np.flatnonzero(np.diff(r, prepend=-1))
                out[r[at]] += np.add.reduceat(grams(codes[entry[k : k + wide] % len(codes)]) * weight[k : k + wide, None], at)
            return out
        step = max(1, CELLS // max(1, len(codes)))
        for d in range(0, len(low), step):
            s, e = np.searchsorted(doc, (d, d + step))
            rows = min(step, len(low) - d)
            count = np.bincount((doc[s:e] - d) * len(codes) + gram[s:e], minlength=rows * len(codes)).reshape(rows, -1)
            weight = np.log1p(count.astype(np.float32))
            for g in range(0, len(codes), wide):
                out[d : d + step] += weight[:, g : g + wide] @ grams(codes[g : g + wide])
        return out

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and whether it has a letter; all zeros where it is null or has none."""
        out, todo, size = np.zeros((len(texts), self.dims), np.float32), [], 0
        some = np.array([bool(x) and any(map(str.isalpha, x)) for x in texts], bool)
        for i, x in enumerate(texts):
            if some[i]:
                todo.append(i)
                size += len(x)
            if todo and (size >= CHUNK_CHARS or i == len(texts) - 1):
                out[todo] = self.chunk([texts[j] for j in todo])
                todo, size = [], 0
        return out, some


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(dims: int, seed: int) -> Encoder:
    if (dims, seed) not in _encoders:
        _encoders[dims, seed] = Encoder(dims, seed)
    return _encoders[dims, seed]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS, seed: int = 11) -> dict:
    """Prototypes from all rows with a language. Each task adds up its documents; only languages x dims sums reach the driver."""
    small_batches(labelled.sparkSession)

    def partial(batches):
        total: dict[str, np.ndarray] = {}
        enc = encoder(dims, seed)
        for b in batches:
            v, _ = enc.vectors(column(b, "text").to_pylist())
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(norm == 0, 1, norm)
            names = np.array(column(b, "lang").to_pylist(), object)
            for name in set(names):
                total[name] = total.get(name, 0) + v[names == name].sum(0, dtype=np.float64)
        for name, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s.tolist()], pa.list_(pa.float64()))], ["lang", "s"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(lean(partial), "lang string, s array<double>").select("lang", F.posexplode("s").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], np.zeros(dims))[r["i"]] = r["x"]
    names = sorted(k for k, v in found.items() if np.any(v))
    proto = np.array([found[k] / np.linalg.norm(found[k]) for k in names], np.float32).reshape(len(names), dims)
    return {"names": names, "prototypes": proto, "dims": dims, "seed": seed}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine with the prototype, negative ones as 0.

    A null text, or one without letters, is `und` with score 0, as is any text if the model has no language.
    Ties go to the smaller name. Repeated rows are judged alike; rows and other columns stay as they are, but one named like a new
    one is replaced. No rows, no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x dims numbers, whatever the corpus

    def run(b: pa.RecordBatch) -> list:
        m = shared.value
        v, some = encoder(m["dims"], m["seed"]).vectors(column(b, text).to_pylist())
        norm = np.linalg.norm(v, axis=1)
        if not m["names"]:
            return [["und"] * len(v), [0.0] * len(v)]
        cos = (v @ m["prototypes"].T) / np.where(norm == 0, 1, norm)[:, None]
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(v)), best].astype(float), 0, 1)
        return [[m["names"][k] if n else "und" for k, n in zip(best, some)], np.where(norm == 0, 0.0, score).tolist()]

    return append_columns(docs, "lang_pred string, score double", run)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict all; adds held_out, lang_pred and score."""
    held = held_out(F.col("doc_id"))
    return predict(docs.withColumn("held_out", held), fit(docs.where(~held)))
