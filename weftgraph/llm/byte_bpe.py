"""Byte-level BPE: ranked merges of the bytes of each distinct word, and decoding by concatenated pieces.

Two forms of one operator. `encode_words` folds the ranked merges with Spark's higher-order functions over a
table of distinct words, looking pairs up in a literal rank map. `encode_documents` serves whole corpora: it
splits each text, folds the same merges for each distinct word that a task meets, keeps the result in a bounded
cache, and concatenates. Bringing the ids of distinct words back to the places of a corpus by a join would
shuffle every word of it, so the second form is the one for documents (figures in the README).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import append_columns, column, small_batches

#: Distinct words kept by a Python worker before the cache starts anew.
CACHE_WORDS = 50_000
#: Rows of an Arrow batch; their new words are merged together.
BATCH = 200
#: Words of more bytes are merged through a heap and not cached.
LONG_WORD = 64
#: Words folded together.
FOLD_ROWS = 4096
NONE = 1 << 62
NO_RANK = np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of lowest rank merges, leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while pair and (best := min(pair)) != NONE:
        at = pair.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = get(parts[at] + parts[at + 1], NONE)
        if at:
            pair[at - 1] = get(parts[at - 1] + parts[at], NONE)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] > 0 else -1
        if j < 0 or end[j] != stop:
            continue
        end[i], after[i], end[j] = stop, after[j], 0
        if after[i] >= 0:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i] > 0]


class Merger:
    """Folds the ranked merges over many words at once: in each round every word merges its pair of lowest rank.

    Words lie in rows of equal width. A merge writes the new symbol at the left place, takes the right place out of the
    row by its neighbours' links, and looks up the two pairs that the new symbol takes part in.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, get = ranks, ranks.get
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        del pairs
        #: Stands where a row has no symbol; no pair holds it.
        self.gap = max(ranks.values(), default=-1) + 1
        self.wide = 16 if self.gap < 1 << 16 else 32
        kind = np.uint32 if self.wide == 16 else np.uint64
        self.byte = np.array([get(bytes([i]), self.gap) for i in range(256)], np.int32)
        self.two = np.full(1 << 16, NO_RANK, np.int32)
        for k, r in ranks.items():
            if len(k) == 2:
                self.two[k[0] << 8 | k[1]] = r
        bits = max(4, int(len(rank)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.zeros(1 << bits, kind), np.full(1 << bits, -1, np.int32)
        key = (left << self.wide | right).astype(kind)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # open addressing, a round for each further probe
            free = self.to[slot[todo]] < 0
            at, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[at], self.to[at] = key[won], rank[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of symbols; NO_RANK where they do not merge."""
        key = left.astype(self.keys.dtype) << self.keys.dtype.type(self.wide) | right.astype(self.keys.dtype)
        slot = self._slot(key)
        out, there = self.to[slot], self.keys[slot]
        todo = np.flatnonzero((there != key) & (out >= 0))
        out[there != key] = NO_RANK
        out[out < 0] = NO_RANK
        slot, key = slot[todo], key[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            to, hit = self.to[slot], self.keys[slot] == key
            done = hit & (to >= 0)
            out[todo[done]] = to[done]
            go = ~hit & (to >= 0)
            todo, slot, key = todo[go], slot[go], key[go]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        todo: dict[int, list[int]] = {8: [], 16: [], 32: [], LONG_WORD: []}
        get = self.ranks.get
        for i, w in enumerate(words):
            if (r := get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif (n := len(w)) > LONG_WORD:
                out[i] = np.array(_merge_long(w, self.ranks), "<u4").tobytes()
            else:
                todo[8 if n <= 8 else 16 if n <= 16 else 32 if n <= 32 else LONG_WORD].append(i)
        for width, rows in todo.items():
            for k in range(0, len(rows), FOLD_ROWS):
                part = rows[k : k + FOLD_ROWS]
                for i, ids in zip(part, self._fold([words[i] for i in part], width)):
                    out[i] = ids
        return out

    def _fold(self, words: list[bytes], width: int) -> list[bytes]:
        n, row = len(words), width + 2  # after the last place one that ends the row, and one that comes before the first
        size = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        symbol = np.full((n, row), self.gap, np.int32)
        symbol[:, :width] = np.where(inside, self.byte[data], self.gap)
        pair = np.full((n, row), NO_RANK, np.int32)
        pair[:, : width - 1] = np.where(inside[:, 1:], self.two[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]], NO_RANK)
        after = np.arange(1, n * row + 1, dtype=np.int32)
        before = np.arange(-1, n * row - 1, dtype=np.int32).reshape(n, row)
        before[:, 0] += row
        flat, flat_pair, before, start = symbol.ravel(), pair.ravel(), before.ravel(), np.arange(n) * row
        live = np.arange(n)
        while len(live):
            at = start[live] + pair[live, :width].argmin(1)
            best = flat_pair[at]
            go = best != NO_RANK
            live, at, best = live[go], at[go], best[go]
            right = after[at]
            flat[at], flat[right], flat_pair[right] = best, self.gap, NO_RANK
            right = after[right]
            after[at], before[right] = right, at
            left = before[at]
            flat_pair[at] = self.rank(best, flat[right])
            flat_pair[left] = self.rank(flat[left], best)
        kept = symbol != self.gap
        ends = np.cumsum(kept.sum(1) * 4).tolist()
        made = symbol[kept].astype("<u4").tobytes()
        return [made[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merger, self.split, self.words, self.runs = Merger(ranks), regex.compile(pattern).findall, {}, {}
        self.by_run = " ?\\p{L}+" in pattern
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.pieces[v] = k

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; those met for the first time are merged together."""
        known = self.words
        if len(known) >= CACHE_WORDS:
            known.clear()
        new = [w for w in set(words) if w not in known]
        long = {}
        for w, x in zip(new, self.merger.encode([w.encode("utf-8", "surrogatepass") for w in new])):
            (known if len(w) <= LONG_WORD else long)[w] = x
        return [known.get(w) or long[w] for w in words] if long else list(map(known.__getitem__, words))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = list(map(self.split, texts))
        ids = iter(self._ids([w for words in found for w in words]))
        return [b"".join(itertools.islice(ids, len(words))) for words in found]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that follow a space, taken with it. They are split as one text: only a run's start holds a space."""
        if not runs:
            return []
        words = self.split(" " + " ".join(runs))
        ids = self._ids(words)
        if len(words) == len(runs):
            return ids
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A single space before a visible character starts a match of the pattern, whatever stands before it: white space
        in front of the space is a match of its own. So the runs between spaces are encoded one by one, and kept, except
        in texts where a space comes before white space or the end.
        """
        if not self.by_run:
            return self._whole([x or "" for x in texts])
        known = self.runs
        if len(known) >= CACHE_WORDS:
            known.clear()
        parts = [x.split(" ") if x else [""] for x in texts]
        heads, get = [p.pop(0) for p in parts], known.get
        got = [list(map(get, p)) for p in parts]
        new: set[str] = set()
        gaps = []
        for i, (p, g) in enumerate(zip(parts, got)):
            if None in g:
                missing = [k for k, x in enumerate(g) if x is None]
                new.update([p[k] for k in missing])
                gaps.append((i, missing))
        split = {r for r in new if not r or r[0].isspace()}
        whole = [i for i, missing in gaps if any(parts[i][k] in split for k in missing)] if split else []
        runs = list(new - split)
        fresh = dict(zip(runs, self._runs(runs)))
        for i, missing in gaps:
            p, g = parts[i], got[i]
            for k in missing:
                g[k] = fresh.get(p[k])
        for i in whole:
            heads[i], got[i] = "", []
        out = [h + b"".join(g) for h, g in zip(self._whole(heads), got)]
        for i, x in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = x
        known.update(fresh if max(map(len, runs), default=0) <= LONG_WORD else {r: x for r, x in fresh.items() if len(r) <= LONG_WORD})
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(shared) -> Codec:
    """One for each broadcast and worker."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(*shared.value)
    return _codecs[shared.id]


def _share(df: DataFrame, ranks_path: str, pattern: str):
    small_batches(df.sparkSession, BATCH)
    return _Shared(df.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern)))  # the vocabulary file, of fixed size


class _Shared:
    def __init__(self, b) -> None:
        self.b, self.id = b, b._jbroadcast.id()

    def __reduce__(self):
        return _shared, (self.b, self.id)

    @property
    def value(self):
        return self.b.value


def _shared(b, i):
    made = object.__new__(_Shared)
    made.b, made.id = b, i
    return made


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and token_ids (binary, little-endian unsigned 32-bit integers).

    A null text counts as empty: no tokens and empty binary. Repeated rows and other columns stay as they are; a column
    of docs named like a new one is replaced, as in digests and decode_documents. No rows, no result.
    """
    shared = _share(docs, ranks_path, pattern)

    def run(b: pa.RecordBatch) -> list:
        c = codec(shared)
        ids = c.encode_all(column(b, text).to_pylist())
        return [[len(x) // 4 for x in ids], ids]

    return append_columns(docs, "n_tokens long, token_ids binary", run)


def decode_documents(tokens: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """tokens with decoded (binary), the concatenated pieces; null ids stay null."""
    shared = _share(tokens, ranks_path, "")

    def run(b: pa.RecordBatch) -> list:
        c = codec(shared)
        return [[None if x is None else c.decode(x) for x in column(b, ids).to_pylist()]]

    return append_columns(tokens, "decoded binary", run)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and token_ids if asked for; encodes and decodes in one pass."""
    shared = _share(docs, ranks_path, pattern)

    def run(b: pa.RecordBatch) -> list:
        c = codec(shared)
        ids = c.encode_all(column(b, text).to_pylist())
        out = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]]
        return [*out, ids] if keep_ids else out

    return append_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * keep_ids, run)


#: Parts of the literal rank map; a lookup in a Spark map reads the map through, so it is dealt out by key.
MAP_PARTS = 4096


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<hex, rank>>: a literal after constant folding, dealt by crc32 of the hex key."""
    import zlib

    parts: list[dict[str, int]] = [{} for _ in range(MAP_PARTS)]
    for k, v in ranks.items():
        key = k.hex().upper()
        parts[zlib.crc32(key.encode()) % MAP_PARTS][key] = v
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """words with ids array<int>: higher-order functions fold the ranked merges over the bytes of each distinct word.

    A null word gives null, an empty one no ids. For tables of distinct words of up to some dozen bytes.
    """
    table = rank_map(ranks)

    def rank(key: Column) -> Column:
        part = F.element_at(table, (F.crc32(key.cast("binary")) % MAP_PARTS + 1).cast("int"))
        return F.coalesce(F.try_element_at(part, key), F.lit(2**31 - 1))

    text = F.hex(F.col(word).cast("binary"))
    start = F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - 1, F.lit(2)), lambda i: F.substring(text, i, 2)))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: rank(F.concat(a, b)))
        best = F.array_min(pairs)
        at = F.array_position(pairs, best).cast("int")
        joined = F.concat(F.slice(parts, 1, at - 1), F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))), F.slice(parts, at + 2, F.size(parts)))
        return F.when((F.size(parts) > 1) & (best < 2**31 - 1), joined).otherwise(parts)

    rounds = F.sequence(F.lit(1), F.greatest(F.size(start) - 1, F.lit(1)))
    folded = F.aggregate(rounds, start, step)
    return words.withColumn("ids", F.when(F.col(word).isNotNull(), F.transform(folded, rank)))
