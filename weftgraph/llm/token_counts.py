"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each trie node has a failure link, the node that holds what remains of its
string after the longest vocabulary pieces have been taken off its front, and the number of pieces so taken.
Reading a word byte by byte, following failure links where no child fits and adding their counts, gives the
number of pieces that greedy longest match would make, in time linear in the word, without building a piece.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftgraph.llm.common import append_columns, column, small_batches

#: Words are runs of letters, single digits and runs of other visible characters, in lower case, between white space as str.split has it.
WORD = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
CACHE_WORDS = 300_000


def load_vocabulary(path: str) -> list[bytes]:
    """Pieces of a vocabulary file that writes bytes as printable characters; marks of word ends are taken off."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    found = set()
    for p in pieces:
        p = p.removesuffix("</w>")
        if p and all(c in byte_of for c in p):
            found.add(bytes(byte_of[c] for c in p))
    return sorted(found)


class Automaton:
    """child: (node << 8 | byte) to node; fail and popped by node; node 0 is the root. fail is -1 where no pieces fit."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        child: dict[int, int] = {}
        parent, via, final = [-1], [0], [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in child:
                    child[key] = len(parent)
                    parent.append(node)
                    via.append(byte)
                    final.append(False)
                node = child[key]
            final[node] = node > 0
        depth, order = [0] * len(parent), list(range(1, len(parent)))
        for v in order:  # parents have smaller numbers
            depth[v] = depth[parent[v]] + 1
        fail, popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(order, key=depth.__getitem__):
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while z >= 0 and (z << 8 | via[v]) not in child:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = child[z << 8 | via[v]], n
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word; one, the unknown piece, if greedy longest match comes to a byte that no piece begins with."""
        child, fail, popped, node, n = self.child, self.fail, self.popped, 0, 0
        for byte in word:
            while (to := child.get(node << 8 | byte)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


_made: dict[int, tuple] = {}


def _counter(shared, key: int):
    if key not in _made:
        _made.clear()
        _made[key] = (Automaton(shared.value), regex.compile(WORD).findall, {})
    return _made[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """docs with n_words and n_pieces of each whole text; both 0 for a null or empty one.

    Pieces are those of the vocabulary without marks of word ends: initial, inner and last pieces are one set, so counts are of
    greedy longest match over that set. Repeated rows are counted alike; no rows, no result; a column of df named like one of these is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))  # a vocabulary file, of fixed size
    key = shared._jbroadcast.id()

    def run(b: pa.RecordBatch) -> list:
        automaton, split, cache = _counter(shared, key)
        words, pieces = [], []
        for x in column(b, text).to_pylist():
            n = k = 0
            for run in x.lower().split() if x else ():
                c = cache.get(run)
                if c is None:
                    found = split(run)
                    c = len(found), sum(automaton.count(w.encode("utf-8", "surrogatepass")) for w in found)
                    if len(run) <= 64:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[run] = c
                k += c[0]
                n += c[1]
            words.append(k)
            pieces.append(n)
        return [words, pieces]

    return append_columns(docs, "n_words long, n_pieces long", run)
