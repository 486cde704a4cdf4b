"""Python nodes of one task: each keeps a worker of its own."""

from fractions import Fraction

import pytest

from weftgraph.llm import byte_bpe, ngram_join


def test_components_of_the_join_read_what_is_written(spark, monkeypatch):
    seen, real = [], ngram_join.connected_components

    def watched(edges):
        seen.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return real(edges)

    monkeypatch.setattr(ngram_join, "connected_components", watched)
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "y " + text), (4, "a b c d e f"), (5, text)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs, 5, Fraction(4, 5)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}
    assert seen and not any("MapInArrow" in plan for plan in seen)


@pytest.mark.parametrize("most", [3, 1000])
def test_a_cache_that_starts_anew_changes_nothing(monkeypatch, most):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", most)
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": 257}
    c, texts = byte_bpe.Codec(ranks, " ?\\p{L}+|\\s+"), [f"ab ab{chr(97 + k)} cab" for k in range(20)]
    assert [c.decode(x).decode() for x in map(c.encode, texts)] == texts
    assert len(c.runs) <= most + 2 and len(c.words) <= most + 3
