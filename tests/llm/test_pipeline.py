"""The pipeline against its stages done by hand on a small table."""

from fractions import Fraction

import corpus_pipeline
from weftgraph.llm import ngram_join


def test_stages(spark, tmp_path):
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, " ".join(text.split()[k : k + 40]), "en", "ab"[k % 2], 0) for k in range(0, 20, 4)]
    rows += [(50, rows[0][1], "en", "a", 0), (51, None, "en", "a", 0), (52, "123 456", None, "b", 0), (53, 'quite other words token = "9765fab7324201a5ddfac0becd9064abbef40be8" here', None, "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {0, 4, 8, 12, 16, 53} and 50 not in ids and all(r.n_tokens * 4 == len(r.token_ids) for r in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {0, 4, 8, 12, 16, 50, 53} and kept.columns == docs.columns
    one = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, kept, "").collect()}
    assert one == {r.doc_id for r in ngram_join.join(kept, 5, Fraction(4, 5)).collect() if r.doc_id == r.component_id}
    clean = {r.doc_id: r for r in corpus_pipeline.secrets_stage(spark, kept, "").collect()}
    assert len(clean) == 7 and "[SECRET]" in clean[53].text and clean[53].n_chars == len(clean[53].text)
