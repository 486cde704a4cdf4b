"""The contract queries: thin applications of the operators to whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import ann, byte_bpe, delta_lloyd, embedding_dedup, language_id, licenses, mixing, ngram_join, secrets, sessions, suffix_dedup, token_counts, url_filter
from weftgraph.session import table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    return made.select("doc_id", "n_bytes", "n_removed", F.size("gone").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    spans = F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    best = F.array_max(F.transform("secrets", lambda s: s["score"]))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"), best.alias("best_score"), F.sha2("redacted", 256).alias("redacted_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return made.select("doc_id", "held_out", "lang_pred", "score")


def op5_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, Fraction(9, 10))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_file("word_bpe_49k.json")).select("doc_id", "n_words", "n_pieces")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = byte_bpe.digests(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = (F.col("kind") == "error") & (F.col("value") >= 60) & ~F.isnan("value")
    made = sessions.sessionise(table(spark, sf_dir, "clicks"), final, 10 * sessions.MINUTE, 40 * sessions.MINUTE, 360 * sessions.MINUTE)
    return made.withColumn("path_sha256", F.sha2(F.array_join(F.col("path").cast("array<string>"), ","), 256)).drop("path")


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = delta_lloyd.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 40, 5, 64, 256, 2)
    return made.withColumn("centroid_sha256", delta_lloyd.centroid_digest(F.col("centroid"))).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_secret_scan, op3_source_mix, op4_language_id, op5_kmeans_tree_search, op6_url_filter, op7_ngram_join, op8_token_counts, op9_byte_bpe, op10_embedding_dedup, op11_license_scan, op12_gap_sessions, op13_delta_lloyd)
}

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _license_sql() -> str:
    """Each template word against each word of a document, grouped by relative position."""
    rows = ", ".join(f"({n}, '{t['label']}', {t['base']}, {i}, '{w}', {t['at'] <= i < t['at'] + t['long']})" for n, t in enumerate(licenses.templates()) for i, w in enumerate(t["words"]))
    return rf"""WITH t(t, label, base, i, word, is_key) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
p AS (SELECT doc_id, UNNEST(w) word, generate_subscripts(w, 1) - 1 p FROM d),
h AS (SELECT * FROM p WHERE word IN (SELECT word FROM t)),
f AS (SELECT word, length(bin((SELECT COUNT(*) + 1 FROM d) // (COUNT(DISTINCT doc_id) + 1))) g FROM (SELECT word, NULL doc_id FROM t UNION ALL SELECT word, doc_id FROM h) GROUP BY word),
k AS (SELECT t, SUM(g)::INT total, COUNT(*) FILTER (is_key) n FROM t JOIN f USING (word) GROUP BY t),
m AS (SELECT doc_id, t, label, base, p - i s, SUM(g)::INT / ANY_VALUE(total) share FROM h JOIN t USING (word) JOIN f USING (word) JOIN k USING (t) GROUP BY doc_id, t, label, base, p - i HAVING COUNT(*) FILTER (is_key) = ANY_VALUE(n) AND share >= {licenses.LEAST_SHARE}::DOUBLE),
a AS (SELECT doc_id, COUNT(*) FILTER (base) n, MIN(s) FILTER (base) lo, MAX(s) FILTER (base) hi, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) b, string_agg(DISTINCT label, ',' ORDER BY label) l, MAX(share) score FROM m GROUP BY doc_id)
SELECT doc_id, LEN(w)::BIGINT AS n_words, COALESCE(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, COALESCE(b, '') AS base_labels, COALESCE(l, '') AS labels, COALESCE(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (doc_id)"""


#: Timely clicks, their islands, and the next session start of each click as a window; sessions by recursion from the islands' starts.
SESSION_SQL = """WITH RECURSIVE c AS (SELECT DISTINCT click_id, client_id, epoch_us(ts) us, COALESCE(arrived_at > ts + INTERVAL 360 MINUTE, false) late, COALESCE(kind = 'error' AND value >= 60, false) fin, COALESCE(floor(100 * value + 0.5), 0)::BIGINT cents FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND click_id IS NOT NULL),
t AS (SELECT *, row_number() OVER w rn, COALESCE(lag(fin) OVER w OR us - lag(us) OVER w >= 600000000, true) fresh FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
i AS (SELECT *, SUM(fresh::INT) OVER (PARTITION BY client_id ORDER BY rn) isl FROM t),
x AS (SELECT *, MIN(rn) OVER (PARTITION BY client_id, isl ORDER BY us RANGE BETWEEN 2400000001 FOLLOWING AND UNBOUNDED FOLLOWING) nxt FROM i),
s(client_id, rn) AS (SELECT client_id, rn FROM x WHERE fresh UNION ALL SELECT x.client_id, x.nxt FROM s JOIN x ON s.client_id = x.client_id AND s.rn = x.rn WHERE x.nxt IS NOT NULL),
e AS (SELECT client_id, rn a, lead(rn) OVER (PARTITION BY client_id ORDER BY rn) b FROM s),
g AS (SELECT e.client_id, e.a, ANY_VALUE(e.b) b, arg_min(click_id, rn) session_id, MIN(us) start_us, MAX(us) end_us, COUNT(*) n_clicks, SUM(cents)::BIGINT value_cents, arg_max(fin, rn) fin, sha256(string_agg(click_id::VARCHAR, ',' ORDER BY rn)) path_sha256 FROM x ASOF JOIN e ON x.client_id = e.client_id AND x.rn >= e.a GROUP BY e.client_id, e.a),
y AS (SELECT client_id, start_us, MAX(a) a FROM g GROUP BY client_id, start_us),
l AS (SELECT y.client_id, y.a, COUNT(*) n FROM (SELECT client_id, us FROM c WHERE late) q ASOF JOIN y ON q.client_id = y.client_id AND q.us >= y.start_us GROUP BY y.client_id, y.a)
SELECT g.client_id, session_id, start_us, end_us, n_clicks, COALESCE(l.n, 0)::BIGINT AS n_late, value_cents, CASE WHEN g.fin THEN 'end' WHEN x.us IS NULL THEN 'none' WHEN x.us - end_us >= 600000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM g LEFT JOIN l ON g.client_id = l.client_id AND g.a = l.a LEFT JOIN x ON x.client_id = g.client_id AND x.rn = g.b"""


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other, each vector against all centroids."""
    near = "SELECT id, q, arg_min(j, (d, j)) j, MIN(d) d FROM (SELECT v.id, v.q, c.j, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(v.q, c.c)])::BIGINT d FROM v, c{r} c) GROUP BY id, q"
    out = [
        "v AS MATERIALIZED (SELECT vec_id id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] q FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 j, q c FROM (SELECT sha256('2:' || id) h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            out.append(f"u{r} AS (SELECT j, i, (SUM(x)::BIGINT - ((SUM(x)::BIGINT % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*) m FROM (SELECT j, UNNEST(q) x, generate_subscripts(q, 1) i FROM a{r}) GROUP BY j, i)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT j, COALESCE(n, c) c FROM c{r} LEFT JOIN (SELECT j, list(m ORDER BY i) n FROM u{r} GROUP BY j) USING (j))")
    return f"""WITH {", ".join(out)}
SELECT id AS vec_id, j::INT AS cluster, d AS distance, SUM(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, SUM(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


#: All pairs, and components by recursion. The other eight hold hashes, models, schedules or tokens that SQL cannot say; tests/llm
#: holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN LEN(w) = 0 THEN [] WHEN LEN(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, LEN(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END s FROM w),
x AS (SELECT doc_id, LEN(s) n, UNNEST(s) g FROM s),
l AS (SELECT a.doc_id a, b.doc_id b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 90 * (a.n + b.n - COUNT(*))),
r(n, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.m FROM r JOIN l ON r.n = l.a)
SELECT doc_id, LEN(s)::BIGINT AS n_shingles, c::BIGINT AS component_id FROM s JOIN (SELECT n, MIN(m) c FROM r GROUP BY n) ON n = doc_id""",
    "op10_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON r.n = l.a),
c AS (SELECT n, MIN(m) m FROM r GROUP BY n), k AS (SELECT a, COUNT(*) k FROM l GROUP BY a)
SELECT vec_id, COALESCE(k, 0)::BIGINT AS n_links, m::BIGINT AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON n = vec_id LEFT JOIN k ON a = vec_id""",
    "op11_license_scan": _license_sql(),
    "op12_gap_sessions": SESSION_SQL,
    "op13_delta_lloyd": _lloyd_sql(),
}
