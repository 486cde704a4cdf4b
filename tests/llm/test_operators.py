"""The ten operators against brute force on small input, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import ann, byte_bpe, embedding_dedup, language_id, mixing, ngram_join, secrets, suffix_dedup, token_counts, url_filter
from weftgraph.llm.queries import RULES, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string"


def word(r):
    return "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    base = [" ".join(word(r) for _ in range(r.randint(3, 90))) for _ in range(25)]
    out = []
    for k in range(150):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 0, 1, 2, 6))):
            w[r.randrange(len(w))] = word(r)
        out.append((k, " ".join(w), r.choice(("en", "fr", None)), r.choice(("a", "b", "c", "a", "a", None))))
    out += [(200, None, "en", "a"), (201, "", None, "z"), (202, "one", "en", "a"), (203, "one two", "fr", "b"), (204, "ab" * 3000, "en", "a"), (205, "Ab" * 3000, "en", None), (206, " \t\n ", "en", "c"), (207, "x" * 120, "fr", "c"), (208, "12 34 !!", None, "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, 100).collect()}
    seen = set()
    for k, text, *_ in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        assert bytes(got[k].kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[k].n_bytes, got[k].n_removed, len(got[k].gone)) == (len(b), gone.sum(), (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    text = " ".join(str(k) for k in range(200))
    d = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(d).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(text))]


def test_suffix_dedup_texts_that_share_an_id(spark):
    a, b = " ".join(str(k) for k in range(150)), " ".join(str(k) for k in range(1000, 1100))
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, b)], "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(d).collect()) == sorted([(0, len(b), 0), (1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (2, len(b), 0)])


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_ngram_join(docs, rows, empty, n, t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {}
    for k, text, *_ in rows:
        w = (text or "").translate(low).split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r for r in ngram_join.join(docs, n, t).collect()}
    assert {k: (len(s), find(k)) for k, s in sets.items()} == {k: (r.n_shingles, r.component_id) for k, r in got.items()}
    assert ngram_join.join(empty).count() == 0


def test_secrets(spark, empty):
    text = 'filler words here token = "9765fab7324201a5ddfac0becd9064abbef40be8" and card 1683436113538828 then commit 9765fab7324201a5ddfac0becd9064abbef40be8 end'
    d = spark.createDataFrame([(1, text, "a", 5), (2, None, None, 6), (3, "", "b", 7), (1, text, "a", 5)], "doc_id long, text string, source string, n_candidates int")
    got = secrets.scan(d).collect()
    first = [r for r in got if r.doc_id == 1]
    assert len(got) == 4 and first[0] == first[1] and first[0].redacted.startswith('filler words here token = "[SECRET]"') and "1683436113538828" in first[0].redacted
    assert next(r for r in got if r.doc_id == 2).redacted is None and next(r for r in got if r.doc_id == 3).n_candidates == 0
    x, y = secrets.labelled_findings(1000, seed=77)
    assert ((secrets.Forest(*secrets.labelled_findings(2000)).predict(x) > 0.5) == y).mean() > 0.95
    assert secrets.scan(empty).count() == 0


def test_secrets_are_taken_whole(spark):
    r = random.Random(6)
    key = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(700))
    spans = lambda t: [t[a:b] for a, b in secrets.candidates(t)]
    assert spans(f"token = {key} end") == [key]
    assert spans("password=Tr0ub4dor&longtail then") == ["Tr0ub4dor&longtail"] and spans("pwd: a$b#c%d&e*f then") == ["a$b#c%d&e*f"]
    assert spans("password = 'correct horse, #9' then") == ["correct horse, #9"] and spans('{"password": "ab\\"cdefgh", "x": 1}') == ['ab\\"cdefgh']
    assert spans('{"a":"token=abcdefgh1","b":"clean text"}') == ["abcdefgh1"]
    assert spans("token=secret=abcdef12345 clean text") == ["secret=abcdef12345"]
    assert spans('token=secret="abcdef 12345" clean') == ['secret="abcdef 12345']
    rows = [(1, f"token = {key} end", "a"), (2, "token=secret=abcdef1234567890abcd clean text after it", "a")]
    got = {x.doc_id: x.redacted for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: "token = [SECRET] end", 2: "token=[SECRET] clean text after it"}


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix(docs.repartition(2)).collect())
    size = {k: len([w for w in (t or "").split()]) for k, t, *_ in rows}
    own = defaultdict(int)
    for k, _, _, s in rows:
        own[s] += size[k]
    names = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(own.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * own[s]}
        for s in over or open_:
            target[s] = 3.0 * own[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    source, taken = {k: s for k, _, _, s in rows}, defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.source_size == own[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS for s in names)
    assert mixing.mix(empty).count() == 0


def test_language(spark, empty):
    r = random.Random(1)
    make = {"en": ["the", "tion", "ing", "and", "her"], "de": ["sch", "ung", "ein", "ich", "der"], "fr": ["eau", "ment", "oui", "les", "é"]}
    rows = [(k, " ".join(r.choice(make[lang]) + r.choice(make[lang]) for _ in range(40)), lang) for k in range(120) for lang in [r.choice(list(make))]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", None), (903, rows[0][1], None)]
    got = {x.doc_id: x for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [k for k, _, lang in rows[:120] if got[k].held_out]
    assert held and all(got[k].lang_pred == rows[k][2] for k in held) and all(0 <= g.score <= 1 for g in got.values())
    assert all(got[k].lang_pred == "und" for k in (900, 901, 902)) and got[903].lang_pred == rows[0][2]
    assert language_id.identify(empty).count() == 0


def vectors(spark, n=400):
    r = np.random.default_rng(3)
    x = r.standard_normal((n, 16))
    x[50:120] = x[50] + 0.04 * r.standard_normal((70, 16))
    x[200:210] = x[200]
    rows = [(int(i), [float(a) for a in v], int(i % 3 if i >= 120 else 0)) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [1.0], 0), (1005, rows[50][1], None)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_ann(spark):
    rows, df = vectors(spark)
    x = {k: np.array(v) for k, v, _ in rows if k < 1000 or k == 1005}
    got = defaultdict(list)
    for r in ann.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in [k for k in x if k % 20 == 0]:
        s = sorted((-(x[q] @ x[k]) / np.linalg.norm(x[q]) / np.linalg.norm(x[k]), k) for k in x if k != q)[:5]
        hits += len({k for _, k in s} & {k for k, _ in got[q]})
        total += 5
        assert len(got[q]) == 5 and all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(got[q], got[q][1:]))
    assert hits / total >= 0.9
    assert ann.search(df.limit(0), "vec_id % 2 = 0").count() == 0


def test_embedding_dedup(spark):
    rows, df = vectors(spark)
    x = {k: (np.array(v) / np.linalg.norm(v), lab) for k, v, lab in rows if k < 1000}
    links, root = defaultdict(int), {k: k for k, *_ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in x:
        for b in x:
            if a < b and x[a][1] == x[b][1] and x[a][0] @ x[b][0] >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = embedding_dedup.dedup(df).collect()
    assert {k: (links[k], find(k)) for k, *_ in rows} == {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_dedup_copies_fill_no_list(spark):
    a, b = [1.0] + [0.0] * 15, [0.985, (1 - 0.985**2) ** 0.5] + [0.0] * 14
    rows = [(k, a if k % 2 else b, 0) for k in range(80)] + [(k, a, 0) for k in (3, 5)]
    got = embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 82 and {(r.n_links, r.component_id) for r in got} == {(79, 0)}


def test_embedding_dedup_finds_pairs_alone_in_a_large_label(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((60_000, 16))
    side = r.standard_normal((300, 16))
    a = x[:300] / np.linalg.norm(x[:300], axis=1)[:, None]
    side -= (side * a).sum(1)[:, None] * a
    x[300:600] = 0.981 * a + (1 - 0.981**2) ** 0.5 * side / np.linalg.norm(side, axis=1)[:, None]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.zeros(len(x), np.int32)}))
    got = embedding_dedup.dedup(df).where("vec_id >= 300 and vec_id < 600").collect()
    assert all((r.n_links, r.component_id) == (1, r.vec_id - 300) for r in got) and len(got) == 300


def test_url_filter(spark):
    link = '<a href="http://bad.io/x">'
    rows = [(1, "http://A.example.net/en/x?q", None), (2, "http://b.example.net/de", link), (3, "http://x.example.com/de/", ""), (4, "https://y.org/fr/1#a", '<a href="//good.io/">'), (5, None, None), (6, "nourl", None), (7, "http://net", None), (8, "http://good.io/", ""), (9, "http://bad.io", '<a href="http://b.example.net/de">'), (10, "http://other.io/a", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[k].rule for k in (2, 3, 4, 5, 6, 7)] == ["net/", "example.com/de/", "org/fr/", None, None, None]
    assert [got[k].verdict for k in (2, 3, 4, 5, 8, 9, 10)] == ["block", "block", "allow", "allow", "allow", "block", "allow"]


def test_token_counts(spark, docs, rows, empty):
    import regex

    vocabulary = token_counts.load_vocabulary(tokenizer_file("word_bpe_49k.json"))
    known, longest = set(vocabulary), max(map(len, vocabulary))

    def greedy(w):
        n = i = 0
        while i < len(w):
            k = next((k for k in range(min(longest, len(w) - i), 0, -1) if w[i : i + k] in known), 0)
            if not k:
                return 1
            n, i = n + 1, i + k
        return n

    got = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer_file("word_bpe_49k.json")).collect()}
    for k, text, *_ in rows:
        words = regex.findall(token_counts.WORD, (text or "").lower())
        assert (got[k].n_words, got[k].n_pieces) == (len(words), sum(greedy(w.encode()) for w in words))
    small = token_counts.Automaton([b"a", b"abcd", b"b", b"bc", b"cdx"])
    assert [small.count(w) for w in (b"abcd", b"abcdx", b"abc", b"z", b"")] == [1, 1, 2, 1, 0]
    assert token_counts.count_tokens(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_byte_bpe(spark, docs, rows, empty):
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = byte_bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.digests(docs, path, pattern).collect()}
    for k, text, *_ in rows:
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    c, r = byte_bpe.Codec(ranks, pattern), random.Random(2)
    for _ in range(500):
        s = "".join(r.choice(["a", "the", "é", " ", "  ", "\n", "1", "'s", "日", "\xa0", "\x85", "\x1c", ".", "xyz"]) for _ in range(r.randint(0, 60)))
        assert np.frombuffer(c.encode(s), "<u4").tolist() == enc.encode_ordinary(s)
    w = spark.createDataFrame([(x,) for x in ("hello", " world", "", None, " thandere")], "word string")
    assert [r.ids for r in byte_bpe.encode_words(w, ranks).collect()] == [enc.encode_ordinary(x) if x is not None else None for x in ("hello", " world", "", None, " thandere")]
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, pattern), path)
    assert back.where(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")) != F.col("decoded")).count() == 0
    assert byte_bpe.digests(empty, path, pattern).count() == 0
