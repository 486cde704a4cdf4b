"""Secret scans: patterns find candidates, a random forest takes out false positives.

The forest sees a candidate's length and form, transitions between character classes, the share of it that a
dictionary covers, the path it was found under and the words beside it. The dictionary is the whole words of a public vocabulary file
(or the caller's), and the forest is grown here, from labelled findings: the caller's, or `labelled_findings`, made by rule with a
fixed seed (a documented bound of 8,000). Neither changes with the corpus, so a text is judged alike whatever stands around it.
"""

from __future__ import annotations

import functools
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import append_columns, column, small_batches

NAME = re.compile(r"""(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth)["']?\s{0,3}$""")
QUOTED = re.compile(r"""\s{0,3}(["'])((?:(?!\1)[^\\\r\n]|\\.)*)\1""")
BARE = re.compile(r"""\s{0,3}["']?((?:[^\s"']|["'](?![\s,;:)\]}>]|$))*)""")
MARK, DIGIT, RUN = re.compile("[=:]"), re.compile("[0-9]"), re.compile(r"[A-Za-z0-9+/_-]*={0,2}")
RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: Credentials of a request header, after the word and blanks, and those of a URL, between : and @.
HEADER, URL = re.compile(r"\b(?:[Bb]earer|BEARER|[Bb]asic|BASIC)[ \t]{1,3}([A-Za-z0-9._~+/=-]+)"), re.compile(r"[A-Za-z0-9]://[^\s/:@\"']*:([^\s/@\"']+)@")
LETTERS, MIXED = re.compile(r"[A-Za-z]+"), re.compile(r"[a-z][A-Z]")
LEAST, LEAST_NAMED, LEAST_URL = 16, 8, 4
NEAR = 40
#: Words beside a finding.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "login")
HARMLESS_WORDS = ("commit", "sha", "md5", "checksum", "hash", "uuid", "guid", "id", "isbn", "doi", "http", "https", "url", "example", "digest", "version", "phone")
HARMLESS_PATHS = ("test", "example", "docs", "fixture", "sample", "lock")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk-", "sk_", "AIza", "eyJ", "glpat-")
PASSWORD = re.compile(r"""(?i)(passw(or)?d|pwd)["']?\s*[=:]\s*["']?$""")


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of values given to a telling name, of credentials in headers and URLs, of runs of at least 16 key characters with a digit, and of
    as many letters that change from small to capital at least twice; spans that overlap are one.

    A quoted value runs to the closing quote of its line, another to white space or a quote that closes around it.
    Scans for rare characters (= : and digits) and looks around those, so that plain prose costs little.
    """
    found, last = [], 0
    for m in MARK.finditer(text):
        if NAME.search(text, max(0, m.start() - 24), m.start()):
            if v := QUOTED.match(text, m.end()):
                span = v.span(2)
            elif m.end() >= last:
                span = BARE.match(text, m.end()).span(1)
            else:
                continue  # a bare value inside another ends with it
            if span[1] - span[0] >= LEAST_NAMED:
                found.append(span)
                last = max(last, span[1])
    end = 0
    for m in DIGIT.finditer(text):
        s = m.start()
        if s >= end:
            while s > end and text[s - 1] in RUN_CHARS:
                s -= 1
            end = RUN.match(text, m.start()).end()
            if end - s >= LEAST:
                found.append((s, end))
    if any(w in text for w in ("earer", "EARER", "asic", "ASIC")):
        found += [m.span(1) for m in HEADER.finditer(text) if m.end(1) - m.start(1) >= LEAST]
    at = text.find("://")
    while at >= 0:
        if at and (m := URL.match(text, at - 1)) and m.end(1) - m.start(1) >= LEAST_URL:
            found.append(m.span(1))
        at = text.find("://", at + 3)
    if any(len(w) >= LEAST and not (w[1:].islower() or w.isupper()) for w in text.split()):
        found += [m.span() for m in LETTERS.finditer(text) if m.end() - m.start() >= LEAST and len(MIXED.findall(text, m.start(), m.end())) >= 2]
    whole: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if whole and s < whole[-1][1]:
            whole[-1] = whole[-1][0], max(e, whole[-1][1])
        else:
            whole.append((s, e))
    return whole


@functools.lru_cache(maxsize=4)
def known_words(path: str | None = None) -> frozenset[str]:
    """The whole words of 4 to 12 letters a to z of a vocabulary file with word ends, the public one if none is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return frozenset(w for p in pieces if p.endswith("</w>") and re.fullmatch("[a-z]{4,12}", w := p.removesuffix("</w>")))


def learn_dictionary(docs: DataFrame, share: float = 0.002, text: str = "text", least: int = 1) -> frozenset[str]:
    """Words of 4 to 12 letters a to z, in whatever case, that at least this share of the rows, and so many rows, hold: a dictionary of the caller's own.

    Counted over all rows. At most (mean number of distinct words of a row) / share words can reach it, so the result fits
    the driver whatever the corpus. It changes with the corpus, so scan() takes it only where it is given.
    """
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w).between(4, 12))
    counts = docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").count()
    least = max(least, share * docs.count())
    return frozenset(r["word"] for r in counts.where(F.col("count") >= least).select("word").collect())


def _dictionary_share(s: str, words: frozenset[str]) -> float:
    low, n, i = s.lower(), 0, 0
    while i < len(low):
        k = next((k for k in range(12, 3, -1) if low[i : i + k] in words and len(low) - i >= k), 0)
        n, i = n + k, i + (k or 1)
    return n / max(1, len(s))


def features(value: str, before: str, after: str, path: str, words: frozenset[str] | None = None) -> list[float]:
    words = known_words() if words is None else words
    kind = [0 if c.isdigit() else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 for c in value]
    n, near = len(value), re.findall(r"[a-z0-9]+", f"{before} {after}".lower())
    seen = [value.count(c) / n for c in set(value)]
    letters = [c for c in value.lower() if c.isalpha()]
    last = near[-1] if near else ""
    return [
        float(n),
        -sum(p * math.log2(p) for p in seen),
        sum(a != b for a, b in zip(kind, kind[1:])) / max(1, n - 1),
        *(kind.count(k) / n for k in range(4)),
        sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        _dictionary_share(value, words),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(len(set(value))),
        max((len(m.group()) for m in re.finditer(r"(.)\1*", value)), default=0) / n,
        float(value.startswith(PREFIXES)),
        float(bool(re.search(r"(?i)(token|secret|passw(or)?d|pwd|key|auth)[\"']?\s*[=:]\s*[\"']?$", before))),
        float(any(w in SECRET_WORDS for w in near)),
        float(any(w in HARMLESS_WORDS for w in near) or last in HARMLESS_WORDS),
        float(any(p in path.lower() for p in HARMLESS_PATHS)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)) or value.count("/") > 2),
        float(bool(PASSWORD.search(before))),
        float(bool(re.search(r"(?i)\b(bearer|basic)\s+$", before))),
        float(bool(re.search(r"://[^\s/:@]*:$", before)) and after.startswith("@")),
        float(len(re.findall("[A-Za-z]+", value))),
        float(any(c in "()[]{}<>$" for c in value)),
        float(sum(w in ("your", "changeme", "example", "placeholder", "here", "none", "null", "true", "false", "required", "environ", "getenv", "config") for w in re.findall("[a-z]+", value.lower()))),
        sum(a == 1 and b == 2 for a, b in zip(kind, kind[1:])) / max(1, n - 1),
    ]


def labelled_findings(n: int = 8000, seed: int = 5, words: frozenset[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: a secret) of n findings, half of them secrets, made by rule from what such strings are.

    Secrets: keys of random hex or base64 characters, key ids and tokens with a public prefix, three-part web tokens, credentials of
    headers and URLs, passwords that people make of words, digits and signs, and long mixed letters in plain text. Others: digests and identifiers of what is
    public, numbers, paths, names of variables, calls, placeholders and versions. Both kinds stand in all kinds of files.
    words are those that names are made of; a finding stands in random syllables or in such words.
    """
    rng = np.random.default_rng(seed)
    low, up, num, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    choose = lambda xs: xs[int(rng.integers(0, len(xs)))]
    size = lambda a, b: int(rng.integers(a, b))
    known = sorted(known_words() if words is None else words) or [""]
    syllables = ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "on", "er", "in", "th")
    word = lambda: choose(known) if rng.random() < 0.7 else "".join(choose(syllables) for _ in range(size(2, 5)))
    names, passes = ("token", "secret", "api_key", "auth", "access_key", "auth_token", "apikey", "client_secret"), ("password", "passwd", "pwd", "db_password")
    lead = lambda ns: choose(("{}=", "{} = ", '{}: "', '{} = "', "{}:", "{}: ", "{}='")).format(choose(ns))
    named, passed, either = (lambda: lead(names)), (lambda: lead(passes)), (lambda: lead(names + passes))
    told = lambda: choose(("commit ", "sha256: ", "md5 ", "checksum=", "uuid ", "https://host/", "id ", "isbn ", "version ", "phone ", ""))
    bare, header = (lambda: ""), (lambda: choose(("Authorization: Bearer ", "authorization: bearer ", "Authorization: Basic ", "Bearer ")))
    url = lambda: choose(("postgres", "mysql", "redis", "amqp", "mongodb", "https")) + "://" + choose(("", "admin", "root", "user", word())) + ":"
    phrase = lambda: choose((lambda: choose(("-", "_", ".", " ", "")).join(word() for _ in range(size(2, 5))), lambda: word() + pick(num, size(1, 5)) + word(), lambda: (word() + pick(num, size(1, 3))) * 2, lambda: word().capitalize() + pick(num, size(1, 5)) + choose(("", "!", "#", "$", "&")) + choose(("", word())), lambda: word().replace("a", "4").replace("e", "3").replace("o", "0").replace("s", "5") + pick(num + "!#$&", size(1, 4))))()
    mixed = lambda: pick(low + up, size(16, 40))
    secrets = (
        (lambda: pick(hexes, choose((16, 18, 20, 32, 40, 64))), either), (lambda: pick(low + up + num, size(8, 48)), either), (lambda: pick(low + up + num + "+/", 4 * size(4, 16)) + choose(("", "=", "==")), either), (lambda: choose(("AKIA", "ASIA")) + pick(up + num, 16), lambda: choose(("", "", either()))),
        (lambda: choose(PREFIXES) + pick(low + up + num, size(20, 40)), lambda: choose(("", either()))), (lambda: "eyJ" + pick(low + up + num, size(12, 40)) + "." + pick(low + up + num + "-_", size(20, 60)) + "." + pick(low + up + num + "-_", size(20, 43)), lambda: choose(("", either(), header()))), (phrase, passed), (lambda: pick(low + up + num + "!#$%&*-_", size(8, 24)), either),
        (phrase, passed), (lambda: pick(low + up + num + choose(("", "._-")), size(16, 64)), header), (lambda: choose((phrase(), pick(low + up + num + "!$_-", size(6, 24)))), url), (mixed, lambda: choose(("", named()))), (lambda: pick(low + num, size(8, 40)), either), (lambda: choose(names) + choose("=:") + pick(low + num, size(8, 30)), either),
    )
    others = (
        (lambda: pick(hexes, choose((32, 40, 64))), told), (lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: choose((told(), named()))), (lambda: "/".join(word() for _ in range(size(2, 6))) + "/" + pick(num, 3), lambda: choose((bare(), named()))), (lambda: "_".join(word() for _ in range(size(2, 5))) + pick(num, size(0, 3)), lambda: choose((named(), bare(), named()))),
        (lambda: pick(num, size(16, 30)), told), (lambda: choose(("x", "*", "0", "-", "X", ".")) * size(8, 30), either), (lambda: choose(("your_" + word() + "_" + choose(("here", "token", "key")), "<" + word() + "-" + choose(names) + ">", "changeme" + pick(num, size(0, 3)), "example-" + word(), "placeholder")), either), (lambda: "-".join((word(), word(), pick(num, 6), word())), told),
        (lambda: ".".join(pick(num, size(1, 4)) for _ in range(4)) + "-" + word() + pick(num, 4), told), (lambda: word() + "".join(word().capitalize() for _ in range(size(2, 5))) + choose(("", pick(num, 2))), lambda: choose((bare(), named(), bare()))), (lambda: choose(("os.environ[" + word().upper() + "_KEY]", "${" + word().upper() + "_" + word().upper() + "}", "get_" + word() + "(" + word() + ")", "{{ " + word() + "." + choose(names) + " }}", "config." + word() + "." + word())), either), (lambda: choose((word() + choose(("", "ed", "ing")), "required", "incorrect", "undefined", "optional")).ljust(8, "s"), either),
    )
    x, y = [], []
    for i in range(n):
        label = i % 2
        make, where = choose(secrets if label else others)
        value, place = make(), where()
        before, after = " ".join(word() for _ in range(4)) + " " + place, ("@" + word() if place.endswith(":") and "://" in place else choose(('" ', " ", "\n")) if place else " ") + " ".join(word() for _ in range(4))
        path = choose(("src0", "web", "forum", "config", "app/settings", "src7", "tests/fixture" if not label else "deploy", "docs/example" if not label else "src3"))
        x.append(features(value, before[-NEAR:], after[:NEAR], path, words))
        y.append(label)
    return np.array(x), np.array(y)


@functools.lru_cache(maxsize=1)
def default_forest() -> Forest:
    return Forest(*labelled_findings())


class Forest:
    """Trees grown on bootstrap samples, each split the best of a random third of the features by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 12, least: int = 5, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(y), len(y))
            nodes: list[tuple] = []
            self._grow(x[pick], y[pick].astype(float), depth, least, rng, nodes)
            self.trees.append([np.array(c) for c in zip(*nodes)])

    def _grow(self, x, y, depth, least, rng, nodes) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, float(y.mean())))
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
            best = (math.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[:-1] < v[1:]) + 1
                k = k[(k >= least) & (k <= len(y) - least)]
                if len(k):
                    p, q = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
                    g = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                    j = int(g.argmin())
                    best = min(best, (float(g[j]), int(f), float((v[k[j] - 1] + v[k[j]]) / 2)))
            if best[1] >= 0:
                left = x[:, best[1]] <= best[2]
                a = self._grow(x[left], y[left], depth - 1, least, rng, nodes)
                b = self._grow(x[~left], y[~left], depth - 1, least, rng, nodes)
                nodes[at] = (best[1], best[2], a, b, float(y.mean()))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over trees of the share of secrets in the leaf."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                go = x[rows, np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)


def scan(docs: DataFrame, findings: tuple[np.ndarray, np.ndarray] | None = None, threshold: float = 0.5, text: str = "text", path: str = "source", dictionary: frozenset[str] | None = None) -> DataFrame:
    """docs with n_candidates, secrets (array of start, end, score; character offsets) and redacted, the text with each secret as [SECRET].

    dictionary: words for the coverage feature, the public vocabulary's if not given; findings must have been made with the same one. A text's
    result hangs on that text and its path alone.
    A null or empty text has no candidates and stays as it is; a null path counts as empty. Texts are read whole. Spans are disjoint.
    Repeated rows are judged alike; other columns stay as they are, but one named like a new one is replaced. No rows, no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = known_words() if dictionary is None else dictionary
    forest = default_forest() if findings is None and dictionary is None else Forest(*(findings or labelled_findings(words=words)))
    shared = spark.sparkContext.broadcast((forest, words))  # at most trees * 2**(depth + 1) nodes, and the words of one file

    def run(b: pa.RecordBatch) -> list:
        forest, words = shared.value
        texts, paths = column(b, text).to_pylist(), column(b, path).to_pylist()
        at, x = [], []
        for i, t in enumerate(texts):
            for s, e in candidates(t) if t else ():
                at.append((i, s, e))
                x.append(features(t[s:e], t[max(0, s - NEAR) : s], t[e : e + NEAR], paths[i] or "", words))
        score = forest.predict(np.array(x)) if x else []
        count, found = [0] * len(texts), [[] for _ in texts]
        for (i, s, e), p in zip(at, score):
            count[i] += 1
            if p >= threshold:
                found[i].append({"start": s, "end": e, "score": float(p)})
        clean = []
        for t, spans in zip(texts, found):
            for f in reversed(spans):
                t = t[: f["start"]] + "[SECRET]" + t[f["end"] :]
            clean.append(t)
        return [count, found, clean]

    return append_columns(docs, "n_candidates long, secrets array<struct<start:long,end:long,score:double>>, redacted string", run)
