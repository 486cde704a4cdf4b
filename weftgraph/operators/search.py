"""The node search language: comma-separated keywords, `@Type` and `@Type:name`."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SYNONYMS = {
    "metformin": ["glucophage", "dimethylbiguanide"], "t2dm": ["type2diabetes", "type2diabetesmellitus", "diabetesmellitustype2"], "diabetes": ["diabetesmellitus", "dm"],
    "covid19": ["sarscov2", "coronavirusdisease2019", "covid"], "egfr": ["erb1", "epidermalgrowthfactorreceptor"], "tp53": ["p53", "tumorproteinp53"],
}


def parse(query: str) -> list[dict]:
    """Terms as {type, name}; either may be None."""
    terms = []
    for raw in (t.strip() for t in query.split(",")):
        if raw.startswith("@"):
            kind, _, name = raw[1:].partition(":")
            terms.append({"type": kind.strip().lower(), "name": name.strip() or None})
        elif raw:
            terms.append({"type": None, "name": raw})
    return terms


def variants(name: str) -> list[str]:
    """The squeezed name and its synonyms, in both directions."""
    q = re.sub("[^a-z0-9]", "", name.lower())
    return sorted({q, *SYNONYMS.get(q, []), *(k for k, v in SYNONYMS.items() if q in v)} - {""})


def matches(text: Column, candidate: str) -> Column:
    """Whether a segment of text begins with the candidate or, from five characters on, the squeezed text holds it."""
    segments = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda s: s != "")
    found = F.exists(segments, lambda s: F.startswith(s, F.lit(candidate)))
    return found | F.contains(F.concat_ws("", segments), F.lit(candidate)) if len(candidate) >= 5 else found


def search(nodes: DataFrame, query: str, articles: str = "num_articles", top: int = 20) -> DataFrame:
    """(node_id, term): anchors. A bare type beside other terms gives its `top` nodes by articles; alone it gives all of its type."""
    terms, parts = parse(query), []
    for k, t in enumerate(terms):
        n = nodes.where(F.lower("type") == t["type"]) if t["type"] else nodes
        if t["name"]:
            hit = [matches(F.col(c), v) for v in variants(t["name"]) for c in ("name", "mesh")]
            n = n.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hit], F.lit(False)))
        elif len(terms) > 1:
            n = n.orderBy(F.desc(articles), "node_id").limit(top)
        parts.append(n.select("node_id", F.lit(k).alias("term")))
    return reduce(DataFrame.unionByName, parts) if parts else nodes.select("node_id", F.lit(0).alias("term")).limit(0)


def quoted_or(names: list[str], tail: str = "@GENE") -> str:
    """`("a" OR "b") AND @GENE` of a list of names."""
    clean = [re.sub("^[\"']|[\"']$", "", n.strip()) for n in names]
    return f"({' OR '.join(f'"{n}"' for n in clean if n)}) AND {tail}"


EXCLUDED_TYPES = ["Editorial", "Letter", "Published Erratum", "Congress", "News", "Comment", "Retraction of Publication"]  # fixed values


def without_publication_types(query: Column) -> Column:
    return F.concat(F.lit("("), query, F.lit(") " + " ".join(f'NOT "{t}"' for t in EXCLUDED_TYPES)))


def valid_boolean(query: str) -> bool:
    """Balanced quotes and brackets, a letter or digit, no trailing operator or `@`, and outside of quotes no words of SQL and no square brackets."""
    depth, bare = 0, re.sub(r'"[^"]*"', '""', query)
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    bad = re.search(r"\b(select|from|where|limit|order by)\b|[\[\]]|\b(AND|OR|NOT)\s*$|@\s*$", bare, re.IGNORECASE)
    return bool(re.search("[A-Za-z0-9]", query)) and depth == 0 and query.count('"') % 2 == 0 and not bad


SENTENCE = 10  # fixed value

#: Words that name no entity.
PLAIN_WORDS = {"the", "and", "among", "with", "for", "about", "relationship", "of", "genes", "related", "to"}  # fixed values


def fallback_query(question: str, most: int = 2) -> str:
    """A boolean query where a model gives none that is valid: the question's first telling words in quotes, joined by AND.

    A question of fewer such words that is a boolean query itself, or names a type, stays; one without Latin letters gives nothing.
    """
    words: dict[str, str] = {}
    for w in re.split(r"[^A-Za-z0-9-]+", question):
        if len(w) > 2 and w[0].isalpha() and w.lower() not in PLAIN_WORDS:
            words.setdefault(w.lower(), f'"{w}"')
    if len(words) < most and re.search(r" (AND|OR|NOT) |@(GENE|MIRNA|DISEASE|CHEMICAL)", question, re.IGNORECASE):
        return question.strip()
    return " AND ".join(list(words.values())[:most])


def boolean_query(question: str, answer: str | None) -> str:
    """A model's answer as a boolean query if it is a valid one, else fallback_query."""
    made = clean_boolean(answer or "")
    return made if valid_boolean(made) else fallback_query(question)


def clean_boolean(text: str) -> str:
    """A query as a model returns it: the inside of a fence if there is one, without a leading label, marks of bold and code, and outer quotes.

    Of a sentence (more than SENTENCE words) that quotes a query, one with an operator or a type, that query is taken.
    """
    _, fenced, inside = text.partition("```")
    t = re.sub(r"^\w*\s", "", inside.partition("```")[0]) if fenced else text
    t = " ".join(re.sub(r"\*\*|__|`", "", t).split())
    t = re.sub(r"^((boolean|search) )?(query|boolean|result|output)\s*:\s*", "", t, flags=re.IGNORECASE)
    if len(t.split()) > SENTENCE:
        t = next((q for q in t.split('"')[1::2] if "@" in q or re.search(r"\b(AND|OR|NOT)\b", q, re.IGNORECASE)), t)
    return t[1:-1].strip() if len(t) > 1 and t[0] == t[-1] == '"' and t.count('"') == 2 else t
