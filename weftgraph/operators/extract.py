"""Semantic relation extraction through an injected client."""

from __future__ import annotations

import json
import queue
import re
import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.functions.relations import clean_id, confidence, effective_threshold, relation_name
from weftgraph.session import materialize

FIELDS = ("entity1_id", "entity2_id", "relation_type", "confidence", "evidence", "study_type")
OUT = "article_seq long, pmid string, entity1_id string, entity2_id string, relation_type string, confidence string, evidence string, study_type string, outcome string, place int"


def parse_response(text: str | None) -> list[dict] | None:
    """The relations of a response, also one with fences, a wrapping object or broken JSON; None if nothing can be read."""
    if not text or not text.strip():
        return None
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text.strip())
    starts = [i for i in (body.find("["), body.find("{")) if i >= 0]
    if not starts:
        return None
    body = body[min(starts) :]
    closing = body.rfind("]" if body[0] == "[" else "}")
    try:
        data = json.loads(body[: closing + 1])
    except ValueError:
        return _parse_pieces(body)
    if isinstance(data, dict):
        data = next((x for x in data.values() if isinstance(x, list)), [data])
    return [{k: r.get(k) for k in FIELDS} for r in data if isinstance(r, dict) and all(r.get(k) for k in FIELDS[:3])]


def _parse_pieces(body: str) -> list[dict] | None:
    found = []
    for piece in re.split(r"(?=\{)", body):
        r = {}
        for k in FIELDS:
            m = re.search(rf'"{k}"\s*:\s*(?:"((?:[^"\\]|\\.)*)(?:"|$)|([^,}}\s]+))', piece, re.DOTALL)
            r[k] = (m[1] if m[1] is not None else m[2]) if m else None
        if all(r[k] for k in FIELDS[:3]):
            found.append(r)
    return found or None


def extract(articles: DataFrame, nodes: DataFrame, client: Callable[[dict, bool], str], provider: str = "", second_pass: bool = True, seconds: float = 300, known: DataFrame | None = None) -> DataFrame:
    """Raw relations of articles (article_seq, pmid, title, abstract), with an outcome: ok, failed, unparsed, none or skipped, and their place in the article.

    client(article, second) returns the response text; prompts, retries and limits are its own. Articles with fewer than two
    nodes or no abstract are skipped. A second pass asks again where the first finds fewer than half as many relations
    as nodes (two at least), but not from a local provider; the same pair and relation counts once. An article that takes
    longer than `seconds` has failed. known: raw relations of an earlier run; articles with an outcome there other than failed are
    not asked for again, and their rows are taken over.
    """
    if known is not None:
        told = known.where("outcome <> 'failed'")
        rest = extract(articles.join(told.select("pmid").distinct(), "pmid", "left_anti"), nodes, client, provider, second_pass, seconds)
        told = told if "place" in told.columns else told.withColumn("place", F.lit(None).cast("int"))
        old = told.drop("article_seq").join(articles.select("article_seq", "pmid").dropDuplicates(["pmid"]), "pmid")
        return old.select(*rest.columns).unionByName(rest)
    ents = nodes.groupBy("article_seq").agg(F.array_sort(F.collect_list(F.struct("node_id", "name", "type"))).alias("entities"))
    a = articles.select("article_seq", "pmid", "title", "abstract").join(ents, "article_seq")

    def one(row) -> tuple[list[dict], str]:
        entities = [dict(zip(("node_id", "name", "type"), e.values() if isinstance(e, dict) else tuple(e))) for e in row.entities]
        if len(entities) < 2 or not row.abstract:
            return [], "skipped"
        article, found = {"pmid": row.pmid, "title": row.title, "abstract": row.abstract, "entities": entities}, {}
        began = time.monotonic()

        def ask(second: bool) -> str:
            """The client's answer, within what is left of the article's time; a call that hangs is left behind."""
            answer: queue.Queue = queue.Queue()

            def call() -> None:
                try:
                    answer.put((client(article, second), None))
                except Exception as e:  # handed to the caller
                    answer.put((None, e))

            threading.Thread(target=call, daemon=True).start()
            text, error = answer.get(timeout=max(0.01, seconds - (time.monotonic() - began)))
            if error:
                raise error
            return text

        try:
            first = parse_response(ask(False))
            passes = [first or []]
            if second_pass and provider != "local" and len(passes[0]) < max(2, len(entities) // 2):
                passes.append(parse_response(ask(True)) or [])
        except Exception:  # one article's failure is an outcome, not the job's
            return [], "failed"
        for r in (r for p in passes for r in p):
            found.setdefault((*sorted((r["entity1_id"], r["entity2_id"])), r["relation_type"]), r)
        return list(found.values()), "ok" if found else "unparsed" if first is None else "none"

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                found, outcome = one(row)
                rows += [(row.article_seq, row.pmid, *(None if r[k] is None else str(r[k]) for k in FIELDS), outcome, i) for i, r in enumerate(found)] or [(row.article_seq, row.pmid, *[None] * 6, outcome, 0)]
            yield pd.DataFrame(rows, columns=["article_seq", "pmid", *FIELDS, "outcome", "place"])

    return a.mapInPandas(run, OUT)


def semantic_evidence(raw: DataFrame, nodes: DataFrame, threshold: float = 0.5, provider: str = "", watch: Observation | None = None) -> DataFrame:
    """Edge evidence of raw relations: ids cleaned and completed to the article's nodes, confidences normalized, weak ones left out.

    raw is written once, so that no client is asked again. watch: gets the run's counters (COUNTERS) as the evidence is first
    computed, in the same pass.
    """
    r = materialize(raw.withColumn("row", F.monotonically_increasing_id()), "raw")
    ids = nodes.select(F.col("article_seq").alias("art"), "node_id", "node_ord")
    for k in ("1", "2"):
        r = r.withColumn(f"c{k}", clean_id(F.col(f"entity{k}_id")))
        fits = (F.col("node_id") == F.col(f"c{k}")) | (F.startswith("node_id", f"c{k}") & F.substring("node_id", F.length(f"c{k}") + 1, F.lit(1)).isin("_", ";"))
        hit = r.join(ids, (F.col("article_seq") == F.col("art")) & fits & (F.col(f"c{k}") != ""))
        best = hit.groupBy("row").agg(F.min_by("node_id", F.struct(F.col("node_id") != F.col(f"c{k}"), F.col("node_ord"))).alias(f"n{k}"))
        r = r.join(best, "row", "left")
    r = r.withColumn("conf", confidence(F.col("confidence")))
    lost = F.when(F.col("entity1_id").isNull(), "none").when(F.col("n1").isNull() | F.col("n2").isNull(), "unknown").when(F.col("n1") == F.col("n2"), "loop")
    r = r.withColumn("lost", F.coalesce(lost, F.when(~F.coalesce(F.col("conf") >= effective_threshold(threshold, provider), F.lit(False)), "weak")))
    if watch is not None:
        once = F.coalesce("place", F.lit(0)) == 0 if "place" in raw.columns else F.lit(True)
        r = r.observe(watch, *[F.count_if(once & c).alias(n) for n, c in _articles().items()], *[F.count_if(F.col("lost").eqNullSafe(c)).alias(n) for n, c in RELATIONS.items()])
    r = r.where("lost is null")
    return r.select("article_seq", F.least("n1", "n2").alias("u"), F.greatest("n1", "n2").alias("v"), "pmid", relation_name(F.col("relation_type")).alias("relation"), F.col("n1").alias("source_id"), F.col("conf").alias("confidence"), "evidence", "study_type")


#: What becomes of relations: an end that is no node of the article, both ends one node, below the threshold, kept.
RELATIONS = {"unknown_ends": "unknown", "loops": "loop", "below_threshold": "weak", "kept": None}


def _articles() -> dict[str, Column]:
    """What becomes of articles, each counted at its first row."""
    is_ = lambda *o: F.col("outcome").isin(*o)
    return {"attempted": ~is_("skipped"), "skipped": is_("skipped"), "failed": is_("failed"), "unparsed": is_("unparsed"), "empty": is_("none"), "with_relations": is_("ok")}


COUNTERS = ("attempted", "skipped", "failed", "unparsed", "empty", "with_relations", *RELATIONS)


def outcomes(raw: DataFrame) -> DataFrame:
    return raw.groupBy("outcome").agg(F.countDistinct("article_seq").alias("articles"), F.count("entity1_id").alias("relations"))
