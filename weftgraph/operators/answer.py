"""Answers to questions about a graph's articles: listing, paths, retrieval, an injected client, citations and history, in this order.

The driver holds one conversation and the k documents and paths that a question retrieves; everything else is a query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.engine import Graph
from weftgraph.functions import text as tx
from weftgraph.operators import chatlog, retrieval

TURNS = "conv_id long, turn long, role string, text string"

SUMMARY_CHARS, CUT_NOTE = 12000, "\n...(truncated)..."  # fixed values


def joined_abstracts(rows: DataFrame, key: str = "pmid", abstract: str = "abstract", limit: int = SUMMARY_CHARS) -> str:
    """Abstracts in the order of their keys, an empty line between two, cut at `limit` characters with a note that says so.

    Each row brings at least the two characters between it and the next, so more than limit rows are never needed, nor more than limit
    characters of one: what reaches the driver is what a prompt can hold, whatever the number of rows.
    """
    a = rows.where(F.col(abstract).isNotNull()).select(F.col(key).alias("k"), F.left(abstract, F.lit(limit + 1)).alias("a"), F.length(abstract).alias("n"))
    first = a.orderBy("k", "a").limit(limit // 2 + 2)
    before = F.sum(F.col("n") + 2).over(Window.orderBy("k", "a").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= limit).orderBy("k", "a").collect()
    text = "\n\n".join(r["a"] for r in kept)
    return text[:limit] + CUT_NOTE if len(text) > limit else text


@dataclass
class Conversation:
    """documents: (pmid, title, abstract, embedding, weight, and entities for study types); lines: (pmid, source, relation, target).

    embed makes the vector of a question, client answers a list of {role, content}, translate (if given) turns a question
    into English. What the client is told besides context, history and question is `system`, the caller's own.
    """

    spark: SparkSession
    documents: DataFrame
    lines: DataFrame
    embed: Callable[[str], list[float]]
    client: Callable[[list[dict[str, str]]], str]
    graph: Graph | None = None
    translate: Callable[[str], str] | None = None
    language: str = "English"
    system: str = ""
    keep: int = 3
    turns: list[tuple[int, int, str, str]] = field(default_factory=list)

    def _one(self, *c: Column) -> Any:
        row = self.spark.range(1).select(*c).first()
        return row[0] if len(c) == 1 else tuple(row)

    def ask(self, question: str, k: int = 8) -> dict[str, Any]:
        """message, sources (ids retrieved and cited), context_count and success; a failure is told, and leaves no turn behind."""
        kind, again, han = self._one(tx.listing_kind(F.lit(question)), tx.asks_for_earlier_answer(F.lit(question)), tx.has_han(F.lit(question)))
        try:
            if kind and self.graph is not None and (told := self._listing(kind)):
                return self._keep(question, told)
            context, ids = "", []
            if not (again and self.turns):
                foreign = han or self.language != "English"
                context, ids = self._context(self.translate(question) if foreign and self.translate else question, k)
            message = self.client(self.messages(question, context))
            cited = self._one(tx.cited_ids(F.lit(message)))
            return self._keep(question, {"message": message, "sources": [i for i in ids if i in cited], "context_count": len(ids)})
        except Exception as e:  # of the injected functions
            return {"success": False, "message": "", "error": str(e), "sources": [], "context_count": 0}

    def _keep(self, question: str, told: dict[str, Any]) -> dict[str, Any]:
        n = len(self.turns)
        self.turns += [(0, n, "user", question), (0, n + 1, "assistant", told["message"])]
        return {"success": True, **told}

    def _listing(self, kind: str) -> dict[str, Any] | None:
        rows = chatlog.listing(self.graph.nodes, kind).collect()
        if not rows:
            return None
        return {"message": "\n".join(f"- {r['name']} (PMID: {r['shown']})" for r in rows), "sources": sorted({p for r in rows for p in r["pmids"]}), "context_count": len(rows)}

    def _context(self, question: str, k: int) -> tuple[str, list[str]]:
        parts, preferred = [], None
        if self.graph is not None:
            found = self.graph.path_records(question).collect()  # at most 20 rows
            parts += [r["text"] for r in found]
            ids = sorted({p for r in found for h in r["hops"] for p in h["pmids"]})
            preferred = self.spark.createDataFrame([(p,) for p in ids], "pmid string") if ids else None
        best = retrieval.hybrid(self.documents, self.embed(question), k, preferred=preferred, id_col="pmid")
        # a set of no more than k documents is used whole, also in the order of relevance, with ranks and kinds of study
        whole = self.documents.limit(k + 1).count() <= k
        c = retrieval.document_context(best, self.lines)
        rows = c.join(best.select("pmid", "weight", *(["entities"] if "entities" in best.columns else [])), "pmid").orderBy(F.desc("score"), "pmid")
        study = F.coalesce(chatlog.study_type(F.col("entities")), F.lit("Human/General")) if "entities" in best.columns else F.lit("Human/General")
        shown = rows.select("pmid", "context", "weight", study.alias("study")).collect()  # k rows
        for rank, r in enumerate(shown, 1):
            head, _, rest = r["context"].partition("\n")
            parts.append(f"PMID: {r['pmid']} [Relevance #{rank} (Impact Score: {r['weight']:.2f})] [Study Type: {r['study']}]\n{rest}" if whole else r["context"])
        return "\n---\n\n".join(parts), [r["pmid"] for r in shown]

    def messages(self, question: str, context: str) -> list[dict[str, str]]:
        """The system text with the memory of earlier turns, the turns still kept, and the question after its context."""
        kept, memory = [], ""
        if self.turns:
            stay, old = chatlog.compress_history(self.spark.createDataFrame(self.turns, TURNS), self.keep)
            kept = [{"role": r["role"], "content": r["text"]} for r in stay.withColumn("text", F.when(F.col("role") == "assistant", tx.compressed_answer(F.col("text"))).otherwise(F.col("text"))).orderBy("turn").collect()]
            memory = "".join(r["memory"] for r in chatlog.memory_text(old).collect())
        head = "\n\n".join(x for x in (self.system, memory) if x)
        now = f"{context}\n\n{question}" if context else question
        return [*([{"role": "system", "content": head}] if head else []), *kept, {"role": "user", "content": now}]

    def summarize(self, abstracts: DataFrame, instruction: str, pmid: str = "pmid", abstract: str = "abstract") -> str:
        """The client's summary of a selection's abstracts, in the order of their ids, cut at SUMMARY_CHARS characters; empty for none."""
        text = joined_abstracts(abstracts, pmid, abstract)
        head = [{"role": "system", "content": self.system}] if self.system else []
        return self.client([*head, {"role": "user", "content": f"{instruction}\n\n{text}"}]) if text else ""

    def statistics(self) -> dict[str, int]:
        roles = [r for _, _, r, _ in self.turns]
        return {"messages": len(roles), "questions": roles.count("user"), "answers": roles.count("assistant"), "documents": self.documents.select("pmid").distinct().count()}

    def save(self, path: str) -> None:
        turns = self.spark.createDataFrame(self.turns, TURNS)
        chatlog.save_history(turns, chatlog.compress_history(turns, self.keep)[1], path)

    def load(self, path: str) -> None:
        turns, _ = chatlog.load_history(self.spark, path, TURNS)
        self.turns = [tuple(r) for r in turns.orderBy("turn").collect()]

    def clear(self) -> None:
        self.turns = []
