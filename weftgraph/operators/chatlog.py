"""Operators on conversations: windows, budgets, listings, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import is_mirna, memory_entry

MEMORY_CHARS = 1800


def history_window(turns: DataFrame, pairs: int = 3, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last `pairs` question-and-answer pairs of each conversation, as 2 x pairs turns."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= 2 * pairs).drop("back")


def memory_budget(entries: DataFrame, budget: int = MEMORY_CHARS, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The newest entries of each conversation whose characters, added up from the newest, stay within the budget."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(w)).where(F.col("used") <= budget)


def pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, question, answer) of user turns followed by an assistant's."""
    w = Window.partitionBy(conv).orderBy(turn)
    t = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return t.where("role = 'user' and next_role = 'assistant'").select(conv, turn, F.col("text").alias("question"), "answer")


def compress_history(turns: DataFrame, keep: int = 3, conv: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """The turns that stay (history_window), and of the pairs that aged out (conv, turn, entry), one memory entry for each.

    A pair is a user's turn and the assistant's next; turns without their other half age out without an entry.
    """
    kept = history_window(turns, keep, conv, turn)
    first = kept.groupBy(F.col(conv).alias("c")).agg(F.min(turn).alias("first"))
    old = pairs(turns, conv, turn).join(first, F.col(conv) == F.col("c")).where(F.col(turn) < F.col("first"))
    return kept, old.select(conv, turn, memory_entry(F.col("question"), F.col("answer")).alias("entry"))


def memory_text(entries: DataFrame, conv: str = "conv_id", turn: str = "turn", budget: int = MEMORY_CHARS) -> DataFrame:
    """(conv, memory): the entries within the budget, numbered from the oldest, under one heading."""
    e = memory_budget(entries, budget, conv, turn, "entry").groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "entry"))).alias("e"))
    lines = F.transform("e", lambda x, i: F.concat(F.lit("[Turn "), (i + 1).cast("string"), F.lit("]\n"), x["entry"]))
    return e.select(conv, F.concat(F.lit("### Long-term Conversation Memory (earlier turns, compressed)\n"), F.array_join(lines, "\n\n")).alias("memory"))


def save_history(turns: DataFrame, memory: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn") -> None:
    """One JSON object for each conversation: its turns and its memory entries, both in order."""
    cols = [c for c in turns.columns if c != conv]
    t = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, *[c for c in cols if c != turn]))).alias("history"))
    m = memory.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "entry"))).alias("memory"))
    t.join(m, conv, "full").write.json(path)


def load_history(spark: SparkSession, path: str, schema: str = "conv_id long, turn long, role string, text string") -> tuple[DataFrame, DataFrame]:
    """turns and memory entries as save_history had them; schema is that of the turns, its first column the conversation."""
    conv, *rest = [f.strip() for f in schema.split(",")]
    inner = ", ".join(f.replace(" ", ":", 1) for f in rest)
    d = spark.read.schema(f"{conv}, history array<struct<{inner}>>, memory array<struct<turn:long,entry:string>>").json(path)
    key = conv.split()[0]
    return d.select(key, F.explode("history").alias("h")).select(key, "h.*"), d.select(key, F.explode("memory").alias("m")).select(key, "m.*")


def session_statistics(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    return turns.groupBy(conv).agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers"))


def listing(nodes: DataFrame, kind: str) -> DataFrame:
    """Genes by name with their articles: those named like a miRNA, or all others (mrna); three ids and how many more."""
    n = nodes.where((F.col("type") == "Gene") & (is_mirna(F.col("name")) if kind == "mirna" else ~is_mirna(F.col("name"))))
    g = n.select("name", F.explode_outer("pmids").alias("p")).groupBy("name").agg(F.array_sort(F.collect_set("p")).alias("pmids"))
    return g.withColumn("shown", shown_ids(F.col("pmids"))).orderBy(F.lower("name"), "name")


def shown_ids(ids: Column, most: int = 3) -> Column:
    more = F.size(ids) - most
    return F.concat(F.concat_ws(", ", F.slice(ids, 1, most)), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def sources(retrieved: Column, cited: Column) -> Column:
    """Retrieved ids that are cited, in the order of retrieval."""
    return F.filter(retrieved, lambda x: F.array_contains(cited, x))


def study_type(entities: Column) -> Column:
    """`animal/in vitro (a, b)` for documents that name a species other than human, by at most two names; else null."""
    other = F.array_distinct(F.transform(F.filter(entities, lambda e: (e["type"] == "Species") & ~F.lower(e["name"]).isin("human", "humans", "patient", "patients", "homo sapiens")), lambda e: e["name"]))
    return F.when(F.size(other) > 0, F.concat(F.lit("animal/in vitro ("), F.concat_ws(", ", F.slice(other, 1, 2)), F.lit(")")))


def recent_searches(log: DataFrame, by: str, query: str = "query", at: str = "at", most: int = 8) -> DataFrame:
    """Distinct queries of each user, the most recent first."""
    last = log.groupBy(by, query).agg(F.max(at).alias(at))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), query))).where(F.col("rank") <= most)
