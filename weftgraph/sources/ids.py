"""Article id lists, weights, citation counts, and fetching through an injected client."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize, numbered
from weftgraph.sources.tagged_text import Tables, tables_of


def parse_ids(lines: DataFrame, line: str = "value", order: str = "pos") -> DataFrame:
    """(pmid, pos) of lines with comma-separated ids; what is no integer is dropped, repeats keep their first place."""
    parts = lines.select(F.col(order).alias("line"), F.posexplode(F.split(line, ",")).alias("k", "raw")).withColumn("pmid", F.trim("raw"))
    good = parts.where(F.col("pmid").try_cast("long").isNotNull())
    return good.groupBy("pmid").agg(F.min(F.struct("line", "k")).alias("pos"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return parse_ids(files.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")))


def dedupe_ids(ids: DataFrame, pmid: str = "pmid", order: str = "pos") -> DataFrame:
    """Trimmed ids, the first of each; blank ones go."""
    return ids.select(F.trim(pmid).alias("pmid"), order).where("pmid <> ''").groupBy("pmid").agg(F.min(order).alias(order))


def take_articles(articles: DataFrame, most: int) -> DataFrame:
    return articles.orderBy("article_seq").limit(most)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """`pmid,weight` lines without a header; lines that do not fit are dropped."""
    return spark.read.csv(path, schema="pmid string, weight double").select(F.trim("pmid").alias("pmid"), "weight").where("pmid <> '' and weight is not null")


def with_citations(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """articles with citation_count from (pmid, citation_count); 0 where there is none."""
    return articles.drop("citation_count").join(citations.groupBy("pmid").agg(F.max("citation_count").alias("citation_count")), "pmid", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


def response_ids(line: Column) -> Column:
    """The id of a line of a citation search's answer; null for comments and blank lines."""
    return F.when(~F.startswith(F.trim(line), F.lit("#")) & (F.trim(line) != ""), F.trim(F.split_part(line, F.lit("\t"), F.lit(1))))


Page = Callable[[str, int], list[str]]


def search_ids(spark: SparkSession, query: str, client: Page, most: int, page: int = 100) -> DataFrame:
    """(pmid, pos): the first ids of a search through an injected client, which answers a query and a page number from 1 with that page's ids."""
    found: list[str] = []
    for k in range(1, -(-most // page) + 1):
        ids = client(query, k)
        found += ids
        if len(ids) < page:
            break
    return dedupe_ids(spark.createDataFrame([(x, i) for i, x in enumerate(found)], "pmid string, pos int")).orderBy("pos").limit(most)


def cited_first(spark: SparkSession, query: str, cites: Callable[[str], str], client: Page, most: int) -> DataFrame:
    """(pmid, pos) by the text of a citation search; if that fails, by the plain search."""
    try:
        lines = cites(query).splitlines()
    except Exception:  # whatever the injected call raises
        return search_ids(spark, query, client, most)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos int, value string")
    return dedupe_ids(rows.select(response_ids(F.col("value")).alias("pmid"), "pos").where("pmid is not null")).orderBy("pos").limit(most)


def fetch_enough(ids: DataFrame, client: Callable[[list[str]], list[tuple[str, str]]], read: Callable[[DataFrame], Tables], most: int, batch: int = 100) -> Tables:
    """Tables of the first `most` articles that can be had of ids (pmid, pos), fetched through client and read by read.

    A tenth and two more ids than asked for are fetched first, then a fifth and two more than are missing, until there are
    enough or no ids are left. The driver holds the ids' number and the counts; articles stay in the order of the ids.
    """
    order = materialize(numbered(ids.select("pmid", "pos"), "pos", "pmid", name="place"), "asked")
    total, done, want, found = order.count(), 0, int(most * 1.1) + 2, None
    while done < total:
        part = order.where((F.col("place") >= done) & (F.col("place") < done + want))
        got = materialize(fetch(part.select("pmid"), client, batch).where("body is not null").join(part.select("pmid", "place"), "pmid"), "fetched")
        found = got if found is None else found.unionByName(got)
        done += want
        tables = read(found)
        missing = most - tables.articles.count()
        if missing <= 0:
            break
        want = int(missing * 1.2) + 2
    if found is None:
        return read(order.select("pmid", F.lit("").alias("body"), F.lit("").alias("error"), "place").limit(0))
    kept = take_articles(tables.articles, most).select("article_seq")
    return Tables(*(t.join(kept, "article_seq", "left_semi") for t in tables))


def read_bodies(bodies: DataFrame, format: str = "text", full_text: bool = False) -> Tables:
    """Tables of fetched bodies (body, place), in the order of place: tagged text, or BioC-JSON (bioc)."""
    if format == "bioc":
        from weftgraph.sources.bioc_json import SCHEMA, bioc_tables

        files = bodies.select(F.lit("").alias("path"), F.col("place").alias("part"), F.from_json("body", f"struct<{SCHEMA.replace(' ', ':', 1)}>").alias("j"))
        return bioc_tables(files.select("path", "part", "j.PubTator3").where("PubTator3 is not null"), full_text)
    lines = bodies.select(F.lit("").alias("path"), F.col("place").alias("block"), F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    return tables_of(lines)


def uploaded_text(content: Column, most_bytes: int) -> Column:
    """The text of a data URL in base64, as UTF-8 or else Latin-1; null if it is none, or larger than most_bytes."""
    data = F.regexp_extract(content, r"(?s)^data:[^,]*;base64,(.*)$", 1)
    good = data.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(data) % 4 == 0)
    raw = F.when(good & (F.octet_length(data) * 3 / 4 <= most_bytes + 2), F.unbase64(data))
    text = F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.when((content.rlike("^data:[^,]*;base64,")) & (F.octet_length(raw) <= most_bytes), text)


def fetch(ids: DataFrame, client: Callable[[list[str]], list[tuple[str, str]]], batch: int = 100) -> DataFrame:
    """(pmid, body, error) through an injected client, which gets up to `batch` ids at a time and does its own retries."""
    numbered = ids.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("pmid"), F.lit(64))).orderBy("pmid")) - 1) / batch))

    def run(pdf):
        import pandas as pd

        try:
            rows = [(p, b, None) for p, b in client(pdf["pmid"].tolist())]
        except Exception as e:  # the batch is reported as failed, others go on
            rows = [(p, None, str(e)) for p in pdf["pmid"]]
        return pd.DataFrame(rows, columns=["pmid", "body", "error"])

    return numbered.groupBy(F.pmod(F.xxhash64("pmid"), F.lit(64)).alias("g"), "part").applyInPandas(run, "pmid string, body string, error string")
