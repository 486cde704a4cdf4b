"""BioC-JSON collections: passages, annotations and relations of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.sources.json_objects import read_objects
from weftgraph.sources.tagged_text import Tables

INFONS = "struct<type:string,section_type:string,journal:string,year:string,authors:string,`article-id_doi`:string,volume:string,issue:string,pages:string>"
ANNOTATION = "struct<infons:struct<identifier:string,type:string,subtype:string,name:string,database:string>,text:string,locations:array<struct<offset:int,length:int>>>"
ROLE = "struct<identifier:string,name:string>"
DOCUMENT = f"struct<pmid:string,date:string,journal:string,authors:string,passages:array<struct<infons:{INFONS},text:string,annotations:array<{ANNOTATION}>>>,relations:array<struct<infons:struct<type:string,role1:{ROLE},role2:{ROLE}>>>>"
SCHEMA = f"PubTator3 array<{DOCUMENT}>"
# How a journal line holds its parts.
DOI = r"(?i)doi:\s?(10\.\d{4,}/\S+)\."
REFERENCE = r";(\d+)(?:\(([^)]+)\))?:([^.\s;]+)"


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def journal_parts(journal: Column) -> Column:
    """name, volume, issue and pages of a journal line such as `Name. 2020;12(3):4-5.`"""
    part = lambda n: _text(F.regexp_extract(journal, REFERENCE, n))
    head = F.split_part(journal, F.lit(";"), F.lit(1))
    name = F.trim(F.when(F.contains(head, F.lit(".")), F.regexp_extract(head, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(head))
    return F.struct(_text(name).alias("name"), part(1).alias("volume"), part(2).alias("issue"), part(3).alias("pages"))


def article_date(date: Column, year: Column) -> Column:
    """`...T...Z` loses its time; others stay; a missing one is the year."""
    return F.coalesce(F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}T.*Z$"), F.left(date, F.lit(10))).otherwise(_text(date)), _text(year))


def read_bioc(spark: SparkSession, path: str, full_text: bool = False) -> Tables:
    """Articles that have a title and an abstract, with the annotations of these passages, or of all with full_text. A file of any size is read by many tasks."""
    docs = read_objects(spark, path)
    return _tables(docs.select(F.col("number").alias("article_seq"), F.from_json("text", DOCUMENT).alias("a")).where("a is not null").select("article_seq", "a.*"), full_text)


def bioc_tables(files: DataFrame, full_text: bool = False) -> Tables:
    """Tables of collections (path, part, PubTator3), parts in the order of their path. Article numbers follow path and place."""
    docs = files.select("path", "part", F.posexplode("PubTator3").alias("pos", "a"))
    counts = files.groupBy("path").agg(F.sum(F.size("PubTator3")).alias("n"))  # a row for each file
    base = counts.select(F.col("path").alias("p"), (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("part", "pos")) - 1
    d = docs.withColumn("place", place).join(base, F.col("path") == F.col("p")).withColumn("article_seq", F.col("base") + F.col("place")).select("article_seq", "a.*")
    return _tables(d, full_text)


def _tables(d: DataFrame, full_text: bool) -> Tables:
    has = lambda p, upper: (F.upper(F.coalesce(p["infons"]["section_type"], F.lit(""))) == upper) | (F.lower(F.coalesce(p["infons"]["type"], F.lit(""))) == upper.lower())
    titles, abstracts = F.filter("passages", lambda p: has(p, "TITLE")), F.filter("passages", lambda p: has(p, "ABSTRACT"))
    d = d.withColumn("titles", titles).withColumn("abstracts", abstracts).where((F.size("titles") > 0) & (F.size("abstracts") > 0))
    info = F.get("passages", 0)["infons"]
    journal = F.coalesce(_text(F.col("journal")), info["journal"])
    parts = journal_parts(journal)
    doi = F.coalesce(_text(F.regexp_extract(journal, DOI, 1)), info["article-id_doi"])
    authors = F.coalesce(_text(F.col("authors")), _text(info["authors"]))
    articles = d.select(
        "article_seq", F.trim("pmid").alias("pmid"), article_date(F.col("date"), info["year"]).alias("date"), parts["name"].alias("journal"), doi.alias("doi"), F.get("titles", 0)["text"].alias("title"),
        F.concat_ws(" ", F.transform("abstracts", lambda p: p["text"])).alias("abstract"), F.coalesce(_text(info["volume"]), parts["volume"]).alias("volume"), F.coalesce(_text(info["issue"]), parts["issue"]).alias("issue"),
        F.coalesce(_text(info["pages"]), parts["pages"]).alias("pages"), F.split(authors, r"\s*[;,]\s*").alias("authors"), F.lit(False).alias("use_vocab"),
    )
    scope = F.col("passages") if full_text else F.concat(F.slice("titles", 1, 1), F.col("abstracts"))
    notes = F.filter(F.flatten(F.transform(scope, lambda p: F.coalesce(p["annotations"], F.array().cast(f"array<{ANNOTATION}>")))), lambda n: n["text"].isNotNull())
    rows = F.array_sort(F.transform(notes, lambda n: F.struct(F.get(n["locations"], 0)["offset"].alias("start"), n.alias("n"))))
    m = d.select("article_seq", "pmid", F.posexplode(rows).alias("mention_seq", "r")).select("article_seq", "mention_seq", "pmid", "r.start", "r.n")
    kind, ident = F.col("n.infons.type"), F.col("n.infons.identifier")
    name = F.when(kind == "Species", F.col("n.text")).when(kind == "Variant", F.col("n.infons.name")).when(F.col("n.infons.database") == "omim", F.col("n.text")).otherwise(F.coalesce("n.infons.name", "n.text"))
    mentions = m.select(
        "article_seq", "mention_seq", "pmid", "start", (F.col("start") + F.get("n.locations", 0)["length"]).alias("end"), F.col("n.text").alias("name"), name.alias("identifier_name"),
        F.when(kind == "Variant", F.col("n.infons.subtype")).otherwise(kind).alias("type"), F.when(ident.isNull() | (ident == "None"), "-").otherwise(ident).alias("mesh"),
    )
    r = d.select("article_seq", "pmid", F.posexplode("relations").alias("rel_seq", "r")).select("article_seq", "rel_seq", "pmid", "r.infons.*").where("type is not null and role1.identifier is not null and role2.identifier is not null")
    relations = r.select("article_seq", "rel_seq", "pmid", F.col("type").alias("relation_type"), F.col("role1.identifier").alias("id1"), F.col("role1.name").alias("name1"), F.col("role2.identifier").alias("id2"), F.col("role2.name").alias("name2"))
    return Tables(articles, mentions, relations)


def identifier_names(mentions: DataFrame) -> DataFrame:
    """(article_seq, identifiers): id to name, the later mention's; `-` left out."""
    last = mentions.where("mesh <> '-' and identifier_name is not null").groupBy("article_seq", "mesh").agg(F.max_by("identifier_name", "mention_seq").alias("name"))
    return last.groupBy("article_seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mesh", "name")))).alias("identifiers"))
