"""Tagged text: `##` headers, `id|t|title`, `id|a|abstract`, tab-separated annotations and relations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY_HEADER = "##USE-MESH-VOCABULARY"  # fixed value


class Tables(NamedTuple):
    articles: DataFrame
    mentions: DataFrame
    relations: DataFrame


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, pos, line) of all files under path. Files are read in blocks, so that one of any size is read by many tasks; lines are ordered by block and pos."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    return lines.select("path", "block", "pos", F.regexp_replace("value", "\r$", "").alias("line"))


def read_tagged_text(spark: SparkSession, path: str) -> Tables:
    """Tables of all files under path, whatever their number and size. See tables_of for the numbers of articles."""
    return tables_of(ordered_lines(spark, path))


def tables_of(lines: DataFrame) -> Tables:
    """Tables of lines (path, block, pos, line). A title line starts an article.

    Article numbers follow path, block and pos. Lines are counted within blocks, and the blocks' sums give the numbers before
    each, so no file has to pass through one task. Lines before the first title of a file are left out.
    """
    header = F.max(F.startswith("line", F.lit("##")) & (F.trim("line") == VOCABULARY_HEADER)).alias("use_vocab")
    bar, tab = F.split("line", r"\|", 3), F.split("line", "\t")
    kind = (
        F.when((F.size(bar) == 3) & (F.get(bar, 1) == "t"), "title").when((F.size(bar) == 3) & (F.get(bar, 1) == "a"), "abstract")
        .when(F.size(tab) == 6, "mention").when(F.size(tab) == 4, "relation")
    )
    vocab = lines.groupBy("path").agg(header).withColumnRenamed("path", "vp")
    lines = lines.withColumn("kind", kind).where("kind is not null")
    title = F.when(F.col("kind") == "title", 1).otherwise(0)
    blocks = lines.groupBy("path", "block").agg(F.sum(title).alias("n"))  # a row for each block
    blocks = blocks.withColumn("base", F.sum("n").over(Window.orderBy("path", "block")) - F.col("n"))
    blocks = blocks.select(F.col("path").alias("p"), F.col("block").alias("b"), "base", F.min("base").over(Window.partitionBy("path")).alias("file_base"))
    order = Window.partitionBy("path", "block").orderBy("pos")
    lines = lines.withColumn("art", F.sum(title).over(order)).join(blocks, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    lines = lines.withColumn("article_seq", F.col("art") + F.col("base") - 1).where("article_seq >= file_base")
    lines = lines.join(vocab, F.col("path") == F.col("vp")).withColumn("pos", F.struct("block", "pos")).drop("p", "b", "vp")
    first = lambda k, c: F.min_by(F.when(F.col("kind") == k, c), F.when(F.col("kind") == k, F.col("pos")))
    articles = lines.where("kind in ('title', 'abstract')").groupBy("article_seq").agg(
        first("title", F.get(bar, 0)).alias("pmid"), first("title", F.get(bar, 2)).alias("title"), F.coalesce(first("abstract", F.get(bar, 2)), F.lit("")).alias("abstract"), F.first("use_vocab").alias("use_vocab")
    )
    seq = F.row_number().over(Window.partitionBy("article_seq").orderBy("pos")) - 1
    mentions = lines.where("kind = 'mention'").select(
        "article_seq", seq.alias("mention_seq"), F.get(tab, 0).alias("pmid"), F.get(tab, 1).try_cast("int").alias("start"), F.get(tab, 2).try_cast("int").alias("end"),
        F.get(tab, 3).alias("name"), F.lit(None).cast("string").alias("identifier_name"), F.get(tab, 4).alias("type"), F.get(tab, 5).alias("mesh"),
    )
    relations = lines.where("kind = 'relation'").select(
        "article_seq", seq.alias("rel_seq"), F.get(tab, 0).alias("pmid"), F.get(tab, 1).alias("relation_type"), F.get(tab, 2).alias("id1"), F.lit(None).cast("string").alias("name1"),
        F.split_part(F.get(tab, 3), F.lit(";"), F.lit(1)).alias("id2"), F.lit(None).cast("string").alias("name2"),
    )
    return Tables(articles, mentions, relations)
