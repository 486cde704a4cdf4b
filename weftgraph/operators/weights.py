"""Edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = 20.0


def npmi(n_x: Column, n_y: Column, n_xy: Column, n: Column, least: int = 2) -> Column:
    """Normalized pointwise mutual information; 0 for counts that are not positive, 1 if the pair is everywhere, and at most 0 for a rare end."""
    p, px, py = n_xy / n, n_x / n, n_y / n
    raw = F.when(p == 1, F.lit(1.0)).otherwise(F.try_divide(F.log2(px) + F.log2(py), F.log2(p)) - 1)
    capped = F.when((n_x < least) | (n_y < least), F.least(raw, F.lit(0.0))).otherwise(raw)
    return F.when((n_x <= 0) | (n_y <= 0) | (n_xy <= 0), F.lit(0.0)).otherwise(capped)


def frequency_factor(largest: Column) -> Column:
    """Weights stay as they are up to 20, and shrink in proportion where the largest is above."""
    return F.coalesce(F.least(F.try_divide(F.lit(LARGEST), largest), F.lit(1.0)), F.lit(1.0))


def set_weights(edges: DataFrame, method: str = "freq", weight: str = "weighted_num_relations") -> DataFrame:
    """edges with edge_weight and edge_width, from counts (freq) or npmi."""
    if method == "npmi":
        e = edges.withColumn("scaled", F.col("npmi") * LARGEST)
    else:
        largest = edges.agg(F.max(weight).alias("largest"))
        e = edges.crossJoin(F.broadcast(largest)).withColumn("scaled", F.col(weight) * frequency_factor(F.col("largest"))).drop("largest")  # one row
    e = e.withColumn("edge_weight", F.round(F.greatest(F.col("scaled"), F.lit(0.0)), 2)).drop("scaled")
    return e.withColumn("edge_width", F.greatest("edge_weight", F.lit(1.0)))


def add_npmi(edges: DataFrame, nodes: DataFrame, articles: Column | int) -> DataFrame:
    """edges with npmi from weighted counts of edges and nodes; articles is the number of all articles, repeats counted."""
    n = articles if isinstance(articles, Column) else F.lit(float(articles))
    x = nodes.select(F.col("node_id").alias("u"), F.col("weighted_num_articles").alias("n_u"))
    y = nodes.select(F.col("node_id").alias("v"), F.col("weighted_num_articles").alias("n_v"))
    e = edges.join(x, "u").join(y, "v")
    return e.withColumn("npmi", npmi(F.col("n_u"), F.col("n_v"), F.col("weighted_num_relations"), n)).drop("n_u", "n_v")


def citation_weight(citations: Column, date: Column, year: int) -> Column:
    """log10(citations a year + 1.1) + 1; the year of publication is the first four digits of the date, else this year."""
    published = F.coalesce(F.nullif(F.regexp_extract(date, r"(\d{4})", 1), F.lit("")).try_cast("int"), F.lit(year))
    age = F.greatest(F.lit(year) - published + 1, F.lit(1))
    return F.round(F.log10(F.coalesce(citations, F.lit(0)) / age + 1.1) + 1, 3)


def shown_weight(width: Column) -> Column:
    return F.round(F.greatest(width, F.lit(1.0)), 1)


def largest_over(weight: str) -> Column:
    return F.max(weight).over(Window.partitionBy())
