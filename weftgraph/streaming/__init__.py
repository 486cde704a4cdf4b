"""Incremental counts of pairs that occur together, over a stream of events (an addition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def event_stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """(start, event_type, n): counts by event-time window; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def daily_pairs(events: DataFrame) -> DataFrame:
    """(day, t1, t2, users): users who have events of both types on a day."""
    sets = events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    a = sets.select("day", "user_id", "types", F.explode("types").alias("t1")).select("day", "user_id", "t1", F.explode(F.filter("types", lambda t: t > F.col("t1"))).alias("t2"))
    return a.groupBy("day", "t1", "t2").agg(F.count("*").alias("users"))


def pairs_stream(events: DataFrame, path: str, late: str = "1 day") -> DataStreamWriter:
    """A writer that keeps daily_pairs of a stream of events (ts, user_id, event_type) up to date in the folder `path`.

    Repeats, and rows later than the watermark, are left out by Spark's state. A batch meets what its days and users have shown
    before, and adds what is new: rows (day, t1, t2, users) whose sums are the counts. What a batch writes has its number, so a
    batch that runs again replaces its own rows. Read with read_pairs.
    """
    first = events.where("ts is not null and user_id is not null and event_type is not null").select(F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    first = first.withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "user_id", "event_type"])

    def upsert(new: DataFrame, batch: int) -> None:
        spark = new.sparkSession
        at = f"batch={batch}"
        new.select("day", "user_id", "event_type").write.mode("overwrite").parquet(f"{path}/seen/{at}")
        seen = spark.read.schema("day date, user_id long, event_type string, batch long").parquet(f"{path}/seen").where(F.col("batch") <= batch)
        days = seen.where(F.col("batch") == batch).select("day", "user_id").distinct()
        seen = seen.join(days, ["day", "user_id"], "left_semi")
        a = seen.where(F.col("batch") == batch).select("day", "user_id", F.col("event_type").alias("x"))
        b = seen.select("day", "user_id", F.col("event_type").alias("y"), "batch")
        # a pair of two new types is met from both sides, and counted from the smaller
        met = a.join(b, ["day", "user_id"]).where((F.col("x") != F.col("y")) & ((F.col("batch") < batch) | (F.col("x") < F.col("y"))))
        sums = met.groupBy("day", F.least("x", "y").alias("t1"), F.greatest("x", "y").alias("t2")).agg(F.count("*").alias("users"))
        sums.write.mode("overwrite").parquet(f"{path}/pairs/{at}")

    return first.writeStream.outputMode("append").foreachBatch(upsert)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(day, t1, t2, users) so far."""
    rows = spark.read.schema("day date, t1 string, t2 string, users long, batch long").parquet(f"{path}/pairs")
    return rows.groupBy("day", "t1", "t2").agg(F.sum("users").alias("users"))
