"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share the words of all documents by weight, up to `most_passes` times a source's own words. The words of a
source, its documents in shuffled order, are cut into blocks of equally many words. Slot k of the schedule stands
at the golden-ratio point frac(k * phi); the source whose stretch of the cumulative weights holds that point takes
the slot, and the r-th slot of a source takes its block r modulo its number of blocks. Slots are ranked, and words
summed up before each document, in two steps over chunks, so no source has to pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: What separates words; size counts the runs of everything else.
WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949
#: frac(2**20 * phi), to keep k * phi precise for large k.
PHI_HIGH = (2**20 * 0.61803398874989484820458683436563811772) % 1
BLOCK_WORDS = 64
CHUNK = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_passes: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Sources by code point, null last, take the weights in turn. The level that shares the total is found in closed
    form over the sources sorted by cap / weight; windows here hold one row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most_passes)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
    )
    # the sources below the final level are capped; from the first that is not on, the levels fall
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return t.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "weight", "target")


def schedule(spark, shares: DataFrame, slots: int) -> DataFrame:
    """(slot, source, rank): golden-ratio points mapped through cumulative targets; rank counts a source's earlier slots."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    total = F.sum("target").over(Window.partitionBy())
    cum = shares.where("target > 0").withColumn("high", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total)
    cum = cum.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    # the unit interval is cut into equal cells, several for each source, and a point is looked up among its cell's stretches
    cells = max(64, 4 * shares.count())
    last = F.lead("low").over(order).isNull()
    cum = cum.select("source", "low", F.when(last, F.lit(2.0)).otherwise(F.col("high")).alias("high"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    cum = materialize(cum.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))), "stretches")
    k = F.col("slot")
    point = F.pmod(F.floor(k / (1 << 20)) * F.lit(PHI_HIGH) + F.pmod(k, F.lit(1 << 20)) * F.lit(PHI), F.lit(1.0))
    slots_df = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    dealt = slots_df.join(cum, "cell").where("low <= point and point < high").select("slot", "source", F.floor(k / CHUNK).alias("chunk"))
    before = dealt.groupBy("source", "chunk").count()
    earlier = F.sum("count").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("source", "chunk", F.coalesce(earlier, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    d, b = dealt.withColumn("inner", inner), before.withColumnsRenamed({"source": "s", "chunk": "c"})
    return d.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select("slot", "source", (F.col("inner") + F.col("before")).alias("rank"))


def offsets(sized: DataFrame, seed: int, per_bucket: int = 2000) -> DataFrame:
    """sized with `start`, the words before the document in its source's shuffled order. Null-safe on source.

    Rows are ordered by a hash of doc_id; the order between rows that repeat a doc_id follows their sizes.
    """
    buckets = max(1, sized.count() // per_bucket)
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    s = sized.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 1) % F.lit(buckets))
    sums = s.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(earlier, F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return s.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("inside")).drop("h", "bucket", "inside", "base", "s", "b")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_passes: int = 3, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, source, text).

    Null and wordless texts have size 0 and take 0 words. A null source is a source of its own, the last one. An
    empty table gives no rows. Rows with the same doc_id count one by one. Reruns agree.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row"))
    sized = materialize(sized, "sized")
    shares = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_passes).coalesce(1), "targets")
    total = sized.agg(F.sum("size")).first()[0] or 0
    slots = schedule(spark, shares, -(-total // block_words))
    s = shares.select(F.col("source").alias("s"), "source_size", "target", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).alias("blocks"))
    uses = (
        slots.join(s, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source", F.pmod("rank", "blocks").alias("block"))
        .agg(F.least(F.count("*"), F.lit(most_passes)).alias("uses"))
        .withColumnsRenamed({"source": "us", "block": "ub"})
    )
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    placed = offsets(sized, seed)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    used = pieces.join(uses, F.col("source").eqNullSafe(F.col("us")) & (F.col("block") == F.col("ub")), "left")
    # within a source each row with words has a start of its own
    taken = used.groupBy("source", "start").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(overlap * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = sized.where("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    out = taken.select("source", "doc_id", "size", "taken").unionByName(none)
    return out.join(s, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
