"""Sessions, table access and the shared folder for cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN_DIR = "weftgraph.shared.dir"
#: Rows that a task sorts or groups at a time, about: some 100 bytes each, whatever they take on disk.
TASK_ROWS = 250_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weftgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    # a core setting: fixed when the context starts, so a folder of our own is kept under a key of our own
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set(OWN_DIR, found)
    return found.rstrip("/")


def tasks(df: DataFrame, rows: int) -> int:
    """Into how many tasks so many rows are dealt: shuffles are else joined by their compressed bytes, and a task may get many times the rows that it can hold."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


#: Of each session: the tables written since the innermost open scratch() began; none is kept outside of one.
_open: dict[int, list[list[str]]] = {}


def materialize(df: DataFrame, name: str = "step", replaces: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    replaces: a table made by this function that nothing will read again; it is deleted after the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if replaces is not None and (old := getattr(replaces, "_written", None)):
        delete(spark, old)
    for paths in _open.get(id(spark), [])[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """df with its rows numbered from 0 in a total order. Ranges are sorted in parallel; the driver sees one count for each."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranges")
    before, total = [], 0
    for r in sorted(ranges.groupBy("_range").count().collect()):
        before += [F.lit(r["_range"]), F.lit(total)]
        total += r["count"]
    first = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0)
    return ranges.withColumn(name, (F.col("_place") + first).cast("long")).drop("_range", "_place")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that materialize() wrote within. Results must have been written or collected by then."""
    opened = _open.setdefault(id(spark), [])
    opened.append([])
    try:
        yield
    finally:
        for path in opened.pop():
            delete(spark, path)
        if not opened:
            del _open[id(spark)]
