"""Helpers shared by the training-data operators: shared scratch tables, hashing, distributed ranks and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch, about, where the session sets no bound of its own. By rows alone a batch of long texts takes
#: tens of MB, several times over in the JVM and in each Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage, outlive executors and go when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)  # a folder that is not there yet is not noted for removal
        self._fs.deleteOnExit(path)
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")  # the shuffle files of a step go when its table is written
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tracemill_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a saved table that nothing unevaluated reads any more."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._tracemill_path), True)


def bounded(rows: DataFrame) -> DataFrame:
    """The same rows, whose Arrow batches, as all later ones of the session, are bounded in bytes."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), without whatever else the table carries."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, blocks: int = 1024, attach: DataFrame | None = None) -> DataFrame:
    """df with `name`: a gapless rank from 0 within `keys`, by hash blocks of `order` and by `order` inside a block.

    No window holds a whole key: rows are numbered inside (keys, block), and the offsets of the blocks come from counts,
    of which a key has at most `blocks`. Rows that tie in `order` are interchangeable. `attach` has one row for each key
    at most; its other columns are added by way of the counts, so that a large key is not gathered for that either.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if attach is not None:
        before = before.join(attach, keys, "left")
    rows = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1)
    return rows.join(before, [*keys, "_block"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_block", "_before", "_in")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges, for every node with an edge.

    Large-star and small-star rounds until nothing changes; every round is a written table, and each edge set stays
    linear in the number of nodes and edges. Raises if `rounds` do not suffice rather than return parts of components.
    """
    now = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.save(small, "stars")
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
    raise RuntimeError(f"components did not settle in {rounds} rounds")
