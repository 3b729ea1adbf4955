"""Prepared token tables: encoded examples with their order, checks on reading, and a packed binary form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IGNORED = -100
MAGIC = b"TOK1"


def pack_example(ids: list[int], mask: list[int], labels: list[int]) -> bytes:
    """MAGIC, the length as an unsigned and three runs of signed little-endian 32-bit numbers."""
    if not len(ids) == len(mask) == len(labels):
        raise ValueError("the three runs of an example have one length")
    return MAGIC + np.uint32(len(ids)).astype("<u4").tobytes() + np.array([ids, mask, labels], dtype="<i4").tobytes()


def unpack_example(data: bytes) -> tuple[list[int], list[int], list[int]]:
    n = int(np.frombuffer(data[4:8], "<u4")[0]) if data[:4] == MAGIC and len(data) >= 8 else -1
    if len(data) != 8 + 12 * n:
        raise ValueError("no packed example")
    return tuple(part.tolist() for part in np.frombuffer(data[8:], "<i4").reshape(3, n))


def write_tokens(examples: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """examples (split, row_ordinal, event, input_ids, labels), numbered by row_ordinal and event within each split.

    `encode` makes input_ids and labels of rows that come without; it runs once, after rows are numbered, so that the smaller
    rows are dealt. Numbers are given by ranges of row_ordinal, so that no split is sorted in one place: counts of the ranges give offsets.
    """
    ranged = examples.repartitionByRange("split", "row_ordinal").withColumn("_part", F.spark_partition_id())
    ranged.write.mode("errorifexists").parquet(f"{path}/unnumbered")
    rows = examples.sparkSession.read.parquet(f"{path}/unnumbered")
    counts = rows.groupBy("split", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("split").orderBy("_part")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("split", "_part").orderBy("row_ordinal", "event")) - 1
    numbered = rows.withColumn("_in", inside).join(F.broadcast(before), ["split", "_part"]).withColumn("ordinal", (F.col("_before") + F.col("_in")).cast("long"))
    encode(numbered.drop("_part", "_in", "_before")).write.mode("errorifexists").partitionBy("split").parquet(f"{path}/rows")


def violations(rows: DataFrame, vocabulary: int) -> DataFrame:
    """(split, ordinal, reason) of rows out of order or out of range: ordinals run gapless from 0, row_ordinal stays or rises by
    one, events rise within a row, ids are in the vocabulary, labels are the id or ignored and some label is not."""
    # neighbours by a join on the ordinal: a window would sort a whole split in one task
    previous = rows.select("split", (F.col("ordinal") + 1).alias("ordinal"), F.col("row_ordinal").alias("_row"), F.col("event").alias("_event"))
    own = {
        "vocabulary": F.exists("input_ids", lambda t: (t < 0) | (t >= vocabulary)),
        "length": F.size("input_ids") != F.size("labels"),
        "label": F.exists(F.zip_with("input_ids", "labels", lambda i, y: (y != IGNORED) & (y != i)), lambda x: x),
        "unsupervised": ~F.exists("labels", lambda y: y != IGNORED),
    }
    named = lambda found: F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in found.items()]))
    # what a row shows by itself is told before the join, which moves no arrays of ids
    held = rows.select("split", "ordinal", "row_ordinal", "event", named(own).alias("_own")).join(previous, ["split", "ordinal"], "left")
    step = F.col("row_ordinal") - F.col("_row")
    places = {
        "ordinal": (F.col("ordinal") < 0) | ((F.col("ordinal") > 0) & F.col("_row").isNull()),
        "row_ordinal": F.coalesce((step != 0) & (step != 1), F.lit(False)),
        "event": F.coalesce((step == 0) & (F.col("event") <= F.col("_event")), F.lit(False)),
    }
    return held.select("split", "ordinal", F.explode(F.concat(named(places), "_own")).alias("reason"))


def read_tokens(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    bad = violations(rows, vocabulary).head(1)
    if bad:
        raise ValueError(f"prepared tokens are broken: {bad[0].asDict()}")
    return rows


def part(rows: DataFrame, split: str, start: int, stop: int) -> DataFrame:
    """Examples [start, stop) of a split; row groups outside are not read."""
    return rows.where((F.col("split") == split) & (F.col("ordinal") >= start) & (F.col("ordinal") < stop))


def stats(rows: DataFrame) -> DataFrame:
    """Per split: examples, total and supervised tokens, longest example, and a digest that depends on each ordinal's content."""
    supervised = F.size(F.filter("labels", lambda y: y != IGNORED))
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.size("input_ids")).cast("long").alias("tokens"),
        F.sum(supervised).cast("long").alias("supervised"),
        F.max(F.size("input_ids")).cast("long").alias("longest"),
        F.sum(F.xxhash64("ordinal", "input_ids", "labels").cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def ordered_digest(rows: DataFrame, key: str, ordinal: str, digest: Column, fan: int = 1024) -> DataFrame:
    """(key, digest) over rows whose ordinals run from 0 without gaps: hashes of `fan` neighbours are hashed together, level by
    level, until a key has one. The same at any partitioning, another if two rows change places; no group exceeds `fan`."""
    now = rows.select(F.col(key), F.col(ordinal).cast("long").alias("_i"), digest.alias("digest"))
    now = now.join(now.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    most = now.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("_i", "digest"))), lambda x: x["digest"])
        one = F.when(F.col("_n") == 1, F.min("digest")).otherwise(F.sha2(F.array_join(hashes, ""), 256))
        now = now.groupBy(key, F.expr(f"_i div {fan}").alias("_i"), "_n").agg(one.alias("digest")).withColumn("_n", F.ceil(F.col("_n") / fan).cast("long"))
        most = -(-most // fan)
    return now.select(key, "digest")


def packed(rows: DataFrame) -> DataFrame:
    """(split, ordinal, data): each example in the binary form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, ordinal, ids, labels = (batch.column(i) for i in range(4))
            data = [pack_example(i, [1] * len(i), y) for i, y in zip(ids.to_pylist(), labels.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([split, ordinal, pa.array(data, pa.binary())], ["split", "ordinal", "data"])

    return rows.select("split", "ordinal", "input_ids", "labels").mapInArrow(run, "split string, ordinal long, data binary")
