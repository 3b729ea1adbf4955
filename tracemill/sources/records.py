"""Strict scans of JSON lines, and sinks whose files are listed in an inventory that a later scan is held against."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parsed_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, row, reason): every line of the files with its parsed row; reason is null for a good line.

    A blank line, a line that is no JSON object and a field that does not fit the schema are violations. Files end their
    last line with or without a newline. Other keys of an object are ignored.
    """
    checked = StructType([*schema.fields]).add("_corrupt", "string")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    row = F.from_json("line", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    reason = F.when(F.trim("line") == "", "blank line").when(~F.trim("line").startswith("{"), "not an object").when(F.col("row._corrupt").isNotNull(), "malformed")
    return lines.withColumn("row", row).select("file", "line", F.struct(*[F.col("row")[n].alias(n) for n in schema.names]).alias("row"), reason.alias("reason"))


def read_strict(spark: SparkSession, path: str, schema: StructType, contract: dict[str, Column] | None = None) -> DataFrame:
    """The rows of JSON-lines files; ValueError names a file and line that break the syntax or the contract, or empty input.

    contract maps a reason to a condition over the schema's columns that every row must meet; a null condition is not met.
    """
    lines = parsed_lines(spark, path, schema)
    rows = lines.select("file", "line", "reason", "row.*")
    reason = F.col("reason")
    for why, holds in (contract or {}).items():
        reason = F.coalesce(reason, F.when(~F.coalesce(holds, F.lit(False)), F.lit(why)))
    rows = rows.withColumn("reason", reason)
    bad = rows.agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("bad"), F.min(F.when(F.col("reason").isNotNull(), F.struct("file", "line", "reason"))).alias("first")).first()
    if bad.n == 0:
        raise ValueError(f"{path} has no rows")
    if bad.bad:
        raise ValueError(f"{bad.bad} lines of {bad.n} are bad; {bad['first'].reason} in {bad['first'].file}: {bad['first'].line[:200]}")
    return rows.select(*schema.names)


def canonical(df: DataFrame) -> Column:
    """A row as JSON with its columns in name order and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write canonical JSON lines under key folders, never over an existing path; returns the inventory of what was written."""
    body = [c for c in df.columns if c not in keys]
    df.select(*keys, canonical(df.select(*body)).alias("value")).write.mode("errorifexists").partitionBy(*keys).text(f"{path}/rows")
    inventory(df.sparkSession, f"{path}/rows").write.mode("errorifexists").parquet(f"{path}/inventory")
    return df.sparkSession.read.parquet(f"{path}/inventory")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below path; names are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "/rows/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) for what is missing, new or altered since `write_partitioned`; no rows if all is as written."""
    now, then = inventory(spark, f"{path}/rows").alias("now"), spark.read.parquet(f"{path}/inventory").alias("then")
    both = then.join(now, "file", "full_outer")
    reason = F.when(F.col("now.sha256").isNull(), "missing").when(F.col("then.sha256").isNull(), "new").when((F.col("now.sha256") != F.col("then.sha256")) | (F.col("now.bytes") != F.col("then.bytes")), "altered")
    return both.select("file", reason.alias("reason")).where("reason is not null")


def bounded_shards(lines: DataFrame, limit: int) -> DataFrame:
    """(part, shard, row_index, line): lines dealt to shards of at most `limit` UTF-8 bytes, newlines included.

    Each partition fills its own shards in its own order and rolls over when the next line would not fit, so that nothing
    is shuffled. ValueError if one line exceeds the limit. The first column of `lines` is the line; null counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, index, filled = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            shards, indices, lines = [], [], [line or "" for line in batch.column(0).to_pylist()]
            for line in lines:
                size = len(line.encode("utf-8", "surrogatepass")) + 1
                if size > limit:
                    raise ValueError(f"a line of {size} bytes exceeds the shard limit {limit}")
                if filled + size > limit:
                    shard, index, filled = shard + 1, 0, 0
                shards.append(shard)
                indices.append(index)
                index, filled = index + 1, filled + size
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(lines), pa.int32()), pa.array(shards, pa.int32()), pa.array(indices, pa.int64()), pa.array(lines, pa.string())], ["part", "shard", "row_index", "line"])

    return lines.select(lines.columns[0]).mapInArrow(run, "part int, shard int, row_index long, line string")
