"""Frozen datasets and sealed snapshots: written once, with a manifest that a later scan is held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import greedy_two_keys
from .records import canonical

SPLITS = ("train", "dev")


def row_digest(df: DataFrame) -> Column:
    return F.sha2(canonical(df), 256)


def manifest(rows: DataFrame, family: str = "family") -> DataFrame:
    """(split, records, families, digest): digest is a sum of row hashes, the same in any order and at any partitioning."""
    bits = F.conv(F.substring(F.col("_digest"), 1, 15), 16, 10).cast("decimal(38,0)")
    hashed = rows.withColumn("_digest", row_digest(rows))
    return hashed.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set(family)), ",").alias("families"), F.sum(bits).cast("string").alias("digest"))


def crossing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(name, value): values of any of the keys that more than one split has."""
    each = rows.select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select("split", "k.*")
    return each.where("value is not null").groupBy("name", "value").agg(F.count_distinct("split").alias("n")).where("n > 1").select("name", "value")


def _refuse(found: DataFrame, why: str) -> None:
    first = found.head(1)
    if first:
        raise ValueError(f"{why}: {first[0].asDict()}")


def freeze(rows: DataFrame, path: str, keys: list[str], contract: dict[str, Column] | None = None, apart: bool = True) -> DataFrame:
    """Write rows (split, family, ...) under their split, never over an existing path, and their manifest; returns that.

    ValueError for a row that breaks a rule of the contract (a null condition counts as broken), for another split than
    train and dev, a key's value in both splits, and no rows at all. With `apart` off, values that both splits have are
    written beside the rows instead.
    """
    rules = {"split": F.col("split").isin(*SPLITS)} | (contract or {})
    for why, holds in rules.items():
        _refuse(rows.where(~F.coalesce(holds, F.lit(False))), f"rows break the rule {why!r}")
    if apart:
        _refuse(crossing(rows, keys), "a value is in more than one split")
    if rows.isEmpty():
        raise ValueError("there are no rows to freeze")
    rows.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/rows")
    manifest(rows).write.mode("errorifexists").parquet(f"{path}/manifest")
    if not apart:
        crossing(rows, keys).write.mode("errorifexists").parquet(f"{path}/shared")
    return rows.sparkSession.read.parquet(f"{path}/manifest")


def frozen(spark: SparkSession, path: str, keys: list[str], apart: bool = True) -> DataFrame:
    """The rows of a frozen dataset, after its counts, families and digests and the splits' disjointness were made anew; with
    `apart` off, after the values that both splits have were held against those stated."""
    columns = spark.read.parquet(f"{path}/rows")
    then = spark.read.parquet(f"{path}/manifest")
    now = manifest(columns)
    _refuse(now.exceptAll(then).withColumn("side", F.lit("found")).union(then.exceptAll(now).withColumn("side", F.lit("stated"))), "the rows are not those that were frozen")
    if apart:
        _refuse(crossing(columns, keys), "a value is in more than one split")
    else:
        both, stated = crossing(columns, keys), spark.read.parquet(f"{path}/shared")
        _refuse(both.exceptAll(stated).union(stated.exceptAll(both)), "the splits do not share what was stated")
    return columns


def select(observations: DataFrame, apart: bool = True) -> DataFrame:
    """The observations to keep: successes in order, each for a problem and a fingerprint that no kept one has.

    observations (order, problem, fingerprint, passed, split, ...). ValueError if kept rows of two splits would have
    collided: a problem or fingerprint that was kept in one split must not succeed in another. With `apart` off, the first
    success keeps it from both.
    """
    passed = observations.where("passed")
    kept = greedy_two_keys(passed, "order", "problem", "fingerprint")
    for key in ("problem", "fingerprint") if apart else ():
        held = kept.select(key, F.col("split").alias("_kept_split"), F.col("order").alias("_kept_order"))
        _refuse(passed.join(held, key).where("split <> _kept_split and order > _kept_order").select(key, "split"), f"a {key} succeeds in two splits")
    return kept


def seal(observations: DataFrame, tasks: DataFrame, path: str, apart: bool = True) -> DataFrame:
    """Write observations, the tasks they are of and the selection, never over an existing path; returns the selection.

    Every observation (task_id, task_sha256, ...) has exactly one task (task_id, task_sha256) with the same hash; `apart` as
    for `select`.
    """
    _refuse(tasks.groupBy("task_id").count().where("count > 1"), "a task is there twice")
    held = observations.join(tasks.select("task_id", F.col("task_sha256").alias("_task_sha256")), "task_id", "left")
    _refuse(held.where("_task_sha256 is null").select("task_id"), "an observation has no task")
    _refuse(held.where("_task_sha256 <> task_sha256").select("task_id"), "an observation is of another task")
    observations.write.mode("errorifexists").parquet(f"{path}/observations")
    tasks.write.mode("errorifexists").parquet(f"{path}/tasks")
    stored = observations.sparkSession.read.parquet(f"{path}/observations")
    chosen = select(stored, apart)
    chosen.select("order", row_digest(stored).alias("row_sha256")).write.mode("errorifexists").parquet(f"{path}/selection")
    return chosen


def sealed(spark: SparkSession, path: str, apart: bool = True) -> DataFrame:
    """The selected observations of a snapshot, after the selection was made anew and held against the stored one, both ways."""
    stored, tasks = spark.read.parquet(f"{path}/observations"), spark.read.parquet(f"{path}/tasks")
    _refuse(stored.select("task_id", "task_sha256").exceptAll(stored.join(tasks, ["task_id", "task_sha256"]).select("task_id", "task_sha256")), "an observation has no task of its hash")
    chosen = select(stored, apart)
    now, then = chosen.select("order", row_digest(stored).alias("row_sha256")), spark.read.parquet(f"{path}/selection")
    _refuse(now.exceptAll(then).union(then.exceptAll(now)), "the selection is not the stored one")
    return chosen


def combine(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    """Seal the union of verified snapshots' observations and tasks, selected anew; ValueError if a source is in two of them."""
    for path in paths:
        sealed(spark, path)
    parts = [spark.read.parquet(f"{p}/observations").withColumn("_component", F.lit(i)) for i, p in enumerate(paths)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    _refuse(union.groupBy("source").agg(F.count_distinct("_component").alias("n")).where("n > 1"), "a source is in two components")
    tasks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{p}/tasks") for p in paths]).dropDuplicates()
    return seal(union.drop("_component"), tasks, target)
