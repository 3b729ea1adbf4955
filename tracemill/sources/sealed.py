"""Sealed snapshots in shards: tasks, candidates and observations with their places, a selection, and digests on two levels.

Each row has a digest, each shard one over its rows' digests in order. Verification compares shards first, and rows only of
shards that differ, so that it names what was changed. A snapshot also stores the values of its guard keys, sorted and
distinct: collections of snapshots are held against each other by these tables and never read their components' rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shards import LIMIT, filesystem, manifest, read_shards, write_shards
from .snapshots import SPLITS, _refuse, select
from .tokens import ordered_digest

KINDS = {"tasks": "task_id", "candidates": "task_id", "observations": "order"}
GUARDS = ("source", "problem", "fingerprint")
_CHOSEN = "path string, row_index long, sha256 string, order long, task_id long, split string"
_FAULT = "kind string, path string, row_index long, reason string"


def _digests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, row_index, sha256) of a kind's rows as they are now."""
    return read_shards(spark, f"{path}/{kind}", checked=False).select("path", "row_index", F.sha2("line", 256).alias("sha256"))


def _shard_digests(rows: DataFrame) -> DataFrame:
    return ordered_digest(rows, "path", "row_index", F.col("sha256"))


def _stated(path: str) -> dict:
    """What a snapshot says of itself: the schema of each kind, and whether its splits are apart."""
    fs, root = filesystem(f"{path}/schemas.json")
    with fs.open_input_stream(root) as f:
        return json.loads(f.read())


def rows_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, row_index, sha256, ...) of a kind: its rows with their places and digests."""
    schema = StructType.fromJson(_stated(path)[kind])
    lines = read_shards(spark, f"{path}/{kind}", checked=False)
    return lines.select("path", "row_index", F.sha2("line", 256).alias("sha256"), F.from_json("line", schema).alias("r")).select("path", "row_index", "sha256", "r.*")


def seal(observations: DataFrame, tasks: DataFrame, candidates: DataFrame, path: str, shard_bytes: int = LIMIT, apart: bool = True) -> DataFrame:
    """Write a snapshot, never over an existing one; returns its selection (split, path, row_index, sha256, order, task_id).

    tasks (task_id, split, ...), candidates (task_id, ...), observations (order, task_id, source, problem, fingerprint,
    passed, ...). ValueError for a task or candidate that is there twice, an observation without either, another split than
    train and dev, values of `problem` or `fingerprint` that succeed in both, and a split without a selected row.
    With `apart` off, which the snapshot notes, the last two are no errors: the first success keeps a value from both splits.
    """
    spark = observations.sparkSession
    for name, rows in (("task", tasks), ("candidate", candidates)):
        _refuse(rows.groupBy("task_id").count().where("count > 1").select("task_id"), f"a {name} is there twice")
        _refuse(observations.join(rows.select("task_id"), "task_id", "left_anti").select("task_id"), f"an observation has no {name}")
    _refuse(tasks.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select("task_id", "split"), "a task is of no known split")
    places = {}
    for kind, rows in (("tasks", tasks), ("candidates", candidates)):
        index = write_shards(rows, "task_id", f"{path}/{kind}", shard_bytes)
        held = index.join(_digests(spark, path, kind), ["path", "row_index"])
        places[kind] = held.select(F.col("key").alias("task_id"), F.col("path").alias(f"{kind}_path"), F.col("row_index").alias(f"{kind}_row"), F.col("sha256").alias(f"{kind}_sha256"))
    evidence = observations.drop("split").join(tasks.select("task_id", "split"), "task_id").join(places["tasks"], "task_id").join(places["candidates"], "task_id")
    write_shards(evidence, "order", f"{path}/observations", shard_bytes)
    schemas = {"tasks": tasks.schema.jsonValue(), "candidates": candidates.schema.jsonValue(), "observations": evidence.schema.jsonValue(), "apart": apart}
    fs, root = filesystem(path)
    with fs.open_output_stream(f"{root}/schemas.json") as out:
        out.write(json.dumps(schemas).encode())
    for kind in KINDS:
        rows = _digests(spark, path, kind)
        rows.write.mode("errorifexists").parquet(f"{path}/digests/{kind}/rows")
        _shard_digests(spark.read.parquet(f"{path}/digests/{kind}/rows")).write.mode("errorifexists").parquet(f"{path}/digests/{kind}/shards")
    seen = rows_of(spark, path, "observations")
    chosen = _selected(seen, apart)
    chosen.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/selection")
    chosen = selection(spark, path)
    have = {r["split"] for r in chosen.select("split").distinct().collect()}
    if apart and have != set(SPLITS):
        raise ValueError(f"a snapshot needs selected rows of {' and '.join(SPLITS)}; it has {sorted(have)}")
    guards = seen.select("split", F.explode(F.array(*[F.struct(F.lit(g).alias("name"), F.col(g).cast("string").alias("value")) for g in GUARDS])).alias("k")).select("split", "k.*").distinct()
    guards.sort("name", "value").write.mode("errorifexists").parquet(f"{path}/guards")
    return chosen


def _selected(seen: DataFrame, apart: bool) -> DataFrame:
    chosen = select(seen.select("order", "task_id", "problem", "fingerprint", "passed", "split", "path", "row_index", "sha256"), apart)
    return chosen.select("path", "row_index", "sha256", "order", "task_id", "split")


def selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHOSEN).parquet(f"{path}/selection").select("split", "path", "row_index", "sha256", "order", "task_id")


def digest(spark: SparkSession, path: str) -> str:
    """One digest of a snapshot, from the stored ones of its shards."""
    import hashlib

    shards = sorted((kind, r["path"], r["digest"]) for kind in KINDS for r in spark.read.parquet(f"{path}/digests/{kind}/shards").collect())  # as many as the inventories list
    return hashlib.sha256("\n".join("|".join(s) for s in shards).encode()).hexdigest()


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(kind, path, row_index, reason) of all that is not as it was sealed; no rows if nothing is.

    A shard that is missing or differs is named, and each of its rows that was altered, added or is missing; an observation
    whose task or candidate is not the row that it refers to; and rows that the selection made anew has more or less.
    """
    from pyarrow.fs import FileType

    found = []
    for kind in KINDS:
        fs, root = filesystem(f"{path}/{kind}")
        listed = [s["path"] for s in manifest(f"{path}/{kind}")["shards"]]
        gone = [(kind, name, None, "missing shard") for name in listed if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound]
        found.append(spark.createDataFrame(gone, _FAULT))
        now, then = _digests(spark, path, kind), spark.read.parquet(f"{path}/digests/{kind}/shards")
        differ = then.alias("t").join(_shard_digests(now).alias("n"), "path", "left").where("n.digest is null or n.digest <> t.digest").select("path").join(spark.createDataFrame([(g[1],) for g in gone], "path string"), "path", "left_anti")
        found.append(differ.select(F.lit(kind), "path", F.lit(None).cast("long"), F.lit("altered shard")))
        rows = spark.read.parquet(f"{path}/digests/{kind}/rows").join(differ, "path", "left_semi").withColumnRenamed("sha256", "then")
        both = rows.join(now.join(differ, "path", "left_semi").withColumnRenamed("sha256", "now"), ["path", "row_index"], "full_outer")
        why = F.when(F.col("now").isNull(), "missing row").when(F.col("then").isNull(), "added row").when(F.col("now") != F.col("then"), "altered row")
        found.append(both.select(F.lit(kind), "path", "row_index", why.alias("reason")).where("reason is not null"))
    observed = rows_of(spark, path, "observations")
    for kind in ("tasks", "candidates"):
        held = observed.join(_digests(spark, path, kind).select(F.col("path").alias(f"{kind}_path"), F.col("row_index").alias(f"{kind}_row"), F.col("sha256").alias("_now")), [f"{kind}_path", f"{kind}_row"], "left")
        other = held.where(f"_now is null or _now <> {kind}_sha256")
        found.append(other.select(F.lit("observations"), "path", "row_index", F.lit(f"foreign {kind[:-1]}")))
    stored, again = selection(spark, path), _selected(observed, _stated(path).get("apart", True)).select("split", "path", "row_index", "sha256", "order", "task_id")
    for rows, why in ((stored.exceptAll(again), "selected before"), (again.exceptAll(stored), "selected now")):
        found.append(rows.select(F.lit("selection"), "path", "row_index", F.lit(why)))
    return reduce(DataFrame.union, [f.toDF("kind", "path", "row_index", "reason") for f in found])


def sealed(spark: SparkSession, path: str) -> DataFrame:
    """The selected observations of a snapshot without faults: rows with their places, joined by them."""
    _refuse(faults(spark, path), "the snapshot is not as it was sealed")
    chosen = selection(spark, path).select("path", "row_index", F.col("sha256").alias("_sha256"))
    rows = rows_of(spark, path, "observations").join(chosen, ["path", "row_index"])
    return rows.where("sha256 = _sha256").drop("_sha256")


def copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(file, bytes, sha256) of a byte copy, never over an existing folder: the executors copy and read back file by file."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = filesystem(source)
    out, top = filesystem(target)
    if out.get_file_info(top).type != FileType.NotFound:
        raise ValueError(f"{target} exists")
    names = [f.path[len(root) :].lstrip("/") for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and not f.path.endswith(".crc")]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        (a, base), (b, home) = filesystem(source), filesystem(target)

        def hashed(where, file: str, to=None) -> tuple[int, str]:
            h, n = hashlib.sha256(), 0
            with where.open_input_stream(file, compression=None) as f:
                while chunk := f.read(1 << 20):
                    h.update(chunk)
                    n += len(chunk)
                    if to:
                        to.write(chunk)
            return n, h.hexdigest()

        for batch in batches:
            done = []
            for name in batch.column(0).to_pylist():
                b.create_dir(f"{home}/{name}".rpartition("/")[0], recursive=True)
                with b.open_output_stream(f"{home}/{name}", compression=None) as to:
                    want = hashed(a, f"{base}/{name}", to)
                if hashed(b, f"{home}/{name}") != want:
                    raise ValueError(f"{name} was not copied as it is")
                done.append((name, *want))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["file", "bytes", "sha256"])

    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), 1000)))
    done = listed.mapInArrow(carry, "file string, bytes long, sha256 string").collect()  # one row for each file
    return spark.createDataFrame(done, "file string, bytes long, sha256 string")


def shared_guards(spark: SparkSession, paths: list[str], within: bool = True, missing: bool = False) -> DataFrame:
    """(name, value) of guard keys that more than one snapshot has, or, if `within`, two splits; from the stored tables alone.

    A missing value is shared with no other, unless `missing` counts it as a value.
    """
    each = [spark.read.parquet(f"{p}/guards").withColumn("component", F.lit(i)) for i, p in enumerate(paths)]
    union = reduce(DataFrame.union, each)
    if not missing:
        union = union.where("value is not null")
    crossing = "n > 1 or (splits > 1 and name <> 'source')" if within else "n > 1"
    return union.groupBy("name", "value").agg(F.count_distinct("component").alias("n"), F.count_distinct("split").alias("splits")).where(crossing).select("name", "value")


def collect(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    """(component, path, digest) of a collection: snapshots that share no guard value, by their digests.

    Nothing is read but the components' guard tables and stored digests; `faults` of a component tells whether they still
    hold. ValueError names a shared value.
    """
    _refuse(shared_guards(spark, paths), "two components share a value")
    rows = spark.createDataFrame([(i, p, digest(spark, p)) for i, p in enumerate(paths)], "component int, path string, digest string")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{target}/components")
    guards = reduce(DataFrame.union, [spark.read.parquet(f"{p}/guards") for p in paths])
    guards.sort("name", "value").write.mode("errorifexists").parquet(f"{target}/guards")  # a collection is a component again
    return spark.read.parquet(f"{target}/components")


def collected(spark: SparkSession, target: str) -> DataFrame:
    """The selected observations of all components, each of which has the digest that the collection states."""
    out = []
    for r in spark.read.parquet(f"{target}/components").sort("component").collect():  # one row for each component
        if digest(spark, r["path"]) != r["digest"]:
            raise ValueError(f"component {r['path']} is not the one that was collected")
        out.append(sealed(spark, r["path"]).withColumn("component", F.lit(r["component"])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
