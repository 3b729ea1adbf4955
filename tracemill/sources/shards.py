"""Bounded gzip shards of JSON lines, written by a data source of its own: commits make the inventory and the index of rows.

Each task fills shards up to a bound of bytes and rolls over when the next row would not fit. Until the job commits,
everything lies in a staging folder, by attempt; a commit publishes the shards of the tasks that succeeded, under names that
only depend on the partition, and removes what other attempts left. Beside each shard lies the key of each of its rows, in
order, so that (key, path, row_index) needs no second pass.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .records import canonical

#: Bytes of the lines of a shard, before compression, at most.
LIMIT = 16 << 20
_ROW = "path string, row_index long, line string"


def filesystem(uri: str):
    """(file system, path) of a folder that the driver and all executors see; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Shard:
    """What the inventory says of a shard; hashes are SHA-256, the logical ones over the uncompressed lines."""

    path: str
    records: int
    bytes: int
    sha256: str
    logical_bytes: int
    logical_sha256: str


@dataclass
class Written(WriterCommitMessage):
    attempt: str = ""
    shards: list[Shard] = field(default_factory=list)


class _Filling:
    """The shard that a task is filling."""

    def __init__(self, path: str):
        self.path, self.raw, self.keys, self.size, self.rows, self.hash = path, io.BytesIO(), [], 0, 0, hashlib.sha256()
        self.zip = gzip.GzipFile(filename="", mode="wb", fileobj=self.raw, mtime=0, compresslevel=6)

    def add(self, key, line: bytes) -> None:
        self.zip.write(line)
        self.hash.update(line)
        self.keys.append(key)
        self.size, self.rows = self.size + len(line), self.rows + 1

    def close(self) -> tuple[bytes, Shard]:
        self.zip.close()
        data = self.raw.getvalue()
        return data, Shard(self.path, self.rows, len(data), hashlib.sha256(data).hexdigest(), self.size, self.hash.hexdigest())


class ShardWriter(DataSourceArrowWriter):
    """Columns: key, line. Null lines are empty; a line of more than the bound is an error, which leaves nothing behind."""

    def __init__(self, uri: str, limit: int, prefix: str):
        self.uri, self.limit, self.prefix = uri, limit, prefix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = (task.partitionId(), f"{task.partitionId():05d}-{task.taskAttemptId()}") if task else (0, "00000-0")
        fs, root = filesystem(self.uri)
        home = f"{root}/_staging/{attempt}"
        done, now, kind = Written(attempt=attempt), None, pa.string()

        def close() -> None:
            data, shard = now.close()
            fs.create_dir(f"{home}/{self.prefix}", recursive=True)
            with fs.open_output_stream(f"{home}/{shard.path}", compression=None) as out:
                out.write(data)
            index = pa.table({"key": pa.array(now.keys, kind), "path": [shard.path] * shard.records, "row_index": pa.array(range(shard.records), pa.int64())})
            with fs.open_output_stream(f"{home}/{shard.path}.keys") as out:
                pq.write_table(index, out)
            done.shards.append(shard)

        for batch in iterator:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line = (text or "").encode("utf-8", "surrogatepass") + b"\n"
                if len(line) > self.limit:
                    raise ValueError(f"a line of {len(line)} bytes exceeds the shard limit {self.limit}")
                if now and now.size + len(line) > self.limit:
                    close()
                    now = None
                now = now or _Filling(f"{self.prefix}/part-{part:05d}-{len(done.shards):05d}.jsonl.gz")
                now.add(key, line)
        if now:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.uri)
        fs.create_dir(f"{root}/{self.prefix}", recursive=True)
        fs.create_dir(f"{root}/_index", recursive=True)
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: s.path)
        for m in messages:
            for s in m.shards if m else []:
                fs.move(f"{root}/_staging/{m.attempt}/{s.path}", f"{root}/{s.path}")
                fs.move(f"{root}/_staging/{m.attempt}/{s.path}.keys", f"{root}/_index/{s.path.replace('/', '-')}.parquet")
        with fs.open_output_stream(f"{root}/_manifest.json") as out:  # last: a folder without it was never committed
            out.write(json.dumps({"limit": self.limit, "shards": [vars(s) for s in shards]}).encode())
        self._sweep(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*filesystem(self.uri))

    @staticmethod
    def _sweep(fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/_staging").type != FileType.NotFound:
            fs.delete_dir(f"{root}/_staging")


class _Part(InputPartition):
    def __init__(self, shard: dict):
        self.shard = shard


class ShardReader(DataSourceReader):
    """A partition for each shard; what differs from the inventory is an error that names it, unless `checked` is off: then
    a shard gives what can be read of it."""

    def __init__(self, uri: str, checked: bool = True):
        self.uri, self.checked = uri, checked

    def partitions(self) -> list[_Part]:
        return [_Part(s) for s in manifest(self.uri)["shards"]]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        fs, root = filesystem(self.uri)
        shard = partition.shard
        why = fault(fs, root, shard) if self.checked else None
        if why:
            raise ValueError(f"{shard['path']}: {why}")
        lines, at = [], 0
        try:
            with fs.open_input_stream(f"{root}/{shard['path']}", compression="gzip") as raw:
                for line in io.BufferedReader(raw):
                    lines.append(line[:-1])
                    if len(lines) == 1000:
                        yield _batch(shard["path"], at, lines)
                        at, lines = at + len(lines), []
        except OSError:
            if self.checked:
                raise
        if lines:
            yield _batch(shard["path"], at, lines)


def _batch(path: str, at: int, lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], ["path", "row_index", "line"])


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_shards"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("checked", "true") == "true")

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options["limit"]), self.options["prefix"])


def manifest(uri: str) -> dict:
    from pyarrow.fs import FileType

    fs, root = filesystem(uri)
    if fs.get_file_info(f"{root}/_manifest.json").type == FileType.NotFound:
        raise ValueError(f"{uri} has no committed shards")
    with fs.open_input_stream(f"{root}/_manifest.json") as f:
        return json.loads(f.read())


def fault(fs, root: str, shard: dict) -> str | None:
    """How a shard differs from its inventory: missing, altered (bytes or hash) or other rows; null if it does not."""
    from pyarrow.fs import FileType

    info = fs.get_file_info(f"{root}/{shard['path']}")
    if info.type == FileType.NotFound:
        return "missing"
    if info.size != shard["bytes"]:
        return "altered"
    physical, logical, size, rows = hashlib.sha256(), hashlib.sha256(), 0, 0
    with fs.open_input_stream(f"{root}/{shard['path']}", compression=None) as f:
        while chunk := f.read(1 << 20):
            physical.update(chunk)
    if physical.hexdigest() != shard["sha256"]:
        return "altered"
    with fs.open_input_stream(f"{root}/{shard['path']}", compression="gzip") as f:
        while chunk := f.read(1 << 20):
            logical.update(chunk)
            size, rows = size + len(chunk), rows + chunk.count(b"\n")
    return None if (logical.hexdigest(), size, rows) == (shard["logical_sha256"], shard["logical_bytes"], shard["records"]) else "other rows"


def write_shards(rows: DataFrame, key: str, uri: str, limit: int = LIMIT, prefix: str = "rows") -> DataFrame:
    """Write rows as canonical JSON lines into shards of at most `limit` bytes, never over committed ones.

    Returns the index (key, path, row_index); rows stay in their partitions and in order, nothing is shuffled.
    """
    from pyarrow.fs import FileType

    if not 1024 <= limit <= LIMIT:
        raise ValueError(f"a shard's bound is 1024 to {LIMIT} bytes")
    fs, root = filesystem(uri)
    if fs.get_file_info(f"{root}/_manifest.json").type != FileType.NotFound:
        raise ValueError(f"{uri} exists")
    spark = rows.sparkSession
    spark.dataSource.register(ShardSource)
    rows.select(F.col(key).alias("key"), canonical(rows).alias("line")).write.format("jsonl_shards").option("limit", limit).option("prefix", prefix).mode("append").save(uri)
    return read_index(spark, uri, rows.schema[key].dataType.simpleString())


def read_index(spark: SparkSession, uri: str, kind: str) -> DataFrame:
    """(key, path, row_index) of committed rows."""
    return spark.read.schema(f"key {kind}, path string, row_index long").parquet(f"{uri}/_index")


def read_shards(spark: SparkSession, uri: str, checked: bool = True) -> DataFrame:
    """(path, row_index, line) of committed shards, each of which is checked before its first row is given, if `checked`."""
    spark.dataSource.register(ShardSource)
    return spark.read.format("jsonl_shards").option("checked", str(checked).lower()).load(uri)


def shard_faults(spark: SparkSession, uri: str) -> DataFrame:
    """(path, reason) of shards that are missing, altered, over the bound or not in the inventory; checked on the executors."""
    from pyarrow.fs import FileSelector

    listed = manifest(uri)
    fs, root = filesystem(uri)
    known = {s["path"] for s in listed["shards"]}
    there = [f.path[len(root) :].lstrip("/") for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.path.endswith(".jsonl.gz")]
    extra = [(p, "not in the inventory") for p in there if p not in known]
    limit = listed["limit"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = filesystem(uri)
        for batch in batches:
            found = [(s["path"], "over the bound" if s["logical_bytes"] > limit else fault(own, top, s)) for s in map(json.loads, batch.column(0).to_pylist())]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["path", "reason"])

    kind = "path string, reason string"
    shards = spark.createDataFrame([(json.dumps(s),) for s in listed["shards"]], "shard string").repartition(max(1, min(len(known), 1000)))
    return shards.mapInArrow(check, kind).union(spark.createDataFrame(extra, kind))
