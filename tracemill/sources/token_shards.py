"""Binary shards of encoded examples, for each split, with random access: a slice reads the bytes of its own examples only.

A shard is MAGIC, then for each example its length as an unsigned and three runs (ids, mask, labels) of signed little-endian
32-bit numbers. Its offsets, unsigned 64-bit, lie beside it. The manifest has the place, the counts and the hashes of each
shard, and no entry for an example: reading a slice plans one partition for each shard that it touches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shards import ShardWriter, filesystem, manifest
from .tokens import IGNORED

MAGIC = b"TOKSHRD1"
LIMIT = 16 << 20
#: Adjacent examples that are read in one request, in bytes, about.
READ = 4 << 20


@dataclass
class TokenShard:
    path: str
    split: str
    first: int
    examples: int
    tokens: int
    supervised: int
    longest: int
    bytes: int
    sha256: str
    offsets_sha256: str


@dataclass
class Written(WriterCommitMessage):
    attempt: str = ""
    shards: list[TokenShard] = field(default_factory=list)


class TokenWriter(DataSourceArrowWriter):
    """Columns: split, ordinal, input_ids, labels, sorted by split and ordinal in each partition."""

    def __init__(self, uri: str, limit: int):
        self.uri, self.limit = uri, limit

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        attempt = f"{task.partitionId():05d}-{task.taskAttemptId()}" if task else "00000-0"
        fs, root = filesystem(self.uri)
        home, done = f"{root}/_staging/{attempt}", Written(attempt=attempt)
        now: dict | None = None

        def close() -> None:
            data, offsets = b"".join(now["parts"]), np.array(now["offsets"], "<u8").tobytes()
            path = f"{now['split']}/tokens-{now['first']:012d}.bin"
            fs.create_dir(f"{home}/{now['split']}", recursive=True)
            for name, raw in ((path, data), (f"{path}.offsets", offsets)):
                with fs.open_output_stream(f"{home}/{name}", compression=None) as out:
                    out.write(raw)
            hashes = (hashlib.sha256(x).hexdigest() for x in (data, offsets))
            done.shards.append(TokenShard(path, now["split"], now["first"], len(now["offsets"]) - 1, now["tokens"], now["supervised"], now["longest"], len(data), *hashes))

        for batch in iterator:
            for split, ordinal, ids, labels in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(ids) != len(labels):
                    raise ValueError(f"example {ordinal} of {split} has {len(ids)} ids and {len(labels)} labels")
                n = len(ids)
                size = 4 + 12 * n
                if size + len(MAGIC) > self.limit:
                    raise ValueError(f"example {ordinal} of {split} has {size} bytes; the shard limit is {self.limit}")
                if now and (now["split"] != split or now["offsets"][-1] + size > self.limit or now["first"] + len(now["offsets"]) - 1 != ordinal):
                    close()
                    now = None
                now = now or {"split": split, "first": ordinal, "parts": [MAGIC], "offsets": [len(MAGIC)], "tokens": 0, "supervised": 0, "longest": 0}
                runs = np.empty((3, n), "<i4")
                runs[0], runs[1], runs[2] = ids, 1, labels
                now["parts"].append(np.uint32(n).astype("<u4").tobytes() + runs.tobytes())
                now["offsets"].append(now["offsets"][-1] + size)
                now["tokens"] += n
                now["supervised"] += int((runs[2] != IGNORED).sum())
                now["longest"] = max(now["longest"], n)
        if now:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.uri)
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s.split, s.first))
        for split in {s.split for s in shards}:
            fs.create_dir(f"{root}/{split}", recursive=True)
        for m in messages:
            for s in m.shards if m else []:
                for name in (s.path, f"{s.path}.offsets"):
                    fs.move(f"{root}/_staging/{m.attempt}/{name}", f"{root}/{name}")
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps({"limit": self.limit, "shards": [vars(s) for s in shards]}).encode())
        ShardWriter._sweep(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        ShardWriter._sweep(*filesystem(self.uri))


class _Slice(InputPartition):
    def __init__(self, shard: dict, start: int, stop: int):
        self.shard, self.start, self.stop = shard, start, stop


def read_slice(fs, root: str, shard: dict, start: int, stop: int) -> Iterator[tuple[list[tuple[int, np.ndarray]], int]]:
    """Examples [start, stop) of a shard, counted from its first, in stretches of about READ bytes: ([(place, runs)], bytes read).

    ValueError names a shard whose lengths and offsets do not fit."""
    with fs.open_input_file(f"{root}/{shard['path']}.offsets") as f:
        f.seek(8 * start)
        offsets = np.frombuffer(f.read(8 * (stop - start + 1)), "<u8").astype(np.int64)
    if len(offsets) != stop - start + 1:
        raise ValueError(f"{shard['path']}: offsets are missing")
    read = 8 * len(offsets)
    with fs.open_input_file(f"{root}/{shard['path']}") as f:
        at = 0
        while at < stop - start:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ, "right")) - 1)
            end = min(end, stop - start)
            f.seek(int(offsets[at]))
            raw = f.read(int(offsets[end] - offsets[at]))
            out = []
            for i in range(at, end):
                lo, hi = (int(offsets[j] - offsets[at]) for j in (i, i + 1))
                n = int.from_bytes(raw[lo : lo + 4], "little") if len(raw) >= lo + 4 else -1
                if hi - lo != 4 + 12 * n or hi > len(raw):
                    raise ValueError(f"{shard['path']}: example {start + i} does not fit its offsets")
                out.append((start + i, np.frombuffer(raw, "<i4", 3 * n, lo + 4).reshape(3, n)))
            yield out, read + len(raw)
            read, at = 0, end


class TokenReader(DataSourceReader):
    def __init__(self, uri: str, split: str, start: int, stop: int):
        self.uri, self.split, self.start, self.stop = uri, split, start, stop

    def partitions(self) -> list[_Slice]:
        out = []
        for s in manifest(self.uri)["shards"]:
            lo, hi = max(self.start - s["first"], 0), min(self.stop - s["first"], s["examples"])
            if s["split"] == self.split and lo < hi:
                out.append(_Slice(s, lo, hi))
        return out

    def read(self, partition: _Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        fs, root = filesystem(self.uri)
        shard = partition.shard
        for examples, read in read_slice(fs, root, shard, partition.start, partition.stop):
            k, kind = len(examples), pa.list_(pa.int32())
            runs = [pa.array([x[i] for _, x in examples], kind) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([shard["split"]] * k, pa.string()), pa.array([shard["first"] + i for i, _ in examples], pa.int64()), *runs, pa.array([read] + [0] * (k - 1), pa.int64())], ["split", "ordinal", "input_ids", "attention_mask", "labels", "bytes_read"])


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "split string, ordinal long, input_ids array<int>, attention_mask array<int>, labels array<int>, bytes_read long"

    def reader(self, schema) -> TokenReader:
        o = self.options
        return TokenReader(o["path"], o["split"], int(o["start"]), int(o["stop"]))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options["limit"]))


def write_token_shards(rows: DataFrame, uri: str, limit: int = LIMIT) -> dict:
    """Write numbered examples (split, ordinal, input_ids, labels), ordinals gapless within a split, never over committed shards.

    Ranges of (split, ordinal) are tasks: a shard holds neighbours, and no task sees a whole split. Returns the manifest.
    """
    from pyarrow.fs import FileType

    fs, root = filesystem(uri)
    if fs.get_file_info(f"{root}/_manifest.json").type != FileType.NotFound:
        raise ValueError(f"{uri} exists")
    rows.sparkSession.dataSource.register(TokenSource)
    rows = rows.select("split", F.col("ordinal").cast("long").alias("ordinal"), F.col("input_ids").cast("array<int>").alias("input_ids"), F.col("labels").cast("array<int>").alias("labels"))
    dealt = rows.repartitionByRange("split", "ordinal").sortWithinPartitions("split", "ordinal")
    dealt.write.format("token_shards").option("limit", limit).mode("append").save(uri)
    return manifest(uri)


def lengths(uri: str) -> dict[str, int]:
    """Examples of each split."""
    out: dict[str, int] = {}
    for s in manifest(uri)["shards"]:
        out[s["split"]] = out.get(s["split"], 0) + s["examples"]
    return out


def examples(spark: SparkSession, uri: str, split: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Examples [start, stop) of a split as rows; negative ends count from the last, as slices do. `bytes_read` is told once
    for each request."""
    n = lengths(uri).get(split, 0)
    start, stop, _ = slice(start, stop).indices(n)
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_shards").option("split", split).option("start", start).option("stop", stop).load(uri)


def token_faults(spark: SparkSession, uri: str, vocabulary: int) -> DataFrame:
    """(path, reason) of what does not fit the manifest: missing, unlisted and altered files, gaps between shards, counts that
    differ, and ids, masks or labels out of range. Shards are checked on the executors, one at a time."""
    from pyarrow.fs import FileSelector, FileType

    listed = manifest(uri)
    fs, root = filesystem(uri)
    known = {n for s in listed["shards"] for n in (s["path"], f"{s['path']}.offsets")} | {"_manifest.json"}
    there = {f.path[len(root) :].lstrip("/") for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File}
    found = [(p, "not in the manifest") for p in sorted(there - known) if not p.endswith(".crc")]
    after: dict[str, int] = {}
    for s in listed["shards"]:
        if s["first"] != after.get(s["split"], 0):
            found.append((s["path"], "a gap before it"))
        after[s["split"]] = s["first"] + s["examples"]

    def one(own, top: str, s: dict) -> str | None:
        for name, want in ((s["path"], s["sha256"]), (f"{s['path']}.offsets", s["offsets_sha256"])):
            if own.get_file_info(f"{top}/{name}").type == FileType.NotFound:
                return "missing"
            with own.open_input_stream(f"{top}/{name}", compression=None) as f:
                h = hashlib.sha256()
                while chunk := f.read(1 << 20):
                    h.update(chunk)
            if h.hexdigest() != want:
                return "altered"
        counts = [0, 0, 0]
        for group, _ in read_slice(own, top, s, 0, s["examples"]):
            for _, (ids, mask, labels) in group:
                supervised = labels != IGNORED
                if ((ids < 0) | (ids >= vocabulary)).any() or (mask != 1).any() or (labels[supervised] != ids[supervised]).any() or not supervised.any():
                    return "tokens out of range"
                counts = [counts[0] + len(ids), counts[1] + int(supervised.sum()), max(counts[2], len(ids))]
        return None if counts == [s["tokens"], s["supervised"], s["longest"]] else "counts"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = filesystem(uri)
        for batch in batches:
            told = [(s["path"], why) for s in map(json.loads, batch.column(0).to_pylist()) if (why := one(own, top, s))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in told], pa.string()) for i in (0, 1)], ["path", "reason"])

    kind = "path string, reason string"
    shards = spark.createDataFrame([(json.dumps(s),) for s in listed["shards"]], "shard string").repartition(max(1, min(len(listed["shards"]), 1000)))
    return shards.mapInArrow(check, kind).union(spark.createDataFrame(found, kind))
