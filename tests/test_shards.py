"""Shards on disk: bounds, index, retries, aborts, tampering; token shards by slices; digests of ordered rows."""

import gzip
import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.sources import shards, token_shards, tokens


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, "ä" * (i % 90), None if i % 7 else "x") for i in range(900)], "id long, text string, other string").repartition(3)


def lines_of(path):
    return {f.relative_to(path).as_posix(): gzip.decompress(f.read_bytes()) for f in path.rglob("*.gz")}


def test_shards_are_bounded_and_found_by_their_index(spark, rows, tmp_path):
    index = shards.write_shards(rows, "id", f"file://{tmp_path}/s", 2048)
    files = lines_of(tmp_path / "s")
    assert len(files) > 30 and all(len(raw) <= 2048 for raw in files.values())
    want = {r.id: json.dumps({"id": r.id, "other": r.other, "text": r.text}, ensure_ascii=False, separators=(",", ":")) for r in rows.collect()}
    back = shards.read_shards(spark, f"file://{tmp_path}/s")
    assert {r.key: r.line for r in index.join(back, ["path", "row_index"]).collect()} == want
    for r in index.collect():
        assert files[r.path].decode().split("\n")[r.row_index] == want[r.key]
    listed = {s["path"]: s for s in shards.manifest(f"{tmp_path}/s")["shards"]}
    assert listed.keys() == files.keys() and all((s["logical_bytes"], s["records"], s["logical_sha256"]) == (len(files[p]), files[p].count(b"\n"), hashlib.sha256(files[p]).hexdigest()) for p, s in listed.items())
    assert shards.shard_faults(spark, f"{tmp_path}/s").collect() == [] and not (tmp_path / "s/_staging").exists()
    with pytest.raises(ValueError, match="exists"):
        shards.write_shards(rows, "id", f"{tmp_path}/s", 2048)
    # shards roll over only where the next line does not fit
    for path, raw in files.items():
        part, n = path.rsplit("-", 1)
        follower = files.get(f"{part}-{int(n.split('.')[0]) + 1:05d}.jsonl.gz")
        assert follower is None or len(raw) + len(follower.split(b"\n")[0]) + 1 > 2048


def test_tampering_is_named(spark, rows, tmp_path):
    shards.write_shards(rows, "id", f"{tmp_path}/s", 4096)
    a, b, c = sorted(lines_of(tmp_path / "s"))[:3]
    (tmp_path / "s" / a).unlink()
    raw = bytearray((tmp_path / "s" / b).read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "s" / b).write_bytes(raw)
    (tmp_path / "s/rows/part-99999-00000.jsonl.gz").write_bytes(gzip.compress(b"{}\n"))
    manifest = json.loads((tmp_path / "s/_manifest.json").read_text())
    next(s for s in manifest["shards"] if s["path"] == c)["records"] += 1
    (tmp_path / "s/_manifest.json").write_text(json.dumps(manifest))
    want = {a: "missing", b: "altered", c: "other rows", "rows/part-99999-00000.jsonl.gz": "not in the inventory"}
    assert {r.path: r.reason for r in shards.shard_faults(spark, f"{tmp_path}/s").collect()} == want
    with pytest.raises(Exception, match="missing|altered|other rows"):
        shards.read_shards(spark, f"{tmp_path}/s").collect()


def test_a_line_over_the_bound_leaves_nothing(spark, rows, tmp_path):
    with pytest.raises(Exception, match="exceeds the shard limit"):
        shards.write_shards(rows.union(spark.createDataFrame([(1, "x" * 3000, None)], rows.schema)), "id", f"{tmp_path}/s", 2048)
    assert list((tmp_path / "s").glob("*")) == [] and pytest.raises(ValueError, shards.manifest, f"{tmp_path}/s")
    shards.write_shards(rows, "id", f"{tmp_path}/s", 2048)  # and the folder can be used
    assert shards.read_shards(spark, f"{tmp_path}/s").count() == 900
    empty = shards.write_shards(rows.limit(0), "id", f"{tmp_path}/none", 2048)
    assert shards.manifest(f"{tmp_path}/none")["shards"] == [] and shards.shard_faults(spark, f"{tmp_path}/none").collect() == []
    assert empty.count() == 0


def test_a_repeated_attempt_leaves_no_second_file(tmp_path, monkeypatch):
    writer = shards.ShardWriter(f"{tmp_path}/s", 1024, "rows")
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a" * 700, "b" * 700])], ["key", "line"])])

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 4

        def taskAttemptId(self):
            return self.attempt

    import pyspark

    done = []
    for attempt in (7, 8):
        monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda a=attempt: Task(a)))
        done.append(writer.write(batch()))
    writer.commit([done[1]])
    assert sorted(lines_of(tmp_path / "s")) == ["rows/part-00004-00000.jsonl.gz", "rows/part-00004-00001.jsonl.gz"]
    assert not (tmp_path / "s/_staging").exists() and len(list((tmp_path / "s/_index").glob("*"))) == 2


@pytest.fixture(scope="module")
def encoded(spark):
    r = random.Random(4)
    out = []
    for split, n in (("train", 400), ("dev", 37)):
        for i in range(n):
            ids = [r.randrange(1000) for _ in range(r.randrange(1, 60))]
            out.append((split, i, ids, [x if k % 2 == 0 else tokens.IGNORED for k, x in enumerate(ids)]))
    return out


@pytest.fixture
def stored(spark, encoded, tmp_path):
    df = spark.createDataFrame(encoded, "split string, ordinal long, input_ids array<int>, labels array<int>").repartition(5)
    token_shards.write_token_shards(df, f"{tmp_path}/t", 4096)
    return tmp_path / "t"


def test_slices_read_their_own_bytes(spark, encoded, stored):
    train = [x for x in encoded if x[0] == "train"]
    assert token_shards.lengths(str(stored)) == {"train": 400, "dev": 37} and token_shards.token_faults(spark, str(stored), 1000).collect() == []
    assert all(f.stat().st_size <= 4096 for f in stored.rglob("*.bin"))
    for start, stop in ((0, None), (10, 11), (95, 217), (-3, None), (300, 100), (399, 900)):
        want = train[start:stop]
        got = sorted(token_shards.examples(spark, str(stored), "train", start, stop).collect(), key=lambda r: r.ordinal)
        assert [(r.split, r.ordinal, r.input_ids, r.labels) for r in got] == want and all(r.attention_mask == [1] * len(r.input_ids) for r in got)
        shards_read = sum(r.bytes_read > 0 for r in got)
        assert sum(r.bytes_read for r in got) == sum(12 + 12 * len(x[2]) for x in want) + 8 * shards_read
    assert token_shards.examples(spark, str(stored), "none").collect() == []


def test_altered_tokens_are_named(spark, encoded, stored):
    files = sorted(stored.rglob("*.bin"))
    raw = bytearray(files[0].read_bytes())
    raw[20] ^= 1
    files[0].write_bytes(raw)
    files[3].unlink()
    (stored / "train/tokens-9.bin").write_bytes(b"")
    relative = lambda f: f.relative_to(stored).as_posix()
    want = {(relative(files[0]), "altered"), (relative(files[3]), "missing"), ("train/tokens-9.bin", "not in the manifest")}
    assert {(r.path, r.reason) for r in token_shards.token_faults(spark, str(stored), 1000).collect()} == want
    manifest = json.loads((stored / "_manifest.json").read_text())
    gone = manifest["shards"].pop(1)
    (stored / "_manifest.json").write_text(json.dumps(manifest))
    assert "a gap before it" in {r.reason for r in token_shards.token_faults(spark, str(stored), 1000).collect()} and gone["examples"] > 0


def test_a_small_vocabulary_and_long_examples(spark, stored, tmp_path):
    assert {r.reason for r in token_shards.token_faults(spark, str(stored), 10).collect()} == {"tokens out of range"}
    big = spark.createDataFrame([("train", 0, [1] * 500, [1] * 500)], "split string, ordinal long, input_ids array<int>, labels array<int>")
    with pytest.raises(Exception, match="shard limit"):
        token_shards.write_token_shards(big, f"{tmp_path}/big", 4096)


def test_digest_depends_on_order_only(spark, encoded):
    def digests(rows, parts, fan):
        df = spark.createDataFrame(rows, "split string, ordinal long, input_ids array<int>, labels array<int>").repartition(parts)
        return {r.split: r.digest for r in tokens.ordered_digest(df, "split", "ordinal", F.sha2(F.to_json("input_ids"), 256), fan).collect()}

    base = digests(encoded, 1, 8)
    assert base == digests(encoded[::-1], 7, 8) and len(base) == 2
    swapped = [*encoded]
    swapped[5], swapped[300] = (swapped[a][:2] + swapped[b][2:] for a, b in ((5, 300), (300, 5)))
    other = digests(swapped, 3, 8)
    assert other["dev"] == base["dev"] and other["train"] != base["train"]
    hashes = [hashlib.sha256(json.dumps(x[2], separators=(",", ":")).encode()).hexdigest() for x in encoded if x[0] == "dev"]
    while len(hashes) > 1:
        hashes = [hashlib.sha256("".join(hashes[i : i + 8]).encode()).hexdigest() for i in range(0, len(hashes), 8)]
    assert hashes[0] == base["dev"]


def test_written_tables_go_with_the_application(spark):
    from tracemill.sources.tables import shared_path

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x")).getParent()
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path) and fs.cancelDeleteOnExit(path)
    fs.deleteOnExit(path)
