"""The attempt archive: chains over many files, late and repeated events, a micro-batch that runs again, altered links, exports."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.streaming import archive

EVENTS = "attempt_id long, sequence long, kind string, payload string"


def made():
    out = []
    for attempt in range(12):
        n = 3 + attempt % 5
        for i in range(n):
            kind = "finish" if i == n - 1 and attempt % 4 else ("step", None)[i % 2]
            out.append((attempt, i, kind, None if i == 2 else f"payload {attempt}.{i}"))
        if attempt == 5:
            out.append((attempt, n, "late", "after the end"))
    return out


def chains(events):
    heads, want = {}, {}
    for attempt, i, kind, payload in sorted(events, key=lambda e: e[:2]):
        at, head, sealed = heads.get(attempt, (0, archive.START, False))
        if not sealed:
            now = archive.link(head, at, kind, payload)
            want[attempt, i] = (head, now)
            heads[attempt] = (at + 1, now, kind == "finish")
    return want


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Events dealt at random to files, some of them twice; the second half comes after the first run has ended."""
    root = tmp_path_factory.mktemp("archive")
    rows = made()
    again = [*rows, *rows[::5]]
    random.Random(1).shuffle(again)
    parts = [again[i::6] for i in range(6)]
    files = root / "files"

    def arrive(some, name):
        for i, part in enumerate(some):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{root}/{name}{i}")
            for f in (root / f"{name}{i}").glob("part-*"):
                files.mkdir(exist_ok=True)
                f.rename(files / f"{name}{i}-{f.name}")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(str(files))
        return archive.append(spark, stream, f"{root}/home", "finish")

    arrive(parts[:3], "a")
    run()
    arrive(parts[3:], "b")
    return root, run, run()


def test_chains_are_whole_and_in_order(spark, stored):
    rows = stored[2].collect()
    assert {(r.attempt_id, r.sequence): (r.previous_sha256, r.sha256) for r in rows if r.refused is None} == chains(made())
    assert sum(r.refused is None for r in rows) == len(chains(made()))
    assert {(r.attempt_id, r.kind) for r in rows if r.refused} == {(5, "late")}
    assert archive.broken_links(stored[2]).collect() == []


def test_a_batch_that_runs_again_changes_nothing(spark, stored):
    root, run, links = stored
    want = sorted(map(repr, links.collect()))
    commits = sorted((root / "home/state/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert sorted(map(repr, run().collect())) == want and len(list((root / "home/links").glob("batch=*"))) == len(commits)
    assert sorted(map(repr, run().collect())) == want


def test_altered_links_are_named(spark, stored):
    links = archive.archived(spark, f"{stored[0]}/home")
    here = lambda a, s: (F.col("attempt_id") == a) & (F.col("sequence") == s)
    altered = links.withColumn("payload", F.when(here(1, 1), F.lit("other")).otherwise(F.col("payload"))).withColumn("previous_sha256", F.when(here(2, 2), F.lit(archive.START)).otherwise(F.col("previous_sha256"))).where(~here(3, 1))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.attempt_id, r.sequence, r.reason) for r in archive.broken_links(altered.repartition(3)).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {(1, 1, "content"), (2, 2, "predecessor"), (3, 2, "number")}


def test_exports_say_what_became_of_attempts(spark, stored):
    attempts = spark.createDataFrame([(i, i % 3, "train" if i % 2 else "dev", i != 1) for i in range(13)], "attempt_id long, task_id long, split string, success boolean")
    links = archive.archived(spark, f"{stored[0]}/home").withColumn("payload", F.when(F.col("attempt_id") == 7, F.lit("x")).otherwise(F.col("payload")))
    got = {r.attempt_id: r for r in archive.export(links, attempts, "finish").collect()}
    assert {i for i, r in got.items() if r.state == "incomplete"} == {0, 4, 8, 12} and got[12].n_events == 0 and got[7].state == "invalid"
    able = [i for i in range(12) if i % 4 and i not in (1, 7)]
    first = {min(i for i in able if (i % 3, i % 2) == (t, s)) for t in range(3) for s in range(2) if any((i % 3, i % 2) == (t, s) for i in able)}
    assert {i for i, r in got.items() if r.state == "admitted"} == first and got[1].state == "kept"
