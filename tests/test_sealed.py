"""Sealed snapshots in shards: selections, altered rows, missing shards, foreign tasks, copies and collections."""

import gzip
import shutil

import pytest

from tracemill.sources import sealed

TASKS = "task_id long, split string, input string"
SEEN = "order long, task_id long, source string, problem string, fingerprint string, passed boolean"


def tables(spark, base=0, source="s", n=60):
    ids = range(base, base + n)
    tasks = spark.createDataFrame([(i, "train" if i % 4 else "dev", f"input {i} " + "x" * 60) for i in ids], TASKS)
    plans = spark.createDataFrame([(i, f"plan {i} " + "y" * 60) for i in ids], "task_id long, plan string")
    # every second row of a split shares its problem with the row before, every third its fingerprint with the one after
    seen = [(i, i, source, f"p{i // 8}-{i % 4 > 0}-{base}", f"f{(i + 1) // 3}-{i % 4 > 0}-{base}", i % 5 != 0) for i in ids]
    return spark.createDataFrame(seen, SEEN), tasks, plans, seen


def walk(seen):
    used_a, used_b, out = set(), set(), set()
    for i, _, _, a, b, ok in sorted(seen):
        if ok and a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add(i)
    return out


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sealed") / "one"
    seen, tasks, plans, made = tables(spark)
    sealed.seal(seen.repartition(2), tasks.repartition(2), plans, str(path), 2048)
    return path, made


@pytest.fixture
def altered(snapshot, tmp_path):
    shutil.copytree(snapshot[0], tmp_path / "copy")
    return tmp_path / "copy"


def shard(path, kind, at=0):
    return sorted((path / kind / "rows").glob("part-*.gz"))[at]


def rewrite(file, change):
    lines = gzip.decompress(file.read_bytes()).decode().split("\n")[:-1]
    file.write_bytes(gzip.compress("".join(f"{x}\n" for x in change(lines)).encode()))


def told(spark, path):
    return {(r.kind, r.path, r.row_index, r.reason) for r in sealed.faults(spark, str(path)).collect()}


def test_the_selection_is_greedy_over_two_keys(spark, snapshot):
    path, made = snapshot
    assert told(spark, path) == set()
    rows = sealed.sealed(spark, str(path)).collect()
    assert {r.order for r in rows} == walk(made) and 5 < len(rows) < sum(m[5] for m in made)
    assert len(list((path / "observations/rows").glob("*.gz"))) > 3


def test_altered_rows_are_named(spark, altered):
    file = shard(altered, "candidates", 1)
    rewrite(file, lambda lines: [*lines[:2], lines[2].replace("plan", "trick"), *lines[3:-1], lines[-1], '{"task_id":9}'])
    name = f"rows/{file.name}"
    n = len(gzip.decompress(file.read_bytes()).split(b"\n")) - 2
    found = told(spark, altered)
    assert {("candidates", name, None, "altered shard"), ("candidates", name, 2, "altered row"), ("candidates", name, n, "added row")} == {f for f in found if f[0] == "candidates"}
    assert {f[3] for f in found if f[0] == "observations"} == {"foreign candidate"} and len([f for f in found if f[0] == "observations"]) == 1
    with pytest.raises(ValueError, match="not as it was sealed"):
        sealed.sealed(spark, str(altered))


def test_a_missing_shard_and_what_hangs_on_it_is_named(spark, altered):
    file = shard(altered, "tasks")
    n = len(gzip.decompress(file.read_bytes()).split(b"\n")) - 1
    file.unlink()
    found = told(spark, altered)
    assert ("tasks", f"rows/{file.name}", None, "missing shard") in found
    assert sum(f[3] == "foreign task" for f in found) == n and not any(f[3].startswith("selected") for f in found)


def test_swapped_rows_and_a_forged_result_are_named(spark, altered):
    file = shard(altered, "tasks", 2)
    rewrite(file, lambda lines: [lines[1], lines[0], *lines[2:]])
    found = told(spark, altered)
    assert {f[2] for f in found if f[0] == "tasks" and f[3] == "altered row"} == {0, 1}
    for i in range(len(list((altered / "observations/rows").glob("part-*.gz")))):
        rewrite(shard(altered, "observations", i), lambda lines: [x.replace('"passed":false', '"passed":true') for x in lines])
    found = told(spark, altered)
    assert {"altered row", "selected now"} <= {f[3] for f in found if f[0] in ("observations", "selection")}


@pytest.mark.parametrize("why", ["twice", "no task", "no candidate", "known split", "two splits"])
def test_what_cannot_be_sealed(spark, tmp_path, why):
    seen, tasks, plans, _ = tables(spark, n=12)
    if why == "twice":
        tasks = tasks.union(tasks.limit(1))
    elif why == "no task":
        tasks = tasks.where("task_id <> 3")
    elif why == "no candidate":
        plans = plans.where("task_id <> 3")
    elif why == "known split":
        tasks = tasks.selectExpr("task_id", "if(task_id = 3, 'test', split) AS split", "input")
    else:
        seen = seen.selectExpr("order", "task_id", "source", "'p' AS problem", "fingerprint", "passed")
    with pytest.raises(ValueError, match=why):
        sealed.seal(seen, tasks, plans, f"{tmp_path}/s", 2048)


def test_copies_and_collections(spark, snapshot, tmp_path):
    path, made = snapshot
    files = sealed.copy(spark, str(path), f"{tmp_path}/copy")
    assert files.count() > 10 and told(spark, f"{tmp_path}/copy") == set() and sealed.digest(spark, f"{tmp_path}/copy") == sealed.digest(spark, str(path))
    with pytest.raises(ValueError, match="exists"):
        sealed.copy(spark, str(path), f"{tmp_path}/copy")
    more = {}
    for name, base, source in (("two", 1000, "t"), ("same", 2000, "s")):
        seen, tasks, plans, more[name] = tables(spark, base, source, 24)
        sealed.seal(seen, tasks, plans, f"{tmp_path}/{name}", 4096)
    with pytest.raises(ValueError, match="share a value.*source"):
        sealed.collect(spark, [str(path), f"{tmp_path}/same"], f"{tmp_path}/no")
    sealed.collect(spark, [str(path), f"{tmp_path}/two"], f"{tmp_path}/all")
    rows = sealed.collected(spark, f"{tmp_path}/all").collect()
    assert {r.order for r in rows} == walk(made) | walk(more["two"]) and {r.component for r in rows} == {0, 1}
    # a collection's guards hold against a further component without its rows
    assert {(r.name, r.value) for r in sealed.shared_guards(spark, [f"{tmp_path}/all", f"{tmp_path}/same"]).collect()} == {("source", "s")}
    shutil.rmtree(f"{tmp_path}/two")
    shutil.copytree(f"{tmp_path}/same", f"{tmp_path}/two")
    with pytest.raises(ValueError, match="not the one"):
        sealed.collected(spark, f"{tmp_path}/all")
