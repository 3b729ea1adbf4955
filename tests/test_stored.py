"""Frozen and sealed tables that were tampered with, prepared tokens out of order, CSV of varying shape, replayed contexts."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import memory
from tracemill.sources import measures, snapshots, tokens

ROWS = [(1, "a", "train", "x1"), (2, "a", "train", "x2"), (3, "b", "dev", "x3")]
KEYS = ["id", "family", "input"]


def _rows(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, family string, split string, input string")


def test_frozen_rows_come_back(spark, tmp_path):
    stated = {r.split: (r.records, r.families) for r in snapshots.freeze(_rows(spark), f"{tmp_path}/f", KEYS).collect()}
    assert stated == {"train": (2, "a"), "dev": (1, "b")}
    assert sorted(r.id for r in snapshots.frozen(spark, f"{tmp_path}/f", KEYS).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="exist"):
        snapshots.freeze(_rows(spark), f"{tmp_path}/f", KEYS)


@pytest.mark.parametrize(("rows", "why"), [([], "no rows"), ([*ROWS, (4, "b", "train", "x4")], "more than one split"), ([*ROWS, (5, "c", "test", "x5")], "split"), ([*ROWS, (6, "a", "train", None)], "input"), ([*ROWS, (7, "c", "dev", "x1")], "more than one split")])
def test_rows_that_cannot_be_frozen(spark, tmp_path, rows, why):
    with pytest.raises(ValueError, match=why):
        snapshots.freeze(_rows(spark, rows), f"{tmp_path}/f", KEYS, {"input": F.col("input").startswith("x")})


def test_changed_rows_are_noticed(spark, tmp_path):
    snapshots.freeze(_rows(spark), f"{tmp_path}/f", KEYS)
    _rows(spark, [(9, "a", "train", "x9")]).drop("split").write.mode("append").parquet(f"{tmp_path}/f/rows/split=train")
    with pytest.raises(ValueError, match="not those"):
        snapshots.frozen(spark, f"{tmp_path}/f", KEYS)


SEEN = "order long, task_id long, task_sha256 string, split string, source string, problem string, fingerprint string, passed boolean"


def _seen(spark, rows):
    return spark.createDataFrame([(i, i, f"h{i}", s, src, p, f, ok) for i, s, src, p, f, ok in rows], SEEN)


GOOD = [(1, "train", "s", "a", "x", True), (2, "train", "s", "b", "x", True), (3, "train", "s", "b", "y", True), (4, "dev", "s", "c", "z", False)]


def _tasks(spark, ids):
    return spark.createDataFrame([(i, f"h{i}") for i in ids], "task_id long, task_sha256 string")


def test_sealed_selection_is_greedy_and_verified(spark, tmp_path):
    kept = snapshots.seal(_seen(spark, GOOD), _tasks(spark, range(1, 6)), f"{tmp_path}/s")
    assert sorted(r.order for r in kept.collect()) == [1, 3]
    assert sorted(r.order for r in snapshots.sealed(spark, f"{tmp_path}/s").collect()) == [1, 3]
    spark.createDataFrame([(8, "0" * 64)], "order long, row_sha256 string").write.mode("append").parquet(f"{tmp_path}/s/selection")
    with pytest.raises(ValueError, match="selection"):
        snapshots.sealed(spark, f"{tmp_path}/s")


@pytest.mark.parametrize(("rows", "tasks", "why"), [(GOOD, range(1, 4), "no task"), (GOOD, [1, 1, 2, 3, 4], "twice"), ([*GOOD, (5, "dev", "s", "a", "q", True)], range(1, 6), "two splits")])
def test_observations_that_cannot_be_sealed(spark, tmp_path, rows, tasks, why):
    with pytest.raises(ValueError, match=why):
        snapshots.seal(_seen(spark, rows), _tasks(spark, tasks), f"{tmp_path}/s")


def test_observation_of_another_task(spark, tmp_path):
    other = _tasks(spark, [1, 2, 3]).union(spark.createDataFrame([(4, "other")], "task_id long, task_sha256 string"))
    with pytest.raises(ValueError, match="another task"):
        snapshots.seal(_seen(spark, GOOD), other, f"{tmp_path}/s")


def test_components_combine_unless_they_share_a_source(spark, tmp_path):
    more = [(11, "train", "t", "a", "n", True), (12, "train", "t", "m", "o", True)]
    for name, rows in (("one", GOOD), ("two", more), ("three", [(21, "train", "s", "k", "l", True)])):
        snapshots.seal(_seen(spark, rows), _tasks(spark, [r[0] for r in rows]), f"{tmp_path}/{name}")
    kept = snapshots.combine(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], f"{tmp_path}/all")
    assert sorted(r.order for r in kept.collect()) == [1, 3, 12]
    with pytest.raises(ValueError, match="two components"):
        snapshots.combine(spark, [f"{tmp_path}/one", f"{tmp_path}/three"], f"{tmp_path}/no")


EXAMPLE = "split string, row_ordinal long, event long, input_ids array<int>, labels array<int>"


def test_tokens_round_trip(spark, tmp_path):
    rows = [("train" if i % 3 else "dev", i // 3, i % 2, [i, i + 1], [-100, i + 1]) for i in range(40)]
    tokens.write_tokens(spark.createDataFrame(rows, EXAMPLE).repartition(5), f"{tmp_path}/t")
    read = tokens.read_tokens(spark, f"{tmp_path}/t", 100)
    for split in ("train", "dev"):
        want = [r[3] for r in sorted(rows) if r[0] == split]
        assert [r.input_ids for r in read.where(F.col("split") == split).orderBy("ordinal").collect()] == want
        assert [r.input_ids for r in tokens.part(read, split, 2, 5).orderBy("ordinal").collect()] == want[2:5]
    assert {r.split: (r.examples, r.tokens, r.supervised, r.longest) for r in tokens.stats(read).collect()} == {"train": (26, 52, 26, 2), "dev": (14, 28, 14, 2)}
    for r in tokens.packed(read).join(read, ["split", "ordinal"]).collect():
        assert tokens.unpack_example(bytes(r["data"])) == (r.input_ids, [1, 1], r.labels)


@pytest.mark.parametrize("data", [b"", b"TOK1", b"TOK2\0\0\0\0", tokens.pack_example([1], [1], [1]) + b"\0"])
def test_packed_examples_are_checked(data):
    with pytest.raises(ValueError, match="packed"):
        tokens.unpack_example(data)


def test_violations_are_named(spark):
    good = ([1, 2], [-100, 2])
    rows = [("t", 0, 0, 0, *good), ("t", 2, 0, 1, *good), ("t", 3, 5, 0, *good), ("t", 4, 5, 0, *good), ("t", 5, 5, 1, [1, 99], [-100, 99]), ("t", 6, 5, 2, [1, 2], [-100, 1]), ("t", 7, 5, 3, [1, 2], [-100, -100]), ("t", 8, 5, 4, [1], [1, 1])]
    found = spark.createDataFrame(rows, "split string, ordinal long, row_ordinal long, event long, input_ids array<int>, labels array<int>")
    got = {(r.ordinal, r.reason) for r in tokens.violations(found, 50).collect()}
    assert {(2, "ordinal"), (3, "row_ordinal"), (4, "event"), (5, "vocabulary"), (6, "label"), (7, "unsupervised"), (8, "length")} <= got
    assert not any(o == 0 for o, _ in got)


@pytest.mark.parametrize(("body", "total"), [("id,amount\n1,2.5\n2,3\n", 5.5), ("id;Price\n1;2\n;\n\n2;4\n", 6), ("id\tcost\n1\t7\n", 7)])
def test_measures_of_any_shape(spark, tmp_path, body, total):
    (tmp_path / "a.csv").write_text(body)
    rows = measures.read_measures(spark, str(tmp_path / "a.csv"), "amount", ("price", "cost"))
    assert float(rows.agg(F.sum("amount")).first()[0]) == total


@pytest.mark.parametrize(("body", "why"), [("", "no rows"), ("id,x\n1,2\n", "0 columns"), ("amount,price\n1,2\n", "2 columns"), ("id,amount\n1,two\n", "number")])
def test_measures_that_cannot_be_read(spark, tmp_path, body, why):
    (tmp_path / "a.csv").write_text(body)
    with pytest.raises(ValueError, match=why):
        measures.read_measures(spark, str(tmp_path / "a.csv"), "amount", ("price",))


def test_sole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    assert measures.sole_file(spark, str(tmp_path), "*.csv").endswith("a.csv")
    (tmp_path / "b.csv").write_text("x")
    for pattern in ("*.csv", "*.txt"):
        with pytest.raises(ValueError, match="files fit"):
            measures.sole_file(spark, str(tmp_path), pattern)


def _call(i, name="look", arguments=None):
    return {"role": "assistant", "content": "", "tool_calls": [{"id": i, "name": name, "arguments": {} if arguments is None else arguments}]}


def _reply(i, text="r", **more):
    return {"role": "tool", "tool_call_id": i, "content": text, **more}


USER = {"role": "user", "content": "do it"}


@pytest.mark.parametrize(
    ("messages", "why"),
    [([USER, _call("1"), _reply("1")], None), ([USER, _reply("1")], "reply without"), ([_call("1"), _reply("1"), _reply("1")], "reply without"), ([_call("1"), USER], "message before"), ([_call("1"), _reply("1"), _call("1")], "repeated"), ([_call("1")], "unanswered"), ([_call("1", arguments="x")], "no object"), ([USER | {"tool_calls": [{"id": "1", "name": "a", "arguments": {}}]}], "by another")],
)
def test_linkage(messages, why):
    got = memory.linkage(messages)
    assert (got is None) if why is None else why in got
    assert why != "unanswered" or memory.linkage(messages, allow_pending=True) is None


def test_visible_memory_and_retention():
    seen = memory.visible_memory([USER, _call("1"), _reply("1", "found"), _call("2"), _reply("2", "no", failed=True), _call("3", "write")])
    assert (seen["goal"], seen["observations"], seen["failures"], seen["receipts"], seen["next"]["id"]) == ("do it", ["found"], ["no"], [("look", 2), ("write", 1)], "3")
    cost = lambda group: sum(len(m["content"]) for m in group)
    assert memory.retained([[USER], [USER, USER]], 10, cost) == [1] and memory.retained([[USER], [USER, USER]], 9, cost) == [] == memory.retained([], 9, cost)


def test_replay():
    system = {"role": "system", "content": "s"}
    start = [system, USER]
    after = [*start, _call("1")]
    full = [*after, _reply("1")]
    short = [system, {"role": "user", "content": "sum"}]
    events = [{"type": "model", "input": start, "message": _call("1")}, {"type": "tool", "message": _reply("1")}, {"type": "compaction", "before": full, "after": short, "accepted": True}, {"type": "model", "input": short, "message": {"role": "assistant", "content": "done"}}]
    assert memory.replay(start, events) == [*short, events[-1]["message"]]
    assert memory.replay(start, [*events[:2], events[2] | {"accepted": False}]) == full
    for broken in ([events[0] | {"input": []}], [events[1]], [*events[:2], events[2] | {"after": full}], [*events[:2], events[2] | {"after": [USER]}], [{"type": "other"}]):
        with pytest.raises(ValueError, match="event"):
            memory.replay(start, broken)
