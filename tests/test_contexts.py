"""Linkage, contexts and replay against plain versions: fuzzed conversations, streams in many files and restarts, altered events."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import compaction, linkage, memory, replay
from tracemill.operators.fold import ordered_fold, running_count, stretched
from tracemill.plans import contexts as plans
from tracemill.streaming import context

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_batches(spark):
    """Arrow batches of three rows and many partitions, so that keys span batches and stretches."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_folds_and_counts_span_batches_and_stretches(spark, small_batches):
    rows = [(k, i) for k, n in (("a", 50), ("b", 1), (None, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    got = ordered_fold(df, "k", ["i"], lambda k: [k, []], lambda s, r: s[1].append(r["i"]) or (), lambda s: [(s[0], ",".join(map(str, s[1])))], "k string, all string")
    assert {r.k: r["all"] for r in got.collect()} == {"a": ",".join(map(str, range(50))), "b": "0", None: ",".join(map(str, range(7)))}
    counted = running_count(stretched(df, "k", ["i"]), "k", ["i"], F.col("i") % 2 == 0, "n")
    assert counted.select("_stretch").distinct().count() > 3 and all(r.n == (r.i + 1) // 2 for r in counted.collect()) and counted.count() == len(rows)
    assert ordered_fold(df.limit(0), "k", ["i"], list, lambda s, r: (), lambda s: [("x", "y")], "k string, all string").collect() == []


def said(r: random.Random) -> list[dict]:
    out, opened, n = [], [], 0
    for _ in range(r.randrange(1, 14)):
        if opened and r.random() < 0.85:
            i = opened.pop(r.randrange(len(opened)))
            out.append({"role": "tool", "content": "", "tool_call_id": r.choice(["zz", None]) if r.random() < 0.05 else i})
            if r.random() < 0.04:
                out.append(dict(out[-1]))
            continue
        role, calls = r.choice(["user", "assistant", "assistant", "system"]), []
        for _ in range(r.choice([0, 0, 1, 1, 2, 3]) if role == "assistant" or r.random() < 0.03 else 0):
            n += r.random() < 0.97
            calls.append({"id": f"c{n}", "name": "f", "arguments": r.choice([{}] * 30 + [[1]])})
        opened = [c["id"] for c in calls]
        out.append({"role": role, "content": "x", "tool_calls": calls})
    return out


def test_linkage_equals_the_plain_version(spark, small_batches):
    r = random.Random(1)
    talks = {c: said(r) for c in range(250)}
    rows = [(c, i, m["role"], [(k["id"], k["name"], json.dumps(k["arguments"])) for k in m.get("tool_calls", [])] or None, m.get("tool_call_id"), "x") for c, t in talks.items() for i, m in enumerate(t)]
    df = spark.createDataFrame(rows, f"conv_id long, at long, role string, calls {linkage.CALLS}, reply_to string, key string").repartition(3)

    def first(t, allow):
        for n in range(1, len(t) + 1):
            why = memory.linkage(t[:n], True)
            if why:
                return n - 1, why
        why = memory.linkage(t, allow)
        return (len(t) - 1, why) if why else None

    for allow in (False, True):
        want = {c: v for c, t in talks.items() if (v := first(t, allow))}
        assert {x.conv_id: (x["at"], x.reason) for x in linkage.violations(df, allow_pending=allow).collect()} == want and len({w for _, w in want.values()}) >= 5
    assert linkage.violations(df.limit(0)).collect() == []


def test_stream_goes_on_after_a_restart_and_with_late_turns(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    late = rows.withColumn("n", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), 1).otherwise(0))
    for folder, part in (("first", "n = 0 and turn < 4"), ("second", "n = 1 or turn >= 4")):
        late.where(part).drop("n").repartitionByRange(5, "turn", "conv_id").write.parquet(f"{tmp_path}/{folder}")
    files = tmp_path / "files"
    files.mkdir()
    home = f"{tmp_path}/home"

    def arrive(folder):
        for f in sorted((tmp_path / folder).glob("part-*")):
            f.rename(files / f"{folder}-{f.name}")

    arrive("first")
    some = context.stream_contexts(spark, str(files), plans.POLICY, 2, home)
    part = {r.conv_id: r.turns for r in some.collect()}
    assert all(part[c] == 1 for c in part if c % 3 == 0) and max(part.values()) == 4
    arrive("second")
    spark.catalog.refreshByPath(home)
    whole = context.stream_contexts(spark, str(files), plans.POLICY, 2, home)
    got, want = ({r.conv_id: r for r in plans.digest(x).collect()} for x in (whole, context.contexts(rows, plans.POLICY)))
    assert got == want and any(r.compactions > 1 for r in got.values())
    again = context.stream_contexts(spark, str(files), plans.POLICY, 2, home)
    assert {r.conv_id: r for r in plans.digest(again).collect()} == want
    assert spark.conf.get(context._PROVIDER, None) is None or "RocksDB" not in spark.conf.get(context._PROVIDER)


def talk(n, tools=False):
    out = [{"role": "system", "content": "be brief"}]
    for i in range(n):
        out.append({"role": "user", "content": f"question {i} " + "word " * 20})
        if tools:
            out += [{"role": "assistant", "content": "", "calls": [{"id": f"c{i}", "name": "f", "arguments": "{}"}]}, {"role": "tool", "content": "found " * 5, "reply_to": f"c{i}"}]
        out.append({"role": "assistant", "content": f"answer {i}. " + "more " * 20})
    return out


def table(spark, talks):
    rows = [(c, i, m["role"], m["content"], m.get("calls"), m.get("reply_to")) for c, t in talks.items() for i, m in enumerate(t)]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, content string, calls {linkage.CALLS}, reply_to string").repartition(3)


def policy(mode):
    return context.Policy(mode, 900, plans.leading_sentences, choose=lambda units: [len(units) - 1])


@pytest.mark.parametrize("mode", compaction.MODES)
def test_recorded_events_replay_to_the_context(spark, small_batches, mode):
    talks = {1: talk(12), 2: talk(9, tools=True), 3: talk(0), 4: [{"role": "user", "content": "x"}], 5: talk(1)}
    rows = table(spark, talks)
    events = context.context_events(rows, policy(mode))
    kinds = {r["type"]: r["count"] for r in events.groupBy("type").count().collect()}
    assert kinds["compaction"] > 2 and "error" not in kinds
    got = {r.conv_id: r for r in replay.replayed(rows, events).collect()}
    ends = context.contexts(rows, policy(mode)).select("conv_id", F.transform("messages", replay.mark).alias("m"))
    want = {r.conv_id: r for r in ends.select("conv_id", F.size("m").alias("n"), F.sha2(F.array_join("m", "\n"), 256).alias("context")).collect()}
    assert len(got) == 5 and all(r.reason is None and (r.n_context, r.context) == (want[c].n, want[c].context) for c, r in got.items())
    for t in talks.values():  # the context never parts a call from its reply
        kept = context.Context()
        for m in t:
            list(kept.add(m, policy(mode)))
            assert memory.linkage([{"role": x["role"], "tool_calls": [{"id": c["id"], "arguments": {}} for c in x.get("calls", [])], "tool_call_id": x.get("reply_to")} for x in kept.said], True) is None


CHANGES = {
    "saw another context": lambda e: e["type"] == "assistant" and e | {"input": e["input"][:-1]},
    "another response": lambda e: e["type"] == "assistant" and e | {"message": e["message"] | {"content": "x"}},
    "unknown type": lambda e: e | {"type": "other"},
    "unknown mode": lambda e: e["type"] == "compaction" and e | {"mode": "none"},
    "budget": lambda e: e["type"] == "compaction" and e | {"budget": 0},
    "system messages": lambda e: e["type"] == "compaction" and e | {"pinned": []},
    "empty source": lambda e: e["type"] == "compaction" and e | {"source": []},
    "empty summary": lambda e: e["type"] == "compaction" and e | {"summary": " "},
    "source and rest": lambda e: e["type"] == "compaction" and e | {"retained": e["retained"][1:]},
    "kept groups": lambda e: e["type"] == "compaction" and e | {"keep": [0]},
    "split index": lambda e: e["type"] == "compaction" and e | {"split_index": e["split_index"] + 1},
    "result": lambda e: e["type"] == "compaction" and e | {"result": e["result"][:-1]},
    "not smaller": lambda e: e["type"] == "compaction" and e | {"tokens_after": e["tokens_before"]},
}


def test_the_first_break_is_told(spark, small_batches):
    base = talk(8, tools=True)
    chosen = {i: why for i, why in enumerate(CHANGES)}
    talks = {c: base for c in chosen} | {100: base, 101: base[:-1], 102: base}
    rows = table(spark, talks)
    schema = context.context_events(rows, policy("half")).schema
    whole = [r.asDict(True) for r in context.context_events(table(spark, {0: base}), policy("half")).collect()]
    whole.sort(key=lambda e: e["seq"])
    made, want = [], {100: (None, None)}
    for c, why in chosen.items():
        fit = [e["seq"] for e in whole if CHANGES[why](e)]
        cut = fit[len(fit) // 2]
        made += [(CHANGES[why](e) if e["seq"] == cut else e) | {"conv_id": c} for e in whole]
        want[c] = (cut, why)
    for c, events in ((100, whole), (101, whole), (102, whole[:-1])):
        made += [e | {"conv_id": c} for e in events]
    want[101] = (whole[-1]["seq"], "no response in the transcript")
    want[102] = (whole[-2]["seq"], "response without an event")
    events = spark.createDataFrame([tuple(e[f.name] for f in schema) for e in made], schema).repartition(4)
    assert {r.conv_id: (r.seq, r.reason) for r in replay.replayed(rows, events).collect()} == want


def test_halves_are_by_whole_prefixes():
    sizes = {"a": 1, "b": 5, "c": 1, "d": 3}
    cost = lambda said: sum(sizes[m["content"]] for m in said) + (10 if said else 0)  # noqa: E731  a cost with a fixed share
    units = [[{"role": "user", "content": c}] for c in "abcd"]
    pinned = [{"role": "system", "content": "a"}]
    want = min((abs(2 * sum(sizes[c] for c in "abcd"[:n]) - 10), n) for n in (1, 2, 3))[1]
    assert compaction.halfway(units, cost, pinned) == want
