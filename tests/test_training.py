"""Strict scans, inventories, shards, paired reports, encoding and compaction on small rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracemill.operators import compaction, encoding, evaluation
from tracemill.plans import training
from tracemill.sources import records

SF = "/root/testdata/sf0.001"
SCHEMA = StructType([StructField("id", LongType()), StructField("text", StringType())])


@pytest.mark.parametrize(("body", "reason"), [('{"id": 1}\n\n', "blank"), ("[1]\n", "object"), ('{"id": "x"}\n', "malformed"), ('{"id": 1\n', "malformed"), ("", "no rows"), ('{"id": -1}\n', "positive")])
def test_strict_scan_refuses(spark, tmp_path, body, reason):
    (tmp_path / "a.jsonl").write_text(body)
    with pytest.raises(ValueError, match=reason):
        records.read_strict(spark, str(tmp_path), SCHEMA, {"positive": F.col("id") > 0})


def test_strict_scan_reads(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "ü"}\n{"text": null, "id": 2}')
    assert [tuple(r) for r in records.read_strict(spark, str(tmp_path), SCHEMA).orderBy("id").collect()] == [(1, "ü"), (2, None)]


def test_inventory_sees_changes(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1, None), ("dev", 2, "b")], "split string, id int, text string")
    path = f"{tmp_path}/sink"
    assert records.write_partitioned(rows, path, ["split"]).count() == 2
    assert records.changed_files(spark, path).isEmpty()
    file = next((tmp_path / "sink/rows/split=train").glob("part-*"))
    assert json.loads(file.read_text()) == {"id": 1, "text": None}
    file.write_text("{}")
    next((tmp_path / "sink/rows/split=train").glob(".*.crc")).unlink()
    assert [r.reason for r in records.changed_files(spark, path).collect()] == ["altered"]
    with pytest.raises(Exception, match="exist"):
        records.write_partitioned(rows, path, ["split"])


def test_shards_are_bounded_and_whole(spark):
    lines = [("ä" * (i % 7),) for i in range(200)] + [(None,)]
    got = records.bounded_shards(spark.createDataFrame(lines, "line string").repartition(3), 40).collect()
    assert sorted(r.line for r in got) == sorted(x or "" for (x,) in lines)
    filled = {}
    for r in got:
        filled.setdefault((r.part, r.shard), []).append((r.row_index, len(r.line.encode()) + 1))
    for (part, shard), rows in filled.items():
        assert [i for i, _ in rows] == list(range(len(rows))) and sum(n for _, n in rows) <= 40
        if (part, shard + 1) in filled:
            assert sum(n for _, n in rows) + filled[part, shard + 1][0][1] > 40
    with pytest.raises(Exception, match="exceeds"):
        records.bounded_shards(spark.createDataFrame([("x" * 40,)], "line string"), 40).collect()


def _trial(task, family, mode, ok, **more):
    row = {"task_id": task, "family": family, "mode": mode, "task_success": ok, "protocol_valid": True, "split": "dev", "checkpoint": "c", "execution": "verified_environment"}
    return row | dict.fromkeys(evaluation.COUNTERS, 1) | more


def _trials(spark, rows):
    return spark.createDataFrame(rows, "task_id string, family string, mode string, task_success boolean, protocol_valid boolean, split string, checkpoint string, execution string, " + ", ".join(f"{c} long" for c in evaluation.COUNTERS))


GOOD = [_trial(t, f, m, ok) for t, f, oks in (("a", "easy", (1, 1, 0)), ("b", "easy", (1, 0, 0)), ("c", "hard", (0, 1, 1))) for m, ok in zip(training.MODES, map(bool, oks), strict=True)]


def test_macro_success_counts_families_once(spark):
    modes, whole = evaluation.summarize(_trials(spark, GOOD), training.MODES)
    got = {r["mode"]: r for r in modes.collect()}
    assert [got[m].macro_family_success for m in training.MODES] == [0.5, 0.75, 0.5]
    assert got["manual"].task_success == pytest.approx(1 / 3)
    whole = whole.first()
    assert whole.worst_mode_macro_success == 0.5 and whole.learned_model_score_verified


@pytest.mark.parametrize(
    ("rows", "reason"),
    [([], "no rows"), (GOOD[1:], "missing"), ([*GOOD, GOOD[0]], "repeated"), ([GOOD[0] | {"mode": "x"}, *GOOD[1:]], "unknown"), ([GOOD[0] | {"family": "hard"}, *GOOD[1:]], "family"), ([GOOD[0] | {"split": "train"}, *GOOD[1:]], "training"), ([GOOD[0] | {"input_tokens": -1}, *GOOD[1:]], "bad value"), ([GOOD[0] | {"checkpoint": "d"}, *GOOD[1:]], "checkpoint")],
)
def test_unpaired_rows_are_refused(spark, rows, reason):
    with pytest.raises(ValueError, match=reason):
        evaluation.summarize(_trials(spark, rows), training.MODES)


def test_only_the_assistant_is_supervised(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    said = [("user", "Wie geht's?"), ("assistant", "Gut, danke — €5."), ("tool", "x"), ("assistant", "ok")]
    rows = spark.createDataFrame([(1, said), (2, [("user", "a")]), (3, None), (4, [("assistant", "word " * 60)])], "id long, m array<struct<role string, content string>>")
    got = {r.key: r for r in encoding.encode(rows, "id", "m", path, 60).collect()}
    model = Tokenizer.from_file(path)
    assert model.decode(got[1].input_ids) == "".join(f"{r.upper()}:\n{c}\n" for r, c in said)
    assert model.decode([x for x in got[1].labels if x != encoding.IGNORED]) == "Gut, danke — €5.\nok\n"
    assert got[2].reason == got[3].reason == "nothing to supervise" and "tokens" in got[4].reason
    totals = encoding.stats(encoding.encode(rows, "id", "m", path, 60)).first()
    assert totals.examples == 1 and totals.total_tokens == totals.longest == len(got[1].input_ids)
    assert rows.limit(1).select(encoding.padded(F.array(F.lit(7)), 3, 0).alias("x")).first().x == [7, 0, 0]


def test_encoded_batches_are_bounded_by_tokens():
    import numpy as np
    import pyarrow as pa

    said = pa.array([[{"role": "user", "content": "x"}]] * 5000, pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())])))
    rows = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), said], ["key", "m"])
    done = list(encoding.encoded(iter([rows, rows.slice(0, 0)]), lambda m: (np.ones(100, np.int32), np.ones(100, np.int32), None) if m else (None, None, "none")))
    assert max(len(b.column(1).flatten()) for b in done) < encoding.TOKENS + 100
    assert [k for b in done for k in b.column(0).to_pylist()] == list(range(5000))


def _m(*said):
    return [{"role": r, "content": c} for r, c in said]


LONG = _m(("system", "s"), ("user", "u" * 50), ("assistant", "a" * 50), ("tool", "t" * 50), ("user", "v" * 40))


def test_half_keeps_tool_replies_with_their_call():
    now, why = compaction.compact(LONG, "half", training.characters, lambda old: "sum")
    assert why is None and now == [LONG[0], {"role": "user", "content": "sum"}, *LONG[2:]]


def test_modes_and_refusals():
    assert compaction.compact(LONG, "full", training.characters, lambda old: "sum")[0] == [LONG[0], {"role": "user", "content": "sum"}]
    assert compaction.compact(LONG, "manual", training.characters, lambda old: "sum", lambda units: [1])[0] == [LONG[0], {"role": "user", "content": "sum"}, *LONG[2:4]]
    assert compaction.compact(LONG, "manual", training.characters, lambda old: "sum", lambda units: [1, 1]) == (LONG, "bad choice")
    assert compaction.compact(LONG, "full", training.characters, lambda old: "x" * 999) == (LONG, "not smaller")
    assert compaction.compact(LONG[:1], "full", training.characters, lambda old: "x") == (LONG[:1], "nothing to compact")


def test_whole_tables(spark):
    rows = training.compacted_conversations(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert all(r.after <= training.BUDGET or r.reason for r in rows) and all(r.after < r.before or r.rounds == 0 for r in rows)
    assert training.encoded_conversations(spark, SF).count() == len(rows)
    assert training.shard_plan(spark, SF).agg(F.sum("n_rows")).first()[0] == spark.read.parquet(f"{SF}/documents.parquet").count()
