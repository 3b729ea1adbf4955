"""Contracts on records that break them, and a stated order of what is told."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import contracts
from tracemill.plans import contracts as plans


def task(**changed):
    environment = {"docs": [{"content": "c", "id": "1", "title": "t"}], "files": {"a/b.txt": 'x "é" \n', "c": "y"}, "kv": {"z": "1", "b": "2"}}
    made = {"schema_version": contracts.SCHEMA, "task_id": "t", "family": "f", "template_id": "m", "prompt": 'do "it"', "split": "dev", "seed": -3, "provenance": {"source": contracts.SOURCE, "benchmark": False}, "environment": environment, "oracle": {"kind": "svg", "expected": None}}
    made["input_sha256"] = hashlib.sha256(json.dumps({"environment": environment, "prompt": made["prompt"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return made | changed


BAD = {
    "good": (task(), []),
    "bare": (task(environment={}, input_sha256=hashlib.sha256(b'{"environment":{"docs":[],"files":{},"kv":{}},"prompt":"do \\"it\\""}').hexdigest()), []),
    "many": (task(schema_version=1, seed="3", split=None, oracle={"kind": "svg"}), ["schema", "split", "seed", "expected"]),
    "empty": ({}, ["schema", "task_id", "family", "template_id", "prompt", "split", "seed", "source", "benchmark", "oracle", "expected", "input hash"]),
    "environment": (task(environment=[1]), ["environment"]),
    "absolute": (task(environment={"files": {"/etc/x": "a"}}), ["unsafe path", "input hash"]),
    "list": ([], ["object"]),
}


def test_tasks(spark):
    raw = [(k, json.dumps(v, ensure_ascii=False)) for k, (v, _) in BAD.items()] + [("null", None), ("cut", "{")]
    got = {r.k: r.v for r in spark.createDataFrame(raw, "k string, raw string").select("k", contracts.task_violations(F.col("raw")).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in BAD.items()} | {"null": ["object"], "cut": ["object"]}


@pytest.mark.parametrize(("path", "safe"), [("a", True), ("a/b-c.txt", True), ("", False), (None, False), ("/a", False), ("a//b", False), ("a/", False), ("./a", False), ("a/..", False), ("C:a", False), ("a\\b", False), ("a\0", False), ("..a", True)])
def test_paths(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(contracts.safe_path(F.col("p")).alias("s")).first().s == safe


def test_arguments(spark):
    raw = {'{"path":"é","n":0,"mode":"read","on":false}': [], "{}": ["path: missing", "mode: missing"], '{"mode":"no","zeta":1,"alpha":{},"path":"x","n":1001}': ["n: range", "mode: enum", "alpha: unknown", "zeta: unknown"], "null": [": object"]}
    got = {r.raw: r.v for r in spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", contracts.argument_violations(F.col("raw"), plans.ARGUMENTS).alias("v")).collect()}
    assert got == raw


def test_every_rule_has_a_row_that_breaks_it():
    assert set(contracts.TASK_RULES) == {w for *_, why in plans.TASK_CHANGES for w in why.split(",")}
