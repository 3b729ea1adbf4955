"""Contracts in full: tasks and arguments as JSON records, of which some are altered so that every rule is broken by some row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts
from .catalogue import query, table

#: (what stands in the record, what takes its place, what the contract says of it); null: the whole record.
TASK_CHANGES = [
    ('"task.v1"', '"task.v0"', "schema"),
    ('"task_id":"', '"task_id":"","x":"', "task_id"),
    ('"family":"', '"family":3,"x":"', "family"),
    ('"template_id":"', '"template_id":null,"x":"', "template_id"),
    ('"prompt":"', '"prompt":"","x":"', "prompt,input hash"),
    ('"split":"', '"split":"x', "split"),
    ('"seed":', '"seed":1.5,"x":', "seed"),
    ('"original_procedural"', '"other"', "source"),
    ('"benchmark":false', '"benchmark":"false"', "benchmark"),
    ('"environment":', '"environment":[],"x":', "environment"),
    ('"files":', '"files":[],"x":', "files,input hash"),
    ('"a/b.txt"', '"a/../b.txt"', "unsafe path,input hash"),
    ('"a/b.txt":', '"a/b.txt":3,"c":', "file content,input hash"),
    ('"kv":', '"kv":"x","y":', "kv,input hash"),
    ('"docs":', '"docs":{},"x":', "docs,input hash"),
    ('"svg"', '"none"', "oracle"),
    ('"expected":', '"unexpected":', "expected"),
    ('"input_sha256":"', '"input_sha256":"0', "input hash"),
    (None, "[]", "object"),
]
ARGUMENTS = {"path": {"required": True, "type": "string", "bytes": 24}, "n": {"type": "integer", "least": 0, "most": 1000}, "mode": {"required": True, "enum": ["read", "write"]}, "on": {"type": "boolean"}}
ARGUMENT_CHANGES = [
    ('"path":"', '"pat":"', "path: missing,pat: unknown"),
    ('"path":"', '"path":5,"x":"', "path: type,x: unknown"),
    ('"path":"', '"path":"more than four and twenty bytes ', "path: bytes"),
    ('"n":', '"n":1.5,"x":', "n: type,x: unknown"),
    ('"n":', '"n":-', "n: range"),
    ('"n":', '"n":null,"x":', "n: type,x: unknown"),
    ('"mode":"', '"mode":"x', "mode: enum"),
    ('"on":true', '"on":1', "on: type"),
    ('"on":true', '"off":true', "off: unknown"),
    (None, "[1]", ": object"),
    (None, "{", ": object"),
]


def _altered(record: Column, number: Column, changes: list) -> Column:
    out = None
    for k, (old, new, _) in enumerate(changes):
        now = F.lit(new) if old is None else F.replace(record, F.lit(old), F.lit(new))
        out = F.when(number == k, now) if out is None else out.when(number == k, now)
    return out.otherwise(record)


def _told(key: str, rows: str, changes: list) -> str:
    cases = " ".join(f"WHEN {k} THEN '{why}'" for k, (_, _, why) in enumerate(changes))
    return f"SELECT {key}, CASE {key} % {len(changes) + 5} {cases} ELSE '' END AS violations FROM {rows}"


@query(_told("doc_id", "documents", TASK_CHANGES))
def task_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as task records; of every 24 neighbours 19 break a rule each."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    text = lambda n: F.substring("text", 1, n)
    environment = F.struct(
        F.array(F.struct(text(50).alias("content"), F.lit("d").alias("id"), F.col("source").alias("title"))).alias("docs"),
        F.create_map(F.lit("a/b.txt"), text(200)).alias("files"),
        F.create_map(F.lit("k"), F.col("source")).alias("kv"),
    )
    split = F.when(F.col("lang") == "en", "train").otherwise("dev")
    prompt = F.concat(F.lit("Summarise: "), text(80))
    record = F.struct(
        F.lit(contracts.SCHEMA).alias("schema_version"),
        F.col("doc_id").cast("string").alias("task_id"),
        F.concat(F.lit("f-"), F.col("lang")).alias("family"),
        F.lit("t").alias("template_id"),
        prompt.alias("prompt"),
        split.alias("split"),
        F.col("doc_id").alias("seed"),
        F.struct(F.lit(contracts.SOURCE).alias("source"), F.lit(False).alias("benchmark")).alias("provenance"),
        environment.alias("environment"),
        F.struct(F.lit("svg").alias("kind"), F.col("n_chars").alias("expected")).alias("oracle"),
        contracts.input_hash(prompt, environment).alias("input_sha256"),
    )
    raw = _altered(F.to_json(record), F.col("doc_id") % (len(TASK_CHANGES) + 5), TASK_CHANGES)
    return docs.select("doc_id", raw.alias("raw")).select("doc_id", F.array_join(contracts.task_violations(F.col("raw")), ",").alias("violations"))


@query(_told("event_id", "events", ARGUMENT_CHANGES))
def argument_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arguments of calls; of every 16 neighbours 11 break the schema."""
    events = table(spark, sf_dir, "events")
    record = F.struct(F.col("event_type").alias("path"), (F.col("event_id") % 900 + 1).alias("n"), F.when(F.col("event_id") % 2 == 0, "read").otherwise("write").alias("mode"), F.lit(True).alias("on"))
    raw = _altered(F.to_json(record), F.col("event_id") % (len(ARGUMENT_CHANGES) + 5), ARGUMENT_CHANGES)
    return events.select("event_id", raw.alias("raw")).select("event_id", F.array_join(contracts.argument_violations(F.col("raw"), ARGUMENTS), ",").alias("violations"))
