"""Row contracts over records in JSON: every rule that a record breaks, by name, in one projection."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The schema's name, the splits, the one admitted source and the oracles that can be recomputed.
SCHEMA, SPLITS, SOURCE, ORACLES = "task.v1", ("train", "dev", "test"), "original_procedural", ("json_exact", "text_exact", "svg")
DOC = "array<struct<content: string, id: string, title: string>>"
ENVIRONMENT = f"struct<docs: {DOC}, files: map<string, string>, kv: map<string, string>>"
TASK_RULES = ("object", "schema", "task_id", "family", "template_id", "prompt", "split", "seed", "source", "benchmark", "environment", "files", "unsafe path", "file content", "kv", "docs", "oracle", "expected", "input hash")


def _at(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, f"$.{path}")


def safe_path(path: Column) -> Column:
    """A relative path without empty, dot or parent parts, drive letters, backslashes or NUL."""
    parts = F.split(path, "/", -1)
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~bad & ~path.contains("\\") & ~path.contains("\0") & ~path.rlike("^[A-Za-z]:"), F.lit(False))


def _sorted(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def input_hash(prompt: Column, environment: Column) -> Column:
    """SHA-256 of a task's input as JSON with sorted keys: environment (docs, files, kv) and prompt."""
    env = F.struct(environment["docs"].alias("docs"), _sorted(environment["files"]).alias("files"), _sorted(environment["kv"]).alias("kv"))
    return F.sha2(F.to_json(F.struct(env.alias("environment"), prompt.alias("prompt"))), 256)


def _kind(raw: Column, path: str) -> Column:
    """The kind of a JSON value by its first character: object, array, text, number, boolean, null or missing."""
    variant = F.try_parse_json(raw)
    value = F.to_json(F.try_variant_get(variant, f"$.{path}", "variant"))
    first = F.substring(value, 1, 1)
    return F.when(value.isNull(), "missing").when(first == "{", "object").when(first == "[", "array").when(first == '"', "text").when(value.isin("true", "false"), "boolean").when(value == "null", "null").otherwise("number")


def task_violations(raw: Column) -> Column:
    """The rules of TASK_RULES that a task record breaks, in that order; an empty array for a good one.

    Keys of the environment may be missing, and are empty then. Any other fault of what holds a value (no JSON object, no
    environment object) is told once, and not again for what would be inside.
    """
    kind = lambda path: _kind(raw, path)
    present = lambda path: (kind(path) == "text") & (F.coalesce(_at(raw, path), F.lit("")) != "")
    env_ok = kind("environment").isin("object", "missing")
    optional = lambda path, want: ~env_ok | kind(f"environment.{path}").isin(want, "missing")
    env = F.from_json(_at(raw, "environment"), ENVIRONMENT)
    files_ok = env_ok & kind("environment.files").isin("object", "missing")
    # values of the files as JSON, so that texts are told from numbers
    files = F.from_json(F.coalesce(_at(raw, "environment.files"), F.lit("{}")), "map<string, string>")
    file_kinds = F.try_variant_get(F.try_parse_json(raw), "$.environment.files", "map<string, variant>")
    texts = ~files_ok | F.coalesce(~F.exists(F.map_values(file_kinds), lambda v: F.substring(F.to_json(v), 1, 1) != '"'), F.lit(True))
    paths = ~files_ok | ~F.exists(F.coalesce(F.map_keys(files), F.array().cast("array<string>")), lambda p: ~safe_path(p))
    empty = F.from_json(F.lit('{"docs": [], "files": {}, "kv": {}}'), ENVIRONMENT)
    filled = F.struct(*[F.coalesce(env[k], empty[k]).alias(k) for k in ("docs", "files", "kv")])
    in_text = lambda path, values: (kind(path) == "text") & F.coalesce(_at(raw, path).isin(*values), F.lit(False))
    holds = {
        "schema": in_text("schema_version", [SCHEMA]),
        **{k: present(k) for k in ("task_id", "family", "template_id", "prompt")},
        "split": in_text("split", SPLITS),
        "seed": (kind("seed") == "number") & F.coalesce(_at(raw, "seed").rlike(r"^-?\d+$"), F.lit(False)),
        "source": in_text("provenance.source", [SOURCE]),
        "benchmark": (kind("provenance.benchmark") == "boolean") & F.coalesce(_at(raw, "provenance.benchmark") == "false", F.lit(False)),
        "environment": env_ok,
        "files": optional("files", "object"),
        "unsafe path": paths,
        "file content": texts,
        "kv": optional("kv", "object"),
        "docs": optional("docs", "array"),
        "oracle": in_text("oracle.kind", ORACLES),
        "expected": kind("oracle.expected") != "missing",
        "input hash": ~env_ok | F.coalesce(input_hash(_at(raw, "prompt"), filled) == _at(raw, "input_sha256"), F.lit(False)),
    }
    told = F.array_compact(F.array(*[F.when(~F.coalesce(holds[r], F.lit(False)), F.lit(r)) for r in TASK_RULES[1:]]))
    return F.when(F.coalesce(F.try_parse_json(raw).isNotNull() & (F.substring(F.ltrim(raw), 1, 1) == "{"), F.lit(False)), told).otherwise(F.array(F.lit("object")))


def argument_violations(raw: Column, rules: dict[str, dict]) -> Column:
    """How the arguments of a call break a schema, as `name: fault`, in the order of the schema; unknown names at the end.

    A rule of a name may have `required`, `type` (string, integer, number, boolean, array, object), `enum`, `least` and `most`
    of numbers, and `bytes`, the most UTF-8 bytes of a text. Arguments that are no JSON object are `: object`.
    """
    kinds = {"string": "text", "integer": "number", "number": "number", "boolean": "boolean", "array": "array", "object": "object"}
    found = []
    for name, rule in rules.items():
        kind, value = _kind(raw, name), _at(raw, name)
        number = value.try_cast("double")
        wrong = kind != kinds[rule["type"]] if "type" in rule else F.lit(False)
        if rule.get("type") == "integer":
            wrong = wrong | ~F.coalesce(value.rlike(r"^-?\d+$"), F.lit(False))
        fault = F.when(kind == "missing", F.lit("missing") if rule.get("required") else F.lit(None)).when(wrong, "type")
        if "enum" in rule:
            fault = fault.when(~F.coalesce(value.isin(*rule["enum"]), F.lit(False)), "enum")
        limits = [c for c in ((number < rule["least"]) if "least" in rule else None, (number > rule["most"]) if "most" in rule else None) if c is not None]
        if limits:
            fault = fault.when(F.coalesce(reduce(or_, limits), F.lit(False)), "range")
        if "bytes" in rule:
            fault = fault.when(F.octet_length(value) > rule["bytes"], "bytes")
        found.append(F.concat(F.lit(f"{name}: "), fault))
    names = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    unknown = F.transform(F.array_sort(F.array_except(names, F.array(*map(F.lit, rules)))), lambda n: F.concat(n, F.lit(": unknown")))
    is_object = F.coalesce(F.try_parse_json(raw).isNotNull() & (F.substring(F.ltrim(raw), 1, 1) == "{"), F.lit(False))
    return F.when(is_object, F.concat(F.array_compact(F.array(*found)), unknown)).otherwise(F.array(F.lit(": object")))
