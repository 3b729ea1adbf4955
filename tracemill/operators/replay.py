"""Replay of recorded model events against their transcripts, as one streamed fold for each trace.

A message is known by a mark: its role's first letter, how many calls it makes, and a digest of all its fields. The fold
holds the marks of the context that the model saw last, so a trace of any length needs as much as its context has messages.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold, running_count, stretched

MODES = ("half", "full", "manual")
_LISTS = ("input", "pinned", "source", "retained", "result")


def mark(message: Column) -> Column:
    """Null for no message; null fields are told from empty ones."""
    fields = F.to_json(F.struct(*[message[f].alias(f) for f in ("calls", "content", "reply_to", "role")]), {"ignoreNullFields": "false"})
    made = F.concat(F.coalesce(F.substring(message["role"], 1, 1), F.lit("-")), F.coalesce(F.size(message["calls"]), F.lit(0)).cast("string"), F.lit(":"), F.substring(F.sha2(fields, 256), 1, 32))
    return F.when(message.isNotNull(), made)


class _Trace:
    def __init__(self, key):
        self.key, self.context, self.waiting, self.seq, self.broken = key, [], None, None, None


def _units(body: list[str]) -> list[list[str]]:
    """Messages with the replies to their calls."""
    out, i = [], 0
    while i < len(body):
        n = 1 + int(body[i][1:].partition(":")[0])
        out.append(body[i : i + n])
        i += n
    return out


def _compaction_fault(e: dict, context: list[str]) -> str | None:
    """Why a compaction does not follow from the context before it."""
    mode, seen = e["mode"] or "half", e["input"]
    pinned, source, retained = (e[k] or [] for k in ("pinned", "source", "retained"))
    if mode not in MODES:
        return "unknown mode"
    if e["budget"] is not None and e["budget"] <= 0:
        return "budget"
    if seen is None and mode != "half" or seen is not None and seen != context:
        return "saw another context"
    front = next((i for i, m in enumerate(context) if not m.startswith("s")), len(context))
    body = context[front:]
    if pinned != context[:front]:
        return "system messages"
    if not source:
        return "empty source"
    if not e["summary_ok"]:
        return "empty summary"
    if mode == "half" and (pinned + source + retained != context or not retained or retained[0].startswith("t")):
        return "source and rest"
    if mode == "full" and (source != body or retained):
        return "source and rest"
    if mode == "manual":
        units, keep = _units(body), e["keep"] or []
        if source != body or keep != sorted(set(keep)) or any(not 0 <= k < len(units) for k in keep) or retained != [m for k in keep for m in units[k]]:
            return "source and rest"
    elif e["keep"]:
        return "kept groups"
    if e["split_index"] != (None if mode == "manual" else len(pinned) + len(source)):
        return "split index"
    if e["result"] != [*pinned, e["summary_mark"], *retained]:
        return "result"
    if e["accepted"] and not 0 <= (-1 if e["tokens_after"] is None else e["tokens_after"]) < (e["tokens_before"] or 0):
        return "not smaller"
    return None


def _step(t: _Trace, row: dict) -> Iterable[tuple]:
    if t.broken:
        return ()
    if row["_kind"] == 1 and t.waiting is not None:
        t.broken = (t.seq, "no response in the transcript")
    elif row["_kind"] == 0:
        if t.waiting is not None:
            t.broken = (t.seq, "no response in the transcript")
        t.context.append(row["said"])
    elif row["_kind"] == 2:
        if t.waiting is None:
            t.broken = (t.seq, "response without an event")
        elif t.waiting != row["said"]:
            t.broken = (t.seq, "another response")
        t.waiting = None
    else:
        t.seq = row["seq"]
        if row["type"] == "assistant":
            if row["input"] != t.context:
                t.broken = (t.seq, "saw another context")
            elif row["said"] is None or not row["said"].startswith("a"):
                t.broken = (t.seq, "no response")
            else:
                t.context.append(row["said"])
                t.waiting = row["said"]
        elif row["type"] == "compaction":
            why = _compaction_fault(row, t.context)
            if why:
                t.broken = (t.seq, why)
            elif row["accepted"]:
                t.context = list(row["result"])
        elif row["type"] == "error":
            if row["input"] is not None and row["input"] != t.context:
                t.broken = (t.seq, "saw another context")
        else:
            t.broken = (t.seq, "unknown type")
    return ()


def _finish(t: _Trace) -> Iterable[tuple]:
    import hashlib

    if t.waiting is not None and not t.broken:
        t.broken = (t.seq, "no response in the transcript")
    seq, why = t.broken or (None, None)
    context = None if t.broken else hashlib.sha256("\n".join(t.context).encode()).hexdigest()
    return [(t.key, seq, why, None if t.broken else len(t.context), context)]


def replayed(messages: DataFrame, events: DataFrame, key: str = "conv_id", at: str = "turn") -> DataFrame:
    """(key, seq, reason, n_context, context): the first event of each trace that does not follow, or the context at its end.

    messages: (key, at, role, content, calls, reply_to), the full transcript; events: (key, seq, type, ...) as
    `streaming.context.EVENT`. An event comes after what was said before the answer that it leads to: the n-th `assistant`
    event belongs to the n-th message of the assistant, compactions to the answer that follows them. A response without an
    event is told with the event before it (null for none). Traces without events have their transcript as context if
    nobody answered. `context` is a digest over the marks. Null keys, places and numbers are not allowed.
    """
    said = messages.select(F.col(key).alias("key"), F.col(at).alias("at"), "role", mark(F.struct("role", "content", "calls", "reply_to")).alias("said"))
    said = running_count(stretched(said, "key", ["at"]), "key", ["at"], F.col("role") == "assistant", "epoch")
    marks = {c: F.transform(c, mark) for c in _LISTS}
    summary = {"summary_ok": F.coalesce(F.trim("summary") != "", F.lit(False)), "summary_mark": mark(F.col("summary_message"))}
    told = events.select(F.col(key).alias("key"), "seq", "type", "mode", "split_index", "keep", "budget", "tokens_before", "tokens_after", "accepted", mark(F.col("message")).alias("said"), *[x.alias(c) for c, x in (marks | summary).items()])
    told = running_count(stretched(told, "key", ["seq"]), "key", ["seq"], F.col("type") == "assistant", "epoch")
    told = told.withColumns({"_kind": F.lit(1), "_at": F.col("seq").cast("long")}).drop("_stretch")
    kind = F.when(F.col("role") == "assistant", 2).otherwise(0)
    said = said.select("key", "epoch", "said", kind.alias("_kind"), F.col("at").cast("long").alias("_at"))
    rows = told.unionByName(said, allowMissingColumns=True)
    key_type = messages.schema[key].dataType.simpleString()
    out = ordered_fold(rows, "key", ["epoch", "_kind", "_at"], _Trace, _step, _finish, f"key {key_type}, seq int, reason string, n_context int, context string")
    return out.withColumnRenamed("key", key)
