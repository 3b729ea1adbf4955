"""Conversations as the model saw them: linkage of calls and replies, contexts kept by a stream, replay of recorded events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkage, replay
from ..sources.tables import shared_path
from ..streaming import archive, context
from .catalogue import query, table

BUDGET, SENTENCE, SUMMARY = 2400, 80, 400

# Turns of the assistant make calls and get replies, as many as the length of their text gives; some conversations are altered.
# In both dialects: a row for each message, with the ids of its calls as an array.
LINKED = """WITH m AS (SELECT conv_id, turn, role, LENGTH(text) % 3 AS n FROM {conversations}),
k AS (SELECT m.*, i FROM m JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x ON i < n WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, i, CONCAT(CAST(conv_id AS VARCHAR(20)), '-', CASE WHEN conv_id % 10 = 3 THEN 'x' ELSE CAST(turn AS VARCHAR(20)) END, '-', CAST(i AS VARCHAR(20))) AS id FROM k)
SELECT m.conv_id, m.turn * 8 AS place, m.role, i, id, CAST(NULL AS VARCHAR(60)) AS reply_to FROM m LEFT JOIN c ON m.conv_id = c.conv_id AND m.turn = c.turn
UNION ALL SELECT conv_id, turn * 8, CASE WHEN conv_id % 10 = 5 AND turn = 0 THEN 'user' ELSE 'system' END, 0, 'early', NULL FROM m WHERE conv_id % 10 = 5 AND turn = 0
UNION ALL SELECT conv_id, turn * 8 + 1 + i, 'tool', NULL, NULL, CASE WHEN conv_id % 10 = 4 AND turn = 3 THEN 'other' ELSE id END FROM c WHERE NOT (conv_id % 10 = 1 AND i = 1)
UNION ALL SELECT conv_id, turn * 8 + 6, 'tool', NULL, NULL, id FROM c WHERE conv_id % 10 = 2 AND i = 0 AND turn > 2"""


def _walk(limit: str = "") -> str:
    """The state machine, message by message: what is open, what was used, and the first fault."""
    return f"""WITH RECURSIVE l AS ({LINKED.replace('{conversations}', 'conversations')}),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k FROM (SELECT conv_id, place, min(role) AS role, coalesce(list(id ORDER BY i) FILTER (WHERE id IS NOT NULL), []) AS ids, min(reply_to) AS reply_to FROM l GROUP BY conv_id, place)),
w(conv_id, k, place, pending, used, why) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM s UNION ALL
SELECT s.conv_id, s.k, s.place, CASE WHEN s.role = 'tool' THEN list_filter(w.pending, lambda x: x <> s.reply_to) ELSE list_concat(w.pending, s.ids) END, list_concat(w.used, s.ids),
CASE WHEN s.role = 'tool' AND NOT coalesce(list_contains(w.pending, s.reply_to), false) THEN 'reply without an open call' WHEN s.role <> 'tool' AND len(w.pending) > 0 THEN 'message before a reply' WHEN len(s.ids) > 0 AND s.role <> 'assistant' THEN 'call by another role'
WHEN list_has_any(w.used, s.ids) OR len(list_distinct(s.ids)) < len(s.ids) THEN 'repeated call id' END
FROM w JOIN s ON s.conv_id = w.conv_id AND s.k = w.k + 1 WHERE w.why IS NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS last FROM w)
SELECT conv_id, CAST(place AS BIGINT) AS place, coalesce(why, 'unanswered call') AS reason FROM e WHERE last = 1 AND (why IS NOT NULL OR len(pending) > 0)"""


@query(_walk())
def linkage_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first violation of each conversation, at its message."""
    rows = spark.sql(LINKED, conversations=table(spark, sf_dir, "conversations"))
    call = F.when(F.col("id").isNotNull(), F.struct("i", F.struct("id", F.lit("f").alias("name"), F.lit("{}").alias("arguments")).alias("c")))
    calls = F.transform(F.array_sort(F.collect_list(call)), lambda x: x["c"])
    messages = rows.groupBy("conv_id", "place").agg(F.min("role").alias("role"), calls.alias("calls"), F.min("reply_to").alias("reply_to"))
    return linkage.violations(messages, at="place")


def leading_sentences(said: list[dict]) -> str:
    """The first sentence of each message, or its first 80 characters; 400 in all."""
    return " / ".join(re.match(r"[^.!?]*[.!?]?", m["content"])[0][:SENTENCE] for m in said)[:SUMMARY]


_COST = "strlen(CAST(to_json({t}) AS VARCHAR)) + length({r}) + 38"
_HEAD = context.SUMMARY_HEAD.replace("\n", "' || chr(10) || '")
_CUT = "list_sort(list_transform(range(1, len(body)), lambda k: {'d': abs(2 * list_sum(list_transform(list_slice(body, 1, k), lambda m: m.cost)) - list_sum(list_transform(body, lambda m: m.cost))), 'k': k}))[1].k"
#: One step is a compaction by the half rule, or the next message.
CONTEXTS = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT conv_id, turn, {{'role': role, 'text': coalesce(text, ''), 'cost': CAST({_COST.format(t="coalesce(text, '')", r="role")} AS BIGINT)}} AS said FROM conversations),
w(conv_id, turn, ctx, compactions, stopped) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(role VARCHAR, text VARCHAR, cost BIGINT)[]), 0, CAST(NULL AS VARCHAR) FROM m UNION ALL
SELECT conv_id, CASE WHEN full_up THEN turn ELSE turn + 1 END, CASE WHEN stopped IS NOT NULL OR full_up AND why IS NOT NULL THEN ctx WHEN full_up THEN result ELSE list_append(ctx, said) END, CASE WHEN full_up AND why IS NULL THEN compactions + 1 ELSE compactions END, CASE WHEN full_up THEN why ELSE stopped END
FROM (SELECT *, CASE WHEN len(body) < 2 THEN 'nothing to compact' WHEN list_sum(list_transform(result, lambda x: x.cost)) >= total THEN 'not smaller' END AS why
FROM (SELECT *, list_concat(front, [{{'role': 'user', 'text': summary, 'cost': CAST({_COST.format(t="summary", r="'user'")} AS BIGINT)}}], list_slice(body, cut + 1, len(body))) AS result
FROM (SELECT *, '{_HEAD}' || left(list_aggregate(list_transform(list_slice(body, 1, cut), lambda x: left(regexp_extract(x.text, '^[^.!?]*[.!?]?'), {SENTENCE})), 'string_agg', ' / '), {SUMMARY}) AS summary
FROM (SELECT *, CASE WHEN len(body) > 1 THEN {_CUT} ELSE len(body) END AS cut
FROM (SELECT *, list_slice(ctx, p + 1, len(ctx)) AS body, list_slice(ctx, 1, p) AS front, stopped IS NULL AND said.role = 'assistant' AND total > {BUDGET} AS full_up
FROM (SELECT w.*, m.said, coalesce(list_sum(list_transform(ctx, lambda x: x.cost)), 0) AS total, coalesce(list_position(list_transform(ctx, lambda x: x.role <> 'system'), true), len(ctx) + 1) - 1 AS p FROM w JOIN m ON m.conv_id = w.conv_id AND m.turn = w.turn))))))),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, compactions DESC) AS last FROM w)
SELECT conv_id, turn AS turns, compactions, stopped, len(ctx) AS n_visible, CAST(coalesce(list_sum(list_transform(ctx, lambda x: x.cost)), 0) AS BIGINT) AS tokens, sha256(coalesce(list_aggregate(list_transform(ctx, lambda x: x.role || ':' || x.text), 'string_agg', chr(30)), '')) AS visible_sha256 FROM e WHERE last = 1"""
POLICY = context.Policy("half", BUDGET, leading_sentences)


def digest(states: DataFrame) -> DataFrame:
    """A context's messages as a count, their cost and a hash."""
    json = F.transform("messages", lambda m: F.octet_length(F.to_json(F.struct(m["content"].alias("content"), m["role"].alias("role")))).cast("long") + 16)
    return states.select("conv_id", "turns", "compactions", "stopped", F.size("messages").cast("long").alias("n_visible"), F.aggregate(json, F.lit(0).cast("long"), lambda a, b: a + b).alias("tokens"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x1e"), 256).alias("visible_sha256"))


@query(CONTEXTS)
def stream_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that a stream over the conversations' files keeps for each of them."""
    return digest(context.stream_contexts(spark, f"{sf_dir}/conversations*.parquet", POLICY))


@query(CONTEXTS)
def stored_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a fold over the stored table."""
    return digest(context.contexts(table(spark, sf_dir, "conversations"), POLICY))


def altered(events: DataFrame) -> DataFrame:
    """Recorded events of which some conversations' were changed after the fact."""
    cases, last = F.col("conv_id") % 8, F.col("seq") == 1
    changed = lambda c, when, to: F.when(when, to).otherwise(F.col(c)).alias(c)
    compaction = F.col("type") == "compaction"
    made = {
        "input": changed("input", (cases == 1) & last, F.slice("input", 1, F.greatest(F.size("input") - 1, F.lit(0)))),
        "message": changed("message", (cases == 2) & last & ~compaction, F.col("message").withField("content", F.lit("other"))),
        "tokens_after": changed("tokens_after", (cases == 3) & compaction, F.col("tokens_before")),
        "retained": changed("retained", (cases == 4) & compaction, F.slice("retained", 1, F.size("retained") - 1)),
        "split_index": changed("split_index", (cases == 5) & compaction, F.col("split_index") + 1),
        "accepted": changed("accepted", (cases == 6) & compaction, F.lit(False)),
    }
    return events.select(*[made.get(c, F.col(c)) for c in events.columns]).where(~((cases == 7) & last))


@query()
def replay_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded events, some of them altered or missing, held against their transcripts."""
    said = table(spark, sf_dir, "conversations")
    return replay.replayed(context.messages_of(said), altered(context.context_events(said, POLICY)))


# Conversations as attempts: an answer to the fifth turn or a later one ends the attempt, what comes after it is refused.
_EVENTS = "SELECT conv_id AS attempt_id, turn AS sequence, CASE WHEN role = 'assistant' AND turn >= 5 THEN 'finish' ELSE role END AS kind, text AS payload FROM conversations"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_EVENTS}),
w(attempt_id, n_events, head, sealed) AS (SELECT DISTINCT attempt_id, CAST(0 AS BIGINT), repeat('0', 64), false FROM e UNION ALL
SELECT e.attempt_id, n_events + 1, sha256(head || '|' || e.sequence || '|' || coalesce(e.kind, '') || '|' || coalesce(e.payload, '')), e.kind = 'finish' FROM w JOIN e ON e.attempt_id = w.attempt_id AND e.sequence = w.n_events WHERE NOT sealed),
a AS (SELECT attempt_id, max(n_events) AS n_events, max_by(head, n_events) AS head, bool_or(sealed) AS sealed FROM w GROUP BY attempt_id),
t AS (SELECT *, attempt_id % 20 AS task_id, CASE WHEN attempt_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, sealed AND attempt_id % 3 > 0 AS ok FROM a)
SELECT attempt_id, task_id, split, n_events, head, CASE WHEN NOT sealed THEN 'incomplete' WHEN ok AND attempt_id = min(attempt_id) FILTER (WHERE ok) OVER (PARTITION BY task_id, split) THEN 'admitted' ELSE 'kept' END AS state FROM t""")
def attempt_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of attempts whose events a stream appends to an archive."""
    path = f"{sf_dir}/conversations*.parquet"
    said = spark.read.parquet(path)
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 8).parquet(path)
    kind = F.when((F.col("role") == "assistant") & (F.col("turn") >= 5), "finish").otherwise(F.col("role"))
    events = stream.select(F.col("conv_id").alias("attempt_id"), F.col("turn").cast("long").alias("sequence"), kind.alias("kind"), F.col("text").alias("payload"))
    links = archive.append(spark, events, shared_path(spark, "archive"), "finish")
    split = F.when(F.col("attempt_id") % 5 == 0, "dev").otherwise("train")
    attempts = said.select(F.col("conv_id").alias("attempt_id")).distinct().select("attempt_id", (F.col("attempt_id") % 20).alias("task_id"), split.alias("split"), (F.col("attempt_id") % 3 > 0).alias("success"))
    return archive.export(links, attempts, "finish")
