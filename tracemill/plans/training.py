"""Paired reports, encoding, compaction and bounded shards over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, encoding, evaluation
from ..sources import records
from .catalogue import query, table

MODES = ("full", "half", "manual")
LIMIT, BUDGET, SHARD_BYTES = 4096, 600, 1 << 20


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as tasks: `full` succeeds on good ones, `half` on clean ones, `manual` on good and clean ones."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    good, clean, mode = F.col("quality") == 1, F.col("toxic") == 0, F.col("mode")
    rows = rows.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    rows = rows.withColumn("task_success", F.when(mode == "full", good).when(mode == "half", clean).otherwise(good & clean)).withColumn("compactions", F.when(mode == "full", 0).otherwise(F.col("n_chars") % 3))
    rest = {c: F.lit(1 if c in ("model_invocations", "model_responses") else 0) for c in evaluation.COUNTERS if c not in ("compactions", "input_tokens")}
    fixed = {"split": F.lit("dev"), "checkpoint": F.lit("c1"), "execution": F.lit("verified_environment"), "protocol_valid": F.col("n_chars") > 0}
    return rows.withColumns(rest | fixed).select(F.col("doc_id").alias("task_id"), F.col("lang").alias("family"), "mode", "task_success", F.col("n_chars").alias("input_tokens"), "compactions", *rest, *fixed)


@query("""WITH t AS (SELECT doc_id, lang, n_chars, unnest(['full', 'half', 'manual']) AS mode, quality = 1 AS good, toxic = 0 AS clean FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, CASE mode WHEN 'full' THEN good WHEN 'half' THEN clean ELSE good AND clean END AS ok, CASE mode WHEN 'full' THEN 0 ELSE n_chars % 3 END AS c FROM t),
f AS (SELECT mode, lang, AVG(CAST(ok AS INT)) AS m FROM r GROUP BY mode, lang), m AS (SELECT mode, ROUND(AVG(m), 9) AS macro FROM f GROUP BY mode)
SELECT mode, COUNT(*) AS tasks, COUNT(*) FILTER (WHERE ok) AS successes, MIN(macro) AS macro_family_success, COUNT(*) FILTER (WHERE c > 0) AS compaction_exercised_tasks, ROUND(AVG(n_chars), 6) AS mean_input_tokens FROM r JOIN m USING (mode) GROUP BY mode""")
def paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes, _ = evaluation.summarize(_trials(spark, sf_dir), MODES)
    return modes.select("mode", "tasks", "successes", F.round("macro_family_success", 9).alias("macro_family_success"), "compaction_exercised_tasks", F.round("mean_input_tokens", 6).alias("mean_input_tokens"))


# trials whose counters differ from task to task, in words of both dialects
_COUNTED = {
    "task_success": "CASE mode WHEN 'full' THEN quality = 1 WHEN 'half' THEN toxic = 0 ELSE quality = 1 AND toxic = 0 END",
    "protocol_valid": "n_chars % 9 <> 0",
    "compactions": "CASE mode WHEN 'full' THEN 0 ELSE n_chars % 3 END",
    "compaction_failures": "CASE WHEN n_chars % 5 = 0 AND mode <> 'full' THEN 1 ELSE 0 END",
    "compaction_attempts": "CASE mode WHEN 'full' THEN 0 ELSE n_chars % 3 + CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END END",
    "model_invocations": "CASE WHEN n_chars % 17 = 0 AND mode = 'half' THEN 0 ELSE 1 + n_chars % 4 END",
    "model_responses": "CASE WHEN n_chars % 17 = 0 AND mode = 'half' THEN 0 ELSE 1 + n_chars % 4 - CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END END",
    "model_errors": "CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END",
    "context_overflows": "CASE WHEN n_chars % 11 = 0 AND mode = 'manual' THEN 2 ELSE 0 END",
    "attempt_errors": "CASE WHEN n_chars % 13 = 0 THEN 1 ELSE 0 END",
    "input_tokens": "n_chars",
    "execution": "CASE WHEN mode = 'half' AND n_chars % 19 = 0 THEN 'unexecuted' ELSE 'verified_environment' END",
}
_SOME = "CAST(COUNT(*) FILTER (WHERE {} > 0) AS BIGINT) AS {}"
_SHARES = {"task_success": "COUNT(*) FILTER (WHERE task_success)", "protocol_valid": "COUNT(*) FILTER (WHERE protocol_valid)", "compaction_exercised": "COUNT(*) FILTER (WHERE compactions > 0)", "model_invocation_coverage": "COUNT(*) FILTER (WHERE model_invocations > 0)", "mean_compactions": "SUM(compactions)", "mean_input_tokens": "SUM(input_tokens)"}
_MEASURES = ", ".join(
    [
        "COUNT(*) AS tasks",
        "CAST(COUNT(*) FILTER (WHERE task_success) AS BIGINT) AS successes",
        "CAST(COUNT(*) FILTER (WHERE NOT task_success) AS BIGINT) AS task_failures",
        "CAST(COUNT(*) FILTER (WHERE NOT protocol_valid) AS BIGINT) AS protocol_failures",
        *[f"ROUND(CAST({total} AS DOUBLE) / COUNT(*), 9) AS {name}" for name, total in _SHARES.items()],
        *[_SOME.format(c, name) for c, name in (("compactions", "compaction_exercised_tasks"), ("compaction_attempts", "compaction_attempt_tasks"), ("compaction_failures", "compaction_failure_tasks"), ("model_invocations", "model_invocation_tasks"), ("model_errors", "model_error_tasks"), ("context_overflows", "context_overflow_tasks"), ("attempt_errors", "attempt_error_tasks"))],
        "CAST(SUM(model_invocations) AS BIGINT) AS model_invocations",
        "CAST(SUM(model_responses) AS BIGINT) AS model_responses",
        "COUNT(*) FILTER (WHERE execution <> 'verified_environment') = 0 AS verified",
    ]
)


@query(f"""WITH t AS (SELECT doc_id, lang AS family, n_chars, quality, toxic, unnest(['full', 'half', 'manual']) AS mode FROM labels JOIN documents USING (doc_id)),
r AS (SELECT doc_id, family, mode, {", ".join(f"{e} AS {c}" for c, e in _COUNTED.items())} FROM t),
m AS (SELECT mode, ROUND(AVG(s), 9) AS macro_family_success FROM (SELECT mode, family, AVG(CAST(task_success AS INT)) AS s FROM r GROUP BY ALL) GROUP BY mode)
SELECT mode, MIN(macro_family_success) AS macro_family_success, {_MEASURES} FROM r JOIN m USING (mode) GROUP BY mode""")
def paired_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of a paired evaluation whose tasks differ in every counter."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    rows = rows.selectExpr("doc_id AS task_id", "lang AS family", "mode", "'dev' AS split", "'c1' AS checkpoint", *[f"{e} AS {c}" for c, e in _COUNTED.items()])
    modes, _ = evaluation.summarize(rows, MODES)
    return modes.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in modes.dtypes])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) with turns in order; a conversation is bounded."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


@query()
def encoded_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encoding.encode(conversations(spark, sf_dir), "conv_id", "messages", public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
    return out.withColumnRenamed("key", "conv_id")


def characters(said: list[dict]) -> int:
    return sum(len(m["content"]) + 16 for m in said)


def opening(said: list[dict]) -> str:
    """A stand-in for a summarising model: the first 24 characters of each message, 240 in all."""
    return ("Earlier: " + " / ".join(m["content"][:24] for m in said))[:240]


@query()
def compacted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compaction.fit_all(conversations(spark, sf_dir), "conv_id", "messages", BUDGET, "half", characters, opening)
    return out.withColumnRenamed("key", "conv_id")


@query()
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return records.bounded_shards(docs.select(records.canonical(docs)), SHARD_BYTES).groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("line") + 1).alias("n_bytes"))
