"""Words, lines, retrieval, leakage and screening over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import top_matches
from ..sources.tables import written
from .catalogue import both, query, table

TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9_]+', 0)"
DUCK_TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9_]+')"


def words(x: str) -> str:
    return TOKENS.replace("{x}", x)


def duck_words(x: str) -> str:
    return DUCK_TOKENS.replace("{x}", x)


both(
    "word_counts",
    "SELECT word, COUNT(*) AS n FROM (SELECT explode(regexp_extract_all(lower(text), '[a-z]+', 0)) AS word FROM {documents}) GROUP BY word",
    "SELECT word, COUNT(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word",
)
both(
    "unique_word_count",
    f"SELECT lang, COUNT(DISTINCT word) AS n FROM (SELECT lang, explode({words('text')}) AS word FROM {{documents}}) GROUP BY lang",
    f"SELECT lang, COUNT(DISTINCT word) AS n FROM (SELECT lang, unnest({duck_words('text')}) AS word FROM documents) GROUP BY lang",
)
both(
    "unique_tags",
    f"SELECT DISTINCT word AS tag FROM (SELECT explode({words('text')}) AS word FROM {{documents}} WHERE lang = 'en')",
    f"SELECT DISTINCT word AS tag FROM (SELECT unnest({duck_words('text')}) AS word FROM documents WHERE lang = 'en')",
)
both(
    "longest_line",
    "SELECT doc_id, max_by(line, struct(length(line), -pos)) AS line, CAST(max(length(line)) AS BIGINT) AS n FROM (SELECT doc_id, posexplode(split(regexp_replace(text, '\\n$', ''), '\\n')) AS (pos, line) FROM {documents}) GROUP BY doc_id",
    "SELECT doc_id, arg_max(line, length(line) * 1000000 - pos) AS line, CAST(max(length(line)) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS pos FROM documents) GROUP BY doc_id",
)
both(
    "unique_lines",
    "SELECT doc_id, CAST(size(array_distinct(split(regexp_replace(text, '\\n$', ''), '\\n'))) AS BIGINT) AS n_unique, CAST(size(split(regexp_replace(text, '\\n$', ''), '\\n')) AS BIGINT) AS n_lines FROM {documents}",
    "SELECT doc_id, CAST(len(list_distinct(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)))) AS BIGINT) AS n_unique, CAST(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS BIGINT) AS n_lines FROM documents",
)
both(
    "occurrence_context",
    "SELECT doc_id, CAST(MIN(pos) + 1 AS BIGINT) AS line_number, min_by(line, pos) AS line FROM (SELECT doc_id, posexplode(split(regexp_replace(text, '\\n$', ''), '\\n')) AS (pos, line) FROM {documents}) WHERE contains(lower(line), 'the') GROUP BY doc_id",
    "SELECT doc_id, CAST(MIN(pos) AS BIGINT) AS line_number, arg_min(line, pos) AS line FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS pos FROM documents) WHERE contains(lower(line), 'the') GROUP BY doc_id",
)
both("cross_split_overlap", "SELECT md5(text) AS digest, COUNT(DISTINCT source) AS splits, COUNT(*) AS n FROM {documents} GROUP BY 1 HAVING COUNT(DISTINCT source) > 1")
both("content_reuse", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN (SELECT MIN(doc_id) AS doc_id FROM {documents} GROUP BY md5(text)) f ON d.doc_id = f.doc_id", "SELECT d.doc_id FROM documents d ANTI JOIN (SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY md5(text)) f ON d.doc_id = f.doc_id")
both("secret_screen", "SELECT doc_id, COUNT(*) AS n FROM (SELECT doc_id, explode(regexp_extract_all(text, '(AKIA[0-9A-Z]+|(password|token)[ =:]+[^ ]+)', 0)) AS hit FROM {documents}) GROUP BY doc_id", "SELECT doc_id, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(AKIA[0-9A-Z]+|(password|token)[ =:]+[^ ]+)')) AS hit FROM documents) GROUP BY doc_id")

SEARCH = f"""WITH b AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest({duck_words('text')}) AS word FROM benchmark)),
t AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({duck_words('text')}) AS word FROM documents)),
s AS (SELECT b.item_id, t.doc_id, COUNT(*) AS score FROM b JOIN t ON b.word = t.word GROUP BY b.item_id, t.doc_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) """


def found(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The best documents of each item, written: few rows, whose known size lets joins with documents leave these in place."""
    return written(top_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n), "found")


@query(SEARCH + "SELECT item_id, doc_id, score, place FROM r WHERE place <= 5")
def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, 5)


@query(SEARCH + "SELECT item_id, MAX(doc_id) FILTER (WHERE place = 1) AS first, MAX(doc_id) FILTER (WHERE place = 2) AS second FROM r WHERE place <= 2 GROUP BY item_id")
def ranked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda k: F.max(F.when(F.col("place") == k, F.col("doc_id")))
    return found(spark, sf_dir, 2).groupBy("item_id").agg(by(1).alias("first"), by(2).alias("second"))


@query("WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'zzqxj' || item_id ELSE text END AS text FROM benchmark), " + SEARCH.replace("WITH ", "").replace("FROM benchmark", "FROM q") + "SELECT q.item_id, r.doc_id, r.score FROM q LEFT JOIN r ON q.item_id = r.item_id AND r.place = 1")
def no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third query has a word that no document has: its result is empty."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("zzqxj"), F.col("item_id").cast("string"))).otherwise(F.col("text")).alias("text"))
    best = top_matches(table(spark, sf_dir, "documents"), asked, 1)
    return asked.join(best, "item_id", "left").select("item_id", "doc_id", "score")


@query(SEARCH + "SELECT item_id, r.doc_id, regexp_extract(text, '([A-Z][a-z]+)', 1) AS fact, length(regexp_extract(text, '^([^.]*)', 1)) AS opening FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE place = 1")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir, 1).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("item_id", "doc_id", F.regexp_extract("text", "([A-Z][a-z]+)", 1).alias("fact"), F.length(F.regexp_extract("text", "^([^.]*)", 1)).cast("long").alias("opening"))


LONG = "([a-z]{9,15})"


@query(SEARCH + f"""SELECT f.item_id, f.doc_id AS first_doc, f.word, MIN(t.doc_id) AS second_doc FROM (SELECT item_id, r.doc_id, regexp_extract(lower(text), '{LONG}', 1) AS word FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE place = 1) f
LEFT JOIN t ON t.word = f.word AND t.doc_id <> f.doc_id GROUP BY ALL""")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document names a word, its first long one; the second hop is the first other document with that word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = found(spark, sf_dir, 1).join(docs, "doc_id").select("item_id", F.col("doc_id").alias("first_doc"), F.regexp_extract(F.lower("text"), LONG, 1).alias("word"))
    first = written(first, "first")  # used twice
    held = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    pairs = first.join(held, "word").where("doc_id <> first_doc").groupBy("item_id").agg(F.min("doc_id").alias("second_doc"))
    return first.join(pairs, "item_id", "left").select("item_id", "first_doc", "word", "second_doc")


# a document that contains an item holds the item's longest inner word whole: their ids meet on it, then their texts; items
# without one are few
both(
    "benchmark_leak",
    f"""WITH b AS (SELECT item_id, text, array_sort(transform(slice(w, 2, greatest(size(w) - 2, 0)), x -> struct(-length(x) AS n, x AS word)))[0].word AS word FROM (SELECT item_id, text, {words('text')} AS w FROM {{benchmark}} WHERE size({words('text')}) > 2)),
t AS (SELECT doc_id, explode(array_distinct({words('text')})) AS word FROM {{documents}}),
p AS (SELECT t.doc_id, b.item_id, b.text FROM b JOIN t ON b.word = t.word),
few AS (SELECT item_id, text FROM {{benchmark}} WHERE size({words('text')}) <= 2)
SELECT d.doc_id, p.item_id FROM p JOIN {{documents}} d ON p.doc_id = d.doc_id AND contains(d.text, p.text) UNION SELECT d.doc_id, f.item_id FROM {{documents}} d JOIN few f ON contains(d.text, f.text)""",
    "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)

# conversations
both("transcript", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role, text))), m -> concat(upper(m.role), ': ', m.text)), '|') AS transcript FROM {conversations} GROUP BY conv_id", "SELECT conv_id, string_agg(upper(role) || ': ' || text, '|' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
both("conversation_fingerprint", "SELECT conv_id, md5(array_join(transform(array_sort(collect_list(struct(turn, role, text))), m -> concat(m.role, '=', m.text)), '|')) AS fingerprint FROM {conversations} GROUP BY conv_id", "SELECT conv_id, md5(string_agg(role || '=' || text, '|' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id")
both(
    "conversation_contract",
    """WITH o AS (SELECT *, LAG(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k, MIN(turn) OVER (PARTITION BY conv_id) AS first_turn FROM {conversations})
SELECT conv_id, COUNT(*) FILTER (WHERE role NOT IN ('system', 'user', 'assistant', 'tool')) AS bad_role, COUNT(*) FILTER (WHERE role = 'system' AND k > 1) AS late_system, COUNT(*) FILTER (WHERE role = previous) AS repeated,
COUNT(*) FILTER (WHERE turn - first_turn <> k - 1) AS gaps, COUNT(*) FILTER (WHERE text IS NULL OR text = '') AS empty FROM o GROUP BY conv_id""",
)
both("atomic_groups", "SELECT conv_id, turn, CAST(SUM(CASE WHEN role = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS group_id FROM {conversations}")
SIZE = "octet_length({x}) + 16"
HALF = """WITH o AS (SELECT conv_id, turn, CAST(SUM({SIZE}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far, CAST(SUM({SIZE}) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM {conversations}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY ABS(2 * so_far - total), turn) AS k FROM o) SELECT conv_id, turn AS boundary, so_far, total FROM r WHERE k = 1"""
both("half_split", HALF.replace("{SIZE}", "octet_length(text) + 16"), HALF.replace("{SIZE}", "strlen(text) + 16"))
BUDGET = "SELECT conv_id, CAST(SUM({SIZE}) AS BIGINT) AS cost FROM {conversations} GROUP BY conv_id HAVING SUM({SIZE}) > 1024"
both("prefix_budget", BUDGET.replace("{SIZE}", "octet_length(text) + 16"), BUDGET.replace("{SIZE}", "strlen(text) + 16"))
both("expand_examples", "SELECT conv_id, turn, k - 1 AS prefix FROM (SELECT conv_id, turn, role, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS k FROM {conversations}) WHERE role = 'assistant'")
STATS = "SELECT role, COUNT(*) AS examples, CAST(SUM({SIZE}) AS BIGINT) AS tokens, CAST(MAX({SIZE}) AS BIGINT) AS longest FROM {conversations} GROUP BY role"
both("encoding_stats", STATS.replace("{SIZE}", "octet_length(text) + 16"), STATS.replace("{SIZE}", "strlen(text) + 16"))
