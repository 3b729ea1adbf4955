"""Order-dependent operators over the event journal, key-value state, chains, greedy selection and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import fold_chain
from ..operators.fold import running_count, stretched
from ..operators.select import greedy_two_keys
from ..streaming.journal import run_stream
from .catalogue import both, query, table

OVER = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
# a journal as it is stored: each row has a number, its hash and the hash before it. Every 97th event was altered after
# its hash was made, every 89th is missing. Verification compares neighbours only and is as parallel as the users are.
STORED = """WITH j AS (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {SHA}(CONCAT(CAST(event_id AS VARCHAR(20)), '|', event_type, '|', props)) AS own FROM {events}),
l AS (SELECT *, LAG(own, 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM j),
s AS (SELECT l.user_id, l.event_id, seq, own, previous, {SHA}(CONCAT(CAST(e.event_id AS VARCHAR(20)), '|', CASE WHEN e.event_id % 97 = 0 THEN 'altered' ELSE event_type END, '|', props)) AS found FROM l JOIN {events} e ON l.event_id = e.event_id WHERE l.event_id % 89 <> 0)
SELECT event_id, CASE WHEN own <> found THEN 'altered' WHEN seq <> ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 THEN 'number' WHEN previous <> LAG(own, 1, repeat('0', 64)) OVER (PARTITION BY user_id ORDER BY event_id) THEN 'link' ELSE 'ok' END AS state FROM s"""
both("chain_verify", STORED.replace("{SHA}(", "sha2(").replace(", props)) AS own", ", props), 256) AS own").replace(", props)) AS found", ", props), 256) AS found").replace("'|', props)) AS", "'|', props), 256) AS"), STORED.replace("{SHA}", "sha256"))
both("running_balance", f"SELECT event_id, user_id, CAST(SUM(CAST(value AS DECIMAL(18,4))) {OVER} AS DECIMAL(28,4)) AS balance FROM {{events}}")
# the first and the last status with an amount of 10 or more, null for users without one: extremes combine before a shuffle
for which, extreme, direction in (("first", "min_by", ""), ("latest", "max_by", " DESC")):
    both(
        f"{which}_status",
        f"SELECT user_id, {extreme}(event_type, event_id) FILTER (WHERE value >= 10) AS status FROM {{events}} GROUP BY user_id",
        f"SELECT user_id, status FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, event_type AS status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id{direction}) AS k FROM events WHERE value >= 10) WHERE k = 1) USING (user_id)",
    )
both("status_changes", "SELECT user_id, COUNT(*) FILTER (WHERE event_type <> before) AS changes FROM (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events}) GROUP BY user_id")
both("amount_range", "SELECT user_id, CAST(MAX(CAST(value AS DECIMAL(18,4))) - MIN(CAST(value AS DECIMAL(18,4))) AS DECIMAL(20,4)) AS spread FROM {events} GROUP BY user_id")
both("threshold_events", "SELECT user_id, COUNT(*) FILTER (WHERE value >= 10) AS n FROM {events} GROUP BY user_id")
both("threshold", f"SELECT user_id, MIN(event_id) AS event_id FROM (SELECT user_id, event_id, SUM(CAST(value AS DECIMAL(18,4))) {OVER} AS so_far FROM {{events}}) WHERE so_far >= 100 GROUP BY user_id")
both("first_error_context", """WITH o AS (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM {events}),
e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM o WHERE event_type = 'error') SELECT user_id, event_id, before, after FROM e WHERE k = 1""")
# the journal as operations on a store: an error deletes the user's key, anything else sets it
LAST = "SELECT user_id, event_type, max_by(value, event_id) AS value FROM {events} GROUP BY user_id, event_type"
DUCK_LAST = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1"
KV_LATEST, KV_PREFIX = "SELECT user_id, event_type AS name, value FROM ({L})", "SELECT event_type AS prefix, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total, COUNT(*) AS names FROM ({L}) GROUP BY event_type"
both("kv_latest", KV_LATEST.replace("{L}", LAST), KV_LATEST.replace("{L}", DUCK_LAST))
both("kv_prefix", KV_PREFIX.replace("{L}", LAST), KV_PREFIX.replace("{L}", DUCK_LAST))
both(
    "kv_delete",
    "SELECT user_id, last.value AS value FROM (SELECT user_id, max_by(struct(event_type, value), event_id) AS last FROM {events} GROUP BY user_id) WHERE last.event_type <> 'error'",
    "SELECT user_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'",
)
both("kv_counter", f"SELECT event_id, user_id, CAST(COUNT(*) {OVER} AS BIGINT) AS counter FROM {{events}}")
# each customer's orders point to the next one: a window numbers what a walk would visit
IN_CHAIN = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
both(
    "linked_chain",
    f"SELECT head, CAST(MAX(k) AS BIGINT) AS links FROM (SELECT FIRST_VALUE(o_orderkey) {IN_CHAIN} AS head, ROW_NUMBER() {IN_CHAIN} AS k FROM {{orders}}) GROUP BY head",
    """WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderkey, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
walk(head, next_key, depth) AS (SELECT o_orderkey, next_key, 1 FROM o WHERE k = 1 UNION ALL SELECT w.head, o.next_key, w.depth + 1 FROM walk w JOIN o ON o.o_orderkey = w.next_key)
SELECT head, CAST(MAX(depth) AS BIGINT) AS links FROM walk GROUP BY head""",
)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, concat_ws('|', event_type, CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), props) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w(user_id, n_rows, head) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), '' FROM e UNION ALL SELECT w.user_id, k, sha256(head || '|' || payload) FROM w JOIN e ON e.user_id = w.user_id AND k = n_rows + 1)
SELECT user_id, max(n_rows) AS n_rows, max_by(head, n_rows) AS head FROM w GROUP BY user_id""")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return fold_chain(events, "user_id", "event_id", F.concat_ws("|", "event_type", F.col("value").cast("decimal(18,4)").cast("string"), "props"))


@query("""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source || '/' || n_chars AS identity, md5(text) AS fingerprint, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
w(k, doc_id, used_a, used_b, ok) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false UNION ALL
SELECT d.k, d.doc_id, CASE WHEN f THEN list_append(used_a, identity) ELSE used_a END, CASE WHEN f THEN list_append(used_b, fingerprint) ELSE used_b END, f
FROM (SELECT w.k AS last, used_a, used_b, d.*, NOT list_contains(used_a, identity) AND NOT list_contains(used_b, fingerprint) AS f FROM w JOIN d ON d.k = w.k + 1) d)
SELECT doc_id, identity, fingerprint FROM w JOIN d USING (doc_id) WHERE ok""")
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("identity"), F.md5("text").alias("fingerprint"))
    return greedy_two_keys(docs, "doc_id", "identity", "fingerprint")


@query("SELECT s_name, ROW_NUMBER() OVER (ORDER BY s_name, s_suppkey) AS place FROM supplier")
def name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order of names: ranges of names are sorted apart, and their counts give the offsets."""
    rows = table(spark, sf_dir, "supplier").select(F.lit(0).alias("all"), "s_name", "s_suppkey")
    placed = running_count(stretched(rows, "all", ["s_name", "s_suppkey"]), "all", ["s_name", "s_suppkey"], F.lit(True), "before")
    return placed.select("s_name", (F.col("before") + 1).alias("place"))


@query("SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents")
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in its language's export, sorted by id; a language of any size lies in many ranges."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    placed = running_count(stretched(rows, "lang", ["doc_id"]), "lang", ["doc_id"], F.lit(True), "before")
    return placed.select("doc_id", "lang", (F.col("before") + 1).alias("place"))


@query("SELECT page_id, CAST(contains(lower(html), '<html') AND contains(lower(html), '</html>') AS BOOLEAN) AS closed, CAST(contains(lower(html), '<script') AS BOOLEAN) AS scripted FROM pages")
def svg_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", (low.contains("<html") & low.contains("</html>")).alias("closed"), low.contains("<script").alias("scripted"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS VARCHAR) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plan(events: DataFrame) -> DataFrame:
        late = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
        return late.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    out = run_stream(spark, f"{sf_dir}/events*.parquet", plan)
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query("SELECT user_id, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def stream_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plan(events: DataFrame) -> DataFrame:
        return events.groupBy("user_id").agg(F.max(F.struct("event_id", "value")).alias("last"))

    return run_stream(spark, f"{sf_dir}/events*.parquet", plan).select("user_id", "last.event_id", "last.value")
