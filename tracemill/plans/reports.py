"""Filters, groups, pivots, ranks and statistics over the driver tables, in SQL that both engines read."""

from ..functions.expressions import at, cumulated, gcd
from .catalogue import both

# sums, extremes and filters
both("revenue_total", "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4)) AS revenue FROM {lineitem}")
both("average_price", "SELECT ROUND(CAST(SUM(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*), 4) AS average_price FROM {part}")
both("below_stock", "SELECT p_partkey, p_size FROM {part} WHERE p_size < 10")
both("team_max", "SELECT c_mktsegment, GREATEST(MAX(c_acctbal), 0.0) AS highest FROM {customer} GROUP BY c_mktsegment")
both("top_value", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
both("category_count", "SELECT COUNT(DISTINCT p_brand) AS categories FROM {part}")
both("threshold_count", "SELECT CONCAT('There are ', CAST(COUNT(*) AS VARCHAR(20)), ' lines with a quantity of 25 or more.') AS sentence FROM {lineitem} WHERE l_quantity >= 25")
both("reverse_order", "SELECT n_nationkey, n_name, CAST(ROW_NUMBER() OVER (ORDER BY n_nationkey DESC) AS BIGINT) AS place FROM {nation}")
both("boolean_tally", "SELECT CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS answer, COUNT(*) AS n FROM {labels} GROUP BY 1")
both("level_counts", "SELECT COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(*) FILTER (WHERE event_type = 'signup') AS signups, COUNT(*) AS n FROM {events}")
both("score_order", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
both("decimal_group_totals", "SELECT o_orderpriority, CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS VARCHAR(40)) AS total FROM {orders} GROUP BY 1")
both("filter_sort", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
both("left_join", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
both("pivot_counts", """SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
COUNT(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium, COUNT(*) FILTER (WHERE o_orderpriority LIKE '4%') AS unstated, COUNT(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM {orders} GROUP BY o_orderstatus""")
both("json_group_totals", "SELECT event_type, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM {events} GROUP BY event_type")
both("props_project", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
both(
    "missing_fields",
    "SELECT event_id, array_join(array_sort(array_except(array('k', 'score', 'user'), json_object_keys(props))), ',') AS missing FROM {events}",
    "SELECT event_id, array_to_string(list_sort(list_filter(['k', 'score', 'user'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing FROM events",
)
both(
    "defaults_overlay",
    "SELECT event_id, CAST(COALESCE(get_json_object(props, '$.k'), '0') AS BIGINT) AS k, COALESCE(get_json_object(props, '$.mode'), 'plain') AS mode FROM {events}",
    "SELECT event_id, CAST(COALESCE(json_extract_string(props, '$.k'), '0') AS BIGINT) AS k, COALESCE(json_extract_string(props, '$.mode'), 'plain') AS mode FROM events",
)
both(
    "nested_totals",
    "SELECT vec_id, CAST(SUM(CAST(x AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS total FROM {embeddings} LATERAL VIEW explode(embedding) t AS x GROUP BY vec_id",
    "SELECT vec_id, CAST(SUM(CAST(x AS DECIMAL(18,8))) AS DECIMAL(28,8)) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id",
)
# statistics
both("weighted_score", "SELECT ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(6,0))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(6,0))) AS DOUBLE), 3) AS weighted FROM {lineitem}")
def both_div(name: str, sql: str) -> None:
    """`//` is whole division, `div` in Spark."""
    both(name, sql.replace("//", "div"), sql)


# the quartiles are the medians of the halves, without the middle row of an odd number
both_div(
    "median_spread",
    f"""WITH {cumulated("c", "p_brand", "p_size", "{part}")}, m AS (SELECT p_brand, n, n // 2 AS h, {{MIDDLE}} FROM c GROUP BY p_brand, n)
SELECT p_brand, median, spread, CAST(((q3a + q3b) - (q1a + q1b)) AS DOUBLE) / 2 AS middle FROM m""".replace(
        "{MIDDLE}",
        f"CAST({at('(n + 1) // 2')} + {at('n // 2 + 1')} AS DOUBLE) / 2 AS median, CAST(MAX(v) - MIN(v) AS BIGINT) AS spread, {at('(n // 2 + 1) // 2')} AS q1a, {at('n // 2 // 2 + 1')} AS q1b, "
        f"{at('(n + 1) // 2 + (n // 2 + 1) // 2')} AS q3a, {at('(n + 1) // 2 + n // 2 // 2 + 1')} AS q3b",
    ),
)
both("harmonic_mean", "SELECT ROUND(COUNT(*) / CAST(SUM(CAST(1 / l_quantity AS DECIMAL(20,12))) AS DOUBLE), 2) AS harmonic FROM {lineitem} WHERE l_quantity > 0")
both("correlation", "SELECT ROUND(CORR(l_quantity, l_extendedprice), 4) AS r FROM {lineitem}")
RANKED = "SELECT COUNT(*) FILTER (WHERE p_size <= 25) AS n, COUNT(*) AS d FROM {part}"
both(
    "percentile_rank",
    f"SELECT n div g AS numerator, d div g AS denominator FROM (SELECT n, d, {gcd('n', 'd')} AS g FROM ({RANKED}))",
    f"SELECT n // gcd(n, d) AS numerator, d // gcd(n, d) AS denominator FROM ({RANKED})",
)
QUANT = "SELECT l_returnflag, CAST(CAST(SUM(CAST(l_quantity AS DECIMAL(12,0))) AS DECIMAL(22,0)) AS BIGINT) AS n FROM {lineitem} GROUP BY l_returnflag"
# percent of the largest, halves to the even number
both_div("scaled_bars", f"""WITH t AS ({QUANT}), p AS (SELECT l_returnflag, n, 100 * n AS a, MAX(n) OVER () AS m FROM t)
SELECT l_returnflag, n, a // m + CASE WHEN 2 * (a % m) > m OR (2 * (a % m) = m AND (a // m) % 2 = 1) THEN 1 ELSE 0 END AS scaled FROM p""")
both("rank_bars", "WITH t AS (SELECT event_type, COUNT(*) AS n FROM {events} GROUP BY event_type) SELECT event_type, n, CAST(RANK() OVER (ORDER BY n DESC, event_type) AS BIGINT) AS place FROM t")
both("bucket_bars", "SELECT CASE WHEN 2 * l_quantity <= 33 THEN 'low' WHEN 2 * l_quantity <= 66 THEN 'middle' ELSE 'high' END AS band, COUNT(*) AS n FROM {lineitem} GROUP BY 1")
# before and after are the first and the second half of the year
both("delta_bars", """SELECT l_returnflag, ABS(n_after - n_before) AS delta, n_before, n_after FROM (SELECT l_returnflag, COUNT(*) FILTER (WHERE MONTH(l_shipdate) <= 6) AS n_before,
COUNT(*) FILTER (WHERE MONTH(l_shipdate) > 6) AS n_after FROM {lineitem} GROUP BY l_returnflag)""")
both(
    "split_cents",
    """WITH t AS (SELECT n_regionkey, COUNT(*) AS w FROM {nation} GROUP BY n_regionkey), s AS (SELECT n_regionkey, w, 10003 * w AS part, SUM(w) OVER () AS total FROM t),
f AS (SELECT n_regionkey, CAST(FLOOR(part / total) AS BIGINT) AS base, part % total AS rest FROM s), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rest DESC, n_regionkey) AS place, 10003 - SUM(base) OVER () AS spare FROM f)
SELECT CAST(n_regionkey AS BIGINT) AS region, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS cents FROM r""",
)
both(
    "bounded_sums",
    "WITH d AS (SELECT explode(sequence(0, 20)) AS v) SELECT COUNT(*) AS ways FROM d a JOIN d b ON a.v + b.v <= 30 JOIN d c ON a.v + b.v + c.v = 30",
    "WITH d AS (SELECT unnest(range(0, 21)) AS v) SELECT COUNT(*) AS ways FROM d a JOIN d b ON a.v + b.v <= 30 JOIN d c ON a.v + b.v + c.v = 30",
)
# distributions and grouping sets
both_div("length_distribution", f"WITH {cumulated('c', 'lang', 'n_chars', '{documents}')} SELECT lang, MIN(v) AS least, {at('n // 2 + 1')} AS middle, {at('(95 * n + 99) // 100')} AS p95, MAX(v) AS most FROM c GROUP BY lang")
both_div("length_alternative", f"WITH {cumulated('c', 'lang', 'n_chars', '{documents}')} SELECT lang, CAST({at('(n + 1) // 2')} + {at('n // 2 + 1')} AS DOUBLE) / 2 AS median, {at('(n - 1) * 95 // 100 + 1')} AS p95 FROM c GROUP BY lang")
both_div("median_price", f"WITH {cumulated('c', '1', 'p_retailprice', '{part}')} SELECT ({at('(n + 1) // 2')} + {at('n // 2 + 1')}) / 2 AS median_price FROM c")
both("grouping_report", "SELECT d.lang, d.source, COUNT(*) AS n, COUNT(l.doc_id) AS labelled, CAST(SUM(n_chars) AS BIGINT) AS chars FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((d.lang, d.source), (d.lang), (d.source), ())")
both("macro_average", "WITH m AS (SELECT lang, AVG(CAST(quality AS DOUBLE)) AS mean FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY lang) SELECT ROUND(AVG(mean), 10) AS macro, ROUND(MIN(mean), 10) AS worst, COUNT(*) AS families FROM m")
both("source_counts", "SELECT source, COUNT(*) AS observed, COUNT(*) FILTER (WHERE toxic = 1) AS failed, COUNT(*) - COUNT(DISTINCT md5(text)) AS duplicates, COUNT(*) FILTER (WHERE quality = 1 AND toxic = 0) AS admitted FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source")
both(
    "task_audit",
    "SELECT source, COUNT(*) AS n, array_join(array_sort(collect_set(lang)), ',') AS families FROM {documents} GROUP BY source",
    "SELECT source, COUNT(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS families FROM documents GROUP BY source",
)
both("family_split", "SELECT CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'de' THEN 'dev' ELSE 'test' END AS split, lang, COUNT(*) AS n FROM {documents} GROUP BY 1, 2")
both("pairing_check", "SELECT user_id, COUNT(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id HAVING COUNT(DISTINCT event_type) < 5")
both("latest_two_plus_best", """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recent, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS best FROM {orders})
SELECT o_custkey, o_orderkey, CASE WHEN recent <= 2 THEN 'recent' ELSE 'best' END AS why FROM r WHERE recent <= 2 OR best = 1""")
both("every_other", "WITH r AS (SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM {documents}) SELECT doc_id, lang FROM r WHERE k % 2 = 1")
both("inventory_diff", "SELECT doc_id, 'unlabelled' AS side FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) UNION ALL SELECT doc_id, 'unknown' AS side FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents})")
