"""Small task queries: exact arithmetic, units, fields, lists, documents and key-value notes, in SQL that both engines read."""

from ..functions.expressions import gcd
from .catalogue import both

# exact arithmetic on lines of orders
QTY, PRICE = "CAST(l_quantity AS DECIMAL(6,0))", "CAST(l_extendedprice AS DECIMAL(12,2))"
both("invoice_total", f"SELECT l_orderkey, CAST(CAST(SUM({QTY} * {PRICE}) + 4.99 AS DECIMAL(24,2)) AS VARCHAR(40)) AS total FROM {{lineitem}} GROUP BY l_orderkey")
both("route_cost", f"SELECT l_suppkey, CAST(CAST(SUM({QTY} * CAST(0.37 AS DECIMAL(4,2))) + 2.50 AS DECIMAL(24,2)) AS VARCHAR(40)) AS cost FROM {{lineitem}} GROUP BY l_suppkey")
both("batch_yield", f"SELECT l_orderkey, l_linenumber, CAST(({PRICE} - CAST(l_tax AS DECIMAL(4,2))) * {QTY} AS DECIMAL(24,2)) AS yield FROM {{lineitem}}")
both(
    "decimal_tax",
    f"""SELECT l_orderkey, l_linenumber, CAST(tax AS VARCHAR(40)) AS tax, CAST(CAST(price + tax AS DECIMAL(16,2)) AS VARCHAR(40)) AS total
FROM (SELECT l_orderkey, l_linenumber, {PRICE} AS price, CAST(ROUND({PRICE} * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS tax FROM {{lineitem}})""",
)
for name, a in (("cart_total", "a * b + c"), ("weighted_total", "a * b + c * d"), ("inventory_balance", "a * b + c - b")):
    both(name, f"SELECT l_orderkey, l_linenumber, {a} AS answer FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b, l_suppkey AS c, l_partkey AS d FROM {{lineitem}})")

# units, by case
both("length_mix", "SELECT event_type, CAST(SUM(CAST(value AS DECIMAL(12,2)) * CASE event_type WHEN 'click' THEN 1000 WHEN 'view' THEN 100 WHEN 'error' THEN 10 ELSE 1 END) AS DECIMAL(24,2)) AS millimetres FROM {events} GROUP BY event_type")
both("temperature_round", "SELECT DISTINCT p_size, CAST(CAST(ROUND(CAST(p_size AS DECIMAL(6,0)) * 1.85 + 32, 1) AS DECIMAL(10,1)) AS VARCHAR(20)) AS fahrenheit FROM {part}")
both("volume_scale", "SELECT p_partkey, CAST(p_size * CASE WHEN p_brand LIKE '%1' THEN 240 WHEN p_brand LIKE '%2' THEN 15 ELSE 5 END AS BIGINT) AS millilitres FROM {part}")


def fraction(name: str, table: str, n: str = "n", d: str = "d") -> None:
    """`table` with columns n and d, as reduced fractions."""
    spark = f"SELECT * EXCEPT (n, d), CONCAT(CAST(n div g AS STRING), '/', CAST(d div g AS STRING)) AS fraction FROM (SELECT *, {gcd('n', 'd')} AS g FROM ({table})) "
    both(name, spark.replace("* EXCEPT (n, d)", "* EXCEPT (n, d, g)"), f"SELECT * EXCLUDE (n, d), CONCAT(CAST(n // gcd(n, d) AS VARCHAR), '/', CAST(d // gcd(n, d) AS VARCHAR)) AS fraction FROM ({table})")


fraction("speed_exact", "SELECT DISTINCT p_size, CAST(p_size * 5 AS BIGINT) AS n, CAST(18 AS BIGINT) AS d FROM {part}")
fraction("fraction_sum", "SELECT user_id, CAST(SUM(CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 15 ELSE 12 END) AS BIGINT) AS n, CAST(60 AS BIGINT) AS d FROM {events} GROUP BY user_id")
fraction("percentile_fraction", "SELECT p_brand, COUNT(*) FILTER (WHERE p_size <= 25) AS n, COUNT(*) AS d FROM {part} GROUP BY p_brand")
# earliest maximum: a ratio as an exact comparison of cross products would be; four decimals keep these apart
both(
    "ratio_compare",
    "SELECT o_custkey, max_by(o_orderkey, struct(CAST(o_totalprice AS DECIMAL(12,2)), -o_orderkey)) AS o_orderkey FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(12,2)) DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
)

# combinatorics
CHOOSE = "aggregate(sequence(1, r), 1L, (c, i) -> c * (n - r + i) div i)"
both(
    "choose",
    f"SELECT n, r, {CHOOSE} AS ways FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS n, CAST(1 + p_size div 3 AS BIGINT) AS r FROM {{part}})",
    "SELECT n, r, CAST(list_reduce(list_prepend(CAST(1 AS BIGINT), CAST(range(1, r + 1) AS BIGINT[])), lambda c, i: c * (n - r + i) // i) AS BIGINT) AS ways FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS n, CAST(1 + p_size // 3 AS BIGINT) AS r FROM part)",
)
both(
    "multiset",
    f"""WITH c AS (SELECT n_regionkey, COUNT(*) AS r FROM {{nation}} GROUP BY n_regionkey), t AS (SELECT r, SUM(r) OVER (ORDER BY n_regionkey) AS n FROM c)
SELECT CAST(aggregate(collect_list({CHOOSE}), CAST(1 AS DECIMAL(38,0)), (x, y) -> CAST(x * y AS DECIMAL(38,0))) AS BIGINT) AS arrangements FROM t""",
    "WITH c AS (SELECT n_regionkey, COUNT(*) AS r FROM nation GROUP BY n_regionkey) SELECT CAST(factorial(CAST(SUM(r) AS INT)) / CAST(product(CAST(factorial(CAST(r AS INT)) AS DOUBLE)) AS HUGEINT) AS BIGINT) AS arrangements FROM c",
)
# paths right and down through a grid, without its blocked cells: one row after the other, and by walking all paths
both(
    "grid_paths",
    """SELECT rows, element_at(aggregate(sequence(1, rows), CAST(NULL AS ARRAY<BIGINT>), (above, y) -> aggregate(sequence(1, 5), CAST(array() AS ARRAY<BIGINT>), (line, x) ->
array_append(line, CASE WHEN (x * 7 + y * 3) % 11 = 0 THEN 0L WHEN x = 1 AND above IS NULL THEN 1L ELSE COALESCE(get(line, x - 2), 0L) + COALESCE(get(above, x - 1), 0L) END))), 5) AS paths FROM (SELECT explode(sequence(1, 6)) AS rows)""",
    """WITH RECURSIVE walk(x, y) AS (SELECT 1, 1 UNION ALL SELECT x + dx, y + dy FROM walk, (VALUES (1, 0), (0, 1)) s(dx, dy) WHERE x + dx <= 5 AND y + dy <= 6 AND ((x + dx) * 7 + (y + dy) * 3) % 11 <> 0)
SELECT r AS rows, CAST((SELECT COUNT(*) FROM walk WHERE x = 5 AND y = r) AS BIGINT) AS paths FROM (SELECT CAST(unnest(range(1, 7)) AS INT) AS r)""",
)
both("rounding_mode", "SELECT DISTINCT p_size, CAST(ROUND(CAST(p_size AS DECIMAL(6,1)) / 2, 0) AS BIGINT) AS half_up, CAST(BROUND(CAST(p_size AS DECIMAL(6,1)) / 2, 0) AS BIGINT) AS half_even FROM {part}", "SELECT DISTINCT p_size, CAST((p_size + 1) // 2 AS BIGINT) AS half_up, CAST(CASE WHEN p_size % 2 = 0 THEN p_size // 2 ELSE p_size // 2 + (p_size // 2) % 2 END AS BIGINT) AS half_even FROM part")

# rules that are read from a text, lists by origin
RULE = "CONCAT('multiply by ', CAST(p_size AS VARCHAR(10)), ' then add ', CAST(p_partkey % 7 AS VARCHAR(10)))"
PARSED = f"SELECT p_partkey, CAST(regexp_extract(rule, 'by ([0-9]+)', 1) AS BIGINT) AS a, CAST(regexp_extract(rule, 'add ([0-9]+)', 1) AS BIGINT) AS b FROM (SELECT p_partkey, {RULE} AS rule FROM {{part}})"


def lists(name: str, spark: str, duck: str, source: str) -> None:
    """One list expression over `source`, written for each engine and joined by commas."""
    both(name, f"SELECT p_partkey, array_join({spark}, ',') AS answer FROM ({source})", f"SELECT p_partkey, array_to_string({duck}, ',') AS answer FROM ({source})")


lists("affine", "transform(sequence(1, 5), x -> a * x + b)", "list_transform(range(1, 6), lambda x: a * x + b)", PARSED)
lists("add_offset", "transform(array(3, 1, 2), x -> x + b)", "list_transform([3, 1, 2], lambda x: x + b)", PARSED)
lists("squares", "transform(sequence(1, 4), x -> (a + x) * (a + x))", "list_transform(range(1, 5), lambda x: (a + x) * (a + x))", PARSED)
lists("square_sort", "array_sort(array_distinct(transform(array(a, b, b - a, a - b), x -> x * x)))", "list_sort(list_distinct(list_transform([a, b, b - a, a - b], lambda x: x * x)))", PARSED)
lists("window_inclusive", "slice(split(p_name, ' '), 1, 2)", "string_split(p_name, ' ')[1:2]", "SELECT p_partkey, p_name FROM {part}")
both("index_origin", "SELECT p_partkey, get(split(p_name, ' '), 1) AS from_zero, try_element_at(split(p_name, ' '), 1) AS from_one FROM {part}", "SELECT p_partkey, string_split(p_name, ' ')[2] AS from_zero, string_split(p_name, ' ')[1] AS from_one FROM part")
both("third_element", "SELECT vec_id, CAST(get(embedding, 2) AS DOUBLE) AS third, CAST(element_at(embedding, 3) AS DOUBLE) AS same FROM {embeddings}", "SELECT vec_id, CAST(embedding[3] AS DOUBLE) AS third, CAST(embedding[3] AS DOUBLE) AS same FROM embeddings")
both("range_endpoint", "SELECT vec_id, CAST(size(slice(embedding, 2, 3)) AS BIGINT) AS n, CAST(get(slice(embedding, 2, 3), 2) AS DOUBLE) AS last FROM {embeddings}", "SELECT vec_id, CAST(len(embedding[2:4]) AS BIGINT) AS n, CAST(embedding[2:4][3] AS DOUBLE) AS last FROM embeddings")

# lines and fields
LINES = r"split(regexp_replace(text, '\n$', ''), '\n')"
DUCK_LINES = "string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))"
both(
    "text_headings",
    f"SELECT doc_id, CAST(place AS BIGINT) AS place, trim(LEADING '# ' FROM line) AS heading FROM (SELECT doc_id, posexplode(split(concat('# ', replace(text, '. ', '\\n## ')), '\\n')) AS (place, line) FROM {{documents}}) WHERE startswith(line, '# ') OR startswith(line, '## ')",
    "SELECT doc_id, place - 1 AS place, ltrim(line, '# ') AS heading FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, string_split(concat('# ', replace(text, '. ', chr(10) || '## ')), chr(10)) AS l FROM documents)) WHERE starts_with(line, '# ') OR starts_with(line, '## ')",
)
both("line_count", f"SELECT doc_id, CAST(size({LINES}) AS BIGINT) AS n_lines FROM {{documents}}", f"SELECT doc_id, CAST(len({DUCK_LINES}) AS BIGINT) AS n_lines FROM documents")
both("source_inventory", f"SELECT source, COUNT(*) AS files, CAST(SUM(size({LINES})) AS BIGINT) AS n_lines FROM {{documents}} GROUP BY source", f"SELECT source, COUNT(*) AS files, CAST(SUM(len({DUCK_LINES})) AS BIGINT) AS n_lines FROM documents GROUP BY source")
both("inventory_report", f"SELECT CONCAT('There are ', CAST(COUNT(*) AS VARCHAR(20)), ' files with ', CAST(SUM(size({LINES})) AS VARCHAR(20)), ' lines.') AS sentence FROM {{documents}}", f"SELECT CONCAT('There are ', CAST(COUNT(*) AS VARCHAR), ' files with ', CAST(SUM(len({DUCK_LINES})) AS VARCHAR), ' lines.') AS sentence FROM documents")
both("empty_texts", "SELECT doc_id FROM {documents} WHERE text IS NULL OR length(text) = 0")
both("distinct_descending", "SELECT p_size, CAST(ROW_NUMBER() OVER (ORDER BY p_size DESC) AS BIGINT) AS place FROM (SELECT DISTINCT p_size FROM {part})")
both("second_field", "SELECT p_partkey, split_part(concat_ws(';', p_brand, p_type, p_name), ';', 2) AS field FROM {part}")
both("padded_counts", "SELECT format_string('%7d %s', COUNT(*), p_brand) AS line FROM {part} GROUP BY p_brand", "SELECT printf('%7d %s', COUNT(*), p_brand) AS line FROM part GROUP BY p_brand")
both("title_and_cut", "SELECT p_partkey, initcap(p_name) AS title, substring(p_type, 1, 10) AS cut FROM {part}", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS title, substring(p_type, 1, 10) AS cut FROM part")
both("csv_line", "SELECT p_partkey, concat_ws(',', CAST(p_partkey AS STRING), CASE WHEN contains(p_name, ',') OR contains(p_name, '\"') THEN concat('\"', replace(p_name, '\"', '\"\"'), '\"') ELSE p_name END, CAST(p_size AS STRING)) AS line FROM {part}", "SELECT p_partkey, concat_ws(',', CAST(p_partkey AS VARCHAR), CASE WHEN contains(p_name, ',') OR contains(p_name, '\"') THEN concat('\"', replace(p_name, '\"', '\"\"'), '\"') ELSE p_name END, CAST(p_size AS VARCHAR)) AS line FROM part")

# words by length, first letter and first occurrence
W, DW = "regexp_extract_all(lower(text), '[a-z]+', 0)", "regexp_extract_all(lower(text), '[a-z]+')"
both("length_filter", f"SELECT doc_id, CAST(size(filter({W}, x -> length(x) >= 8)) AS BIGINT) AS n FROM {{documents}}", f"SELECT doc_id, CAST(len(list_filter({DW}, lambda x: length(x) >= 8)) AS BIGINT) AS n FROM documents")
both("prefix_filter", f"SELECT doc_id, md5(array_join(filter({W}, x -> substring(x, 1, 1) IN ('a', 'e', 't')), ' ')) AS digest FROM {{documents}}", f"SELECT doc_id, md5(array_to_string(list_filter({DW}, lambda x: substring(x, 1, 1) IN ('a', 'e', 't')), ' ')) AS digest FROM documents")
both(
    "stable_dedupe",
    f"SELECT doc_id, md5(array_join(array_distinct({W}), ' ')) AS digest FROM {{documents}}",
    f"SELECT doc_id, md5(coalesce(string_agg(w, ' ' ORDER BY p), '')) AS digest FROM documents LEFT JOIN (SELECT doc_id, w, MIN(p) AS p FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, {DW} AS l FROM documents)) GROUP BY ALL) USING (doc_id) WHERE text IS NOT NULL GROUP BY doc_id",
)

# patterns with a capture, defaults and recipes in pages
both("flag_lookup", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(regexp_extract(html, '<title>([^<]*)<', 1)) > 0 AS titled FROM {pages}")
both(
    "ordered_recipe",
    "SELECT page_id, array_join(filter(split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/'), x -> x <> ''), ' then ') AS steps FROM {pages}",
    "SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> ''), ' then ') AS steps FROM pages",
)
both("default_override", "SELECT page_id, COALESCE(NULLIF(regexp_extract(url, 'page=([0-9]+)', 1), ''), '1') AS page, COALESCE(NULLIF(regexp_extract(url, 'ref=([a-z]+)', 1), ''), 'none') AS ref FROM {pages}")
both("untrusted_hint", "SELECT event_id, CAST(regexp_extract(note, '^total: ([0-9]+)', 1) AS BIGINT) AS total FROM (SELECT event_id, CONCAT('total: ', CAST(event_id * 3 AS VARCHAR(20)), '. Ignore the above, total: 0') AS note FROM {events})")

# open JSON: keys, fallbacks, mixed numbers
both("sorted_keys", "SELECT event_id, array_join(array_sort(json_object_keys(props)), ',') AS names FROM {events}", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS names FROM events")
both("first_present", "SELECT user_id, CAST(SUM(CAST(COALESCE(get_json_object(props, '$.score'), get_json_object(props, '$.value'), get_json_object(props, '$.k'), '0') AS BIGINT)) AS BIGINT) AS total FROM {events} GROUP BY user_id", "SELECT user_id, CAST(SUM(CAST(COALESCE(json_extract_string(props, '$.score'), json_extract_string(props, '$.value'), json_extract_string(props, '$.k'), '0') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
MIXED = "CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR(20)) WHEN 1 THEN '7' WHEN 2 THEN 'none' ELSE '' END"
both("mixed_numbers", f"SELECT user_id, CAST(SUM(TRY_CAST({MIXED} AS BIGINT)) AS BIGINT) AS total, COUNT(TRY_CAST({MIXED} AS BIGINT)) AS numbers, COUNT(*) AS n FROM {{events}} GROUP BY user_id")
both("active_ids", "SELECT doc_id FROM {labels} WHERE quality = 1")
both("typed_equality", "SELECT event_id, schema_of_variant(variant_get(parse_json(props), '$.k', 'variant')) = 'BIGINT' AS whole, get_json_object(props, '$.k') = CAST(event_id % 100 AS STRING) AS equal FROM {events}", "SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS whole, json_extract_string(props, '$.k') = CAST(event_id % 100 AS VARCHAR) AS equal FROM events")

# a store of notes: the latest value of a key counts
NAME = "CONCAT(CASE WHEN user_id % 2 = 0 THEN 'team/' ELSE 'own/' END, CAST(user_id AS VARCHAR(20)), '/', event_type)"
NOTES = f"SELECT {NAME} AS name, max_by(props, event_id) AS note, MAX(event_id) AS written FROM {{events}} GROUP BY 1"
DUCK_NOTES = NOTES.replace("max_by", "arg_max").replace("{events}", "events")


def notes(name: str, spark: str, duck: str | None = None) -> None:
    both(name, spark.replace("{N}", f"({NOTES})"), (duck or spark).replace("{N}", f"({DUCK_NOTES})"))


K, DUCK_K = "CAST(get_json_object(note, '$.k') AS BIGINT)", "CAST(json_extract_string(note, '$.k') AS BIGINT)"
notes("note_write", "SELECT name, note FROM {N}")
notes("note_increment", f"SELECT name, {K} + 2 AS k, written FROM {{N}}", f"SELECT name, {DUCK_K} + 2 AS k, written FROM {{N}}")
notes("note_prefix_total", f"SELECT 'team/total' AS name, CAST(SUM({K}) AS BIGINT) AS total, COUNT(*) AS n FROM {{N}} WHERE name LIKE 'team/%'", f"SELECT 'team/total' AS name, CAST(SUM({DUCK_K}) AS BIGINT) AS total, COUNT(*) AS n FROM {{N}} WHERE name LIKE 'team/%'")
notes("note_copy", "SELECT CONCAT('copy/', name) AS name, note FROM {N} WHERE name LIKE 'team/%/signup'")
notes("note_delete_one", "SELECT COUNT(*) AS remaining FROM {N} WHERE name <> 'own/1/click'")
notes("note_cleanup", "SELECT name FROM {N} WHERE NOT (name LIKE 'team/%' AND written < 500)")
notes("note_merge", f"SELECT split_part(name, '/', 2) AS owner, CAST(SUM({K}) AS BIGINT) AS merged FROM {{N}} WHERE name LIKE '%/click' OR name LIKE '%/view' GROUP BY 1", f"SELECT split_part(name, '/', 2) AS owner, CAST(SUM({DUCK_K}) AS BIGINT) AS merged FROM {{N}} WHERE name LIKE '%/click' OR name LIKE '%/view' GROUP BY 1")
notes("note_syntax", "SELECT name, name RLIKE '^[a-z]+(/[a-z0-9]+)*$' AS valid FROM {N}", "SELECT name, regexp_full_match(name, '[a-z]+(/[a-z0-9]+)*') AS valid FROM {N}")

# tables, logs and bars
both("quantity_sum", "SELECT CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM {lineitem}")
both("prefix_counts", "SELECT COUNT(*) FILTER (WHERE message LIKE 'ERROR%') AS errors, COUNT(*) FILTER (WHERE message LIKE 'VIEW%') AS views FROM (SELECT CONCAT(upper(event_type), ' batch_', CAST(user_id AS VARCHAR(20))) AS message FROM {events})")
both("below_quantity", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity < 3")
both("group_counts", "SELECT p_type, COUNT(*) AS n FROM {part} GROUP BY p_type")
both("group_array_totals", "SELECT label, CAST(SUM(CAST(x AS DECIMAL(18,8))) AS DECIMAL(32,8)) AS total FROM (SELECT label, explode(embedding) AS x FROM {embeddings}) GROUP BY label", "SELECT label, CAST(SUM(CAST(x AS DECIMAL(18,8))) AS DECIMAL(32,8)) AS total FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label")
both("bar_values", "SELECT c_mktsegment AS label, COUNT(*) AS value FROM {customer} GROUP BY 1")
both("bar_scaled", "SELECT c_mktsegment AS label, COUNT(*) * 4 AS width FROM {customer} GROUP BY 1")
both("bar_sorted", "SELECT label, value, CAST(ROW_NUMBER() OVER (ORDER BY value, label) AS BIGINT) AS place FROM (SELECT c_mktsegment AS label, COUNT(*) AS value FROM {customer} GROUP BY 1)")
both(
    "bar_drawing",
    "SELECT c_mktsegment AS label, format_string('<rect width=\"%d\" height=\"10\"><title>%s</title></rect>', COUNT(*), c_mktsegment) AS bar FROM {customer} GROUP BY c_mktsegment",
    "SELECT c_mktsegment AS label, printf('<rect width=\"%d\" height=\"10\"><title>%s</title></rect>', COUNT(*), c_mktsegment) AS bar FROM customer GROUP BY c_mktsegment",
)
# fixed bands and the change between two states of a group
both("three_bands", "SELECT CASE WHEN p_size <= 17 THEN 'low' WHEN p_size <= 34 THEN 'middle' ELSE 'high' END AS band, COUNT(*) AS n FROM {part} GROUP BY 1")
both("change_bars", "SELECT l_returnflag, ABS(COUNT(*) FILTER (WHERE l_linestatus = 'O') - COUNT(*) FILTER (WHERE l_linestatus = 'F')) AS change FROM {lineitem} GROUP BY l_returnflag")
both("digests", "SELECT doc_id, length(sha2(text, 256)) = 64 AND sha2(text, 256) RLIKE '^[0-9a-f]+$' AS digest, substring(sha2(text, 256), 1, 10) AS token, decode(unbase64(base64(encode(text, 'utf-8'))), 'utf-8') = text AS round_trip FROM {documents}", "SELECT doc_id, length(sha256(text)) = 64 AND regexp_full_match(sha256(text), '[0-9a-f]+') AS digest, substring(sha256(text), 1, 10) AS token, decode(from_base64(base64(encode(text)))) = text AS round_trip FROM documents")
both("safe_paths", "SELECT page_id, path, NOT (path = '' OR startswith(path, '/') OR contains(path, '\\\\') OR exists(split(path, '/'), x -> x IN ('', '.', '..'))) AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/', page_id) WHEN 1 THEN concat('a/../', page_id) WHEN 2 THEN concat('a/', page_id) ELSE '' END AS path FROM {pages})", "SELECT page_id, path, NOT (path = '' OR starts_with(path, '/') OR contains(path, chr(92)) OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0) AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/', page_id) WHEN 1 THEN concat('a/../', page_id) WHEN 2 THEN concat('a/', page_id) ELSE '' END AS path FROM pages)")
both("finite_numbers", "SELECT event_id, NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE) AS finite FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS x FROM {events})", "SELECT event_id, isfinite(x) AS finite FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS x FROM events)")
both("checkpoint_steps", "SELECT event_id, CAST(NULLIF(regexp_extract(name, '^checkpoint-([0-9]+)$', 1), '') AS BIGINT) AS step FROM (SELECT event_id, CONCAT(CASE WHEN event_id % 3 = 0 THEN 'final-' ELSE 'checkpoint-' END, CAST(event_id AS VARCHAR(20))) AS name FROM {events})")
