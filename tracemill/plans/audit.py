"""Joins with a stated cardinality, aggregates, order checks, leakage guards and row contracts over tasks made of the driver tables.

A document is a task (its language the family, its source the origin), its label an observation, a conversation a record of
turns, an event a journal row. Where the driver tables break no rule, rows are altered by a fixed rule, so that checks have
something to find.
"""

from .catalogue import both

SPLIT = "CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'de' THEN 'dev' ELSE 'test' END"
TASK = f"(SELECT doc_id AS task_id, lang AS family, source, {SPLIT} AS split, md5(text) AS input, n_chars, text FROM {{documents}})"
OBSERVED = "(SELECT doc_id AS task_id, quality = 1 AND toxic = 0 AS passed, quality, toxic FROM {labels})"

# joins whose cardinality is part of the answer
both(
    "observation_join",
    f"""SELECT t.split, COUNT(*) AS observed, COUNT(t.task_id) AS matched, COUNT(*) FILTER (WHERE t.task_id IS NULL) AS missing, COUNT(*) FILTER (WHERE passed) AS passed, MAX(k.n) AS most_builds
FROM {OBSERVED} o LEFT JOIN {TASK} t ON o.task_id = t.task_id LEFT JOIN (SELECT task_id, COUNT(*) AS n FROM {TASK} GROUP BY task_id) k ON k.task_id = o.task_id GROUP BY t.split""",
)
# rows by (file, position): what an index names and what there is, both ways
POSITION = "(SELECT doc_id, source AS file, ROW_NUMBER() OVER (PARTITION BY source, doc_id % 64 ORDER BY doc_id) AS place, doc_id % 64 AS block FROM {documents})"
both(
    "selection_index",
    f"""SELECT COALESCE(i.file, o.file) AS file, COUNT(i.doc_id) AS named, COUNT(o.doc_id) AS there, COUNT(*) FILTER (WHERE i.doc_id IS NULL) AS unnamed, COUNT(*) FILTER (WHERE o.doc_id IS NULL) AS lost, COUNT(*) FILTER (WHERE i.doc_id <> o.doc_id) AS other
FROM (SELECT * FROM {POSITION} WHERE doc_id % 7 <> 0) i FULL OUTER JOIN (SELECT * FROM {POSITION} WHERE doc_id % 11 <> 0) o ON i.file = o.file AND i.block = o.block AND i.place = o.place GROUP BY 1""",
)
both("frozen_rows", f"SELECT t.task_id, t.input = f.input AS same FROM {TASK} t JOIN (SELECT doc_id AS task_id, CASE WHEN doc_id % 13 = 0 THEN md5(lang) ELSE md5(text) END AS input FROM {{documents}}) f ON t.task_id = f.task_id")
NUMBERED = "(SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM {events} WHERE event_type = '%s')"
both("receipt_zip", f"SELECT r.user_id, r.place, r.event_id AS receipt, e.event_id AS event FROM {NUMBERED % 'signup'} r JOIN {NUMBERED % 'purchase'} e ON r.user_id = e.user_id AND r.place = e.place")
# calls and replies of a user share the key in props: a reply answers exactly one earlier call
CALLS = "SELECT user_id, {K} AS id, MIN(event_id) AS at, COUNT(*) AS n FROM {events} WHERE event_type = '%s' GROUP BY user_id, {K}"
LINKED = f"""SELECT COALESCE(c.user_id, r.user_id) AS user_id, COUNT(*) FILTER (WHERE c.n > 1) AS repeated_calls, COUNT(*) FILTER (WHERE r.n > 1) AS repeated_replies, COUNT(*) FILTER (WHERE c.id IS NULL) AS orphan_replies, COUNT(*) FILTER (WHERE r.at < c.at) AS early_replies,
COUNT(*) FILTER (WHERE r.id IS NULL) AS pending FROM ({CALLS % 'click'}) c FULL OUTER JOIN ({CALLS % 'view'}) r ON c.user_id = r.user_id AND c.id = r.id GROUP BY 1"""
both("call_linkage", LINKED.replace("{K}", "get_json_object(props, '$.k')"), LINKED.replace("{K}", "json_extract_string(props, '$.k')"))
# notes on turns: each names exactly one template, and replaces the text of its turn
NOTE = "(SELECT conv_id, turn, CONCAT('note ', CAST(turn AS VARCHAR(10))) AS note, turn % 3 AS template FROM {conversations} WHERE role = 'assistant' AND conv_id % 2 = 0)"
both("noted_turns", f"SELECT c.conv_id, c.turn, COALESCE(n.note, md5(c.text)) AS content FROM {{conversations}} c LEFT JOIN {NOTE} n ON c.conv_id = n.conv_id AND c.turn = n.turn")
both("note_templates", f"SELECT template, COUNT(*) AS notes, COUNT(DISTINCT conv_id) AS records, MIN(k) AS fewest, MAX(k) AS most FROM (SELECT template, conv_id, COUNT(*) OVER (PARTITION BY conv_id, turn) AS k FROM {NOTE}) GROUP BY template")
both("unused_templates", f"SELECT t.template, n.template IS NULL AS unused FROM (SELECT DISTINCT turn % 5 AS template FROM {{conversations}}) t LEFT JOIN (SELECT DISTINCT template FROM {NOTE}) n ON t.template = n.template")
both("noted_subset", f"SELECT COUNT(*) AS selected, COUNT(DISTINCT s.conv_id) AS records, COUNT(*) FILTER (WHERE n.conv_id IS NULL) AS without FROM (SELECT conv_id, turn FROM {{conversations}} WHERE role = 'assistant' AND conv_id % 4 = 0) s LEFT JOIN {NOTE} n ON s.conv_id = n.conv_id AND s.turn = n.turn")
both("evaluation_exclusions", "SELECT COUNT(*) AS hits FROM (SELECT md5(text) AS input FROM {documents}) d JOIN (SELECT DISTINCT md5(text) AS input FROM {benchmark}) b ON d.input = b.input")
both(
    "resume_missing",
    f"SELECT t.task_id FROM {TASK} t LEFT ANTI JOIN (SELECT l.doc_id, CASE WHEN l.doc_id % 17 = 0 THEN 'changed' ELSE md5(d.text) END AS input FROM {{labels}} l JOIN {{documents}} d ON l.doc_id = d.doc_id WHERE l.quality = 1) r ON t.task_id = r.doc_id AND t.input = r.input",
    f"SELECT t.task_id FROM {TASK} t ANTI JOIN (SELECT l.doc_id, CASE WHEN l.doc_id % 17 = 0 THEN 'changed' ELSE md5(d.text) END AS input FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality = 1) r ON t.task_id = r.doc_id AND t.input = r.input".replace("{documents}", "documents"),
)
FAN = "SELECT split, family, {E} AS seed FROM (SELECT DISTINCT split, family, CASE split WHEN 'train' THEN 5 WHEN 'dev' THEN 2 ELSE 1 END AS n FROM {T})"
both("family_seeds", FAN.replace("{E}", "explode(sequence(CAST(0 AS BIGINT), CAST(n - 1 AS BIGINT)))").replace("{T}", TASK), FAN.replace("{E}", "CAST(unnest(range(0, n)) AS BIGINT)").replace("{T}", TASK))
both("best_and_latest", "SELECT b.o_custkey, best, latest, best = latest AS same FROM (SELECT o_custkey, {MIN}(o_orderkey, o_totalprice) AS best FROM {orders} GROUP BY o_custkey) b JOIN (SELECT o_custkey, MAX(o_orderkey) AS latest FROM {orders} GROUP BY o_custkey) l ON b.o_custkey = l.o_custkey".replace("{MIN}", "min_by"), "SELECT b.o_custkey, best, latest, best = latest AS same FROM (SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey) b JOIN (SELECT o_custkey, MAX(o_orderkey) AS latest FROM orders GROUP BY o_custkey) l ON b.o_custkey = l.o_custkey")

# aggregates
both("admitted_by_split", f"SELECT t.source, COUNT(*) FILTER (WHERE split = 'train') AS train, COUNT(*) FILTER (WHERE split = 'dev') AS dev, COUNT(*) FILTER (WHERE split = 'test') AS test FROM {TASK} t JOIN {OBSERVED} o ON t.task_id = o.task_id WHERE passed GROUP BY t.source")
both("mode_counts", f"SELECT a.split, COUNT(*) FILTER (WHERE n_chars < 1000) AS n_short, COUNT(*) FILTER (WHERE n_chars BETWEEN 1000 AND 5000) AS n_middle, COUNT(*) FILTER (WHERE n_chars > 5000) AS n_long FROM (VALUES ('train'), ('dev'), ('test'), ('held')) a(split) LEFT JOIN {TASK} t ON a.split = t.split GROUP BY a.split")
# a journal of requests (click), responses (view) and failures (error): a failure is pending if the last of the others was a request
LAST = "MAX(CASE event_type WHEN 'click' THEN event_id * 2 + 1 WHEN 'view' THEN event_id * 2 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2"
both("attempt_log", f"SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS requests, COUNT(*) FILTER (WHERE event_type = 'view') AS responses, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(*) FILTER (WHERE event_type = 'error' AND last = 1) AS pending FROM (SELECT *, {LAST} AS last FROM {{events}}) GROUP BY user_id")
both("export_summary", f"SELECT split, COUNT(*) AS traces, COUNT(*) FILTER (WHERE passed) AS successes, COUNT(DISTINCT CASE WHEN passed THEN input END) AS tasks, COUNT(*) FILTER (WHERE passed IS NULL) AS incomplete FROM {TASK} t LEFT JOIN {OBSERVED} o ON t.task_id = o.task_id GROUP BY split")
both("histograms", "SELECT user_id % 10 AS bucket, event_type, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY user_id % 10) AS BIGINT) AS of FROM {events} GROUP BY 1, 2")
both("keep_sets", "SELECT keep, COUNT(*) AS n FROM (SELECT user_id, to_json(array_sort(collect_set(event_type))) AS keep FROM {events} WHERE value > 20 GROUP BY user_id) GROUP BY keep", "SELECT keep, COUNT(*) AS n FROM (SELECT user_id, CAST(to_json(list_sort(list(DISTINCT event_type))) AS VARCHAR) AS keep FROM events WHERE value > 20 GROUP BY user_id) GROUP BY keep")
both("mode_balance", "SELECT family, COUNT(DISTINCT n) = 1 AS balanced, MIN(n) AS least, MAX(n) AS most FROM (SELECT lang AS family, source, COUNT(*) AS n FROM {documents} GROUP BY lang, source) GROUP BY family")
both("duplicates_by_family", f"SELECT family, split, COUNT(*) AS n, CAST(SUM(k - 1) AS BIGINT) AS duplicates FROM (SELECT family, split, input, COUNT(*) AS k FROM {TASK} GROUP BY family, split, input) GROUP BY family, split")

both(
    "reject_reasons",
    "SELECT reason, lang, COUNT(*) AS n FROM (SELECT explode(filter(array(CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN text LIKE '%@%' THEN 'mail' END), x -> x IS NOT NULL)) AS reason, lang FROM {documents}) GROUP BY reason, lang",
    "SELECT reason, lang, COUNT(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN text LIKE '%@%' THEN 'mail' END], lambda x: x IS NOT NULL)) AS reason, lang FROM documents) GROUP BY reason, lang",
)
both("loss_at_step", "SELECT user_id, MIN(value) FILTER (WHERE event_id % 100 = 50) AS loss FROM {events} GROUP BY user_id")
both(
    "receipts_in_order",
    "SELECT user_id, event_type, MIN(event_id) AS first_seen, COUNT(*) AS calls, CAST(RANK() OVER (PARTITION BY user_id ORDER BY MIN(event_id)) AS BIGINT) AS place FROM {events} GROUP BY user_id, event_type",
)
both("bytes_by_source", "SELECT source, CAST(SUM({B}) AS BIGINT) AS n_bytes, COUNT(*) AS files FROM {documents} GROUP BY source".replace("{B}", "octet_length(text)"), "SELECT source, CAST(SUM(strlen(text)) AS BIGINT) AS n_bytes, COUNT(*) AS files FROM documents GROUP BY source")
# a file's logical hash: hashes of blocks of up to 1,000 rows in order, then of the blocks
PIECES = "(SELECT source, doc_id div 1000 AS block, md5(array_join(transform(array_sort(collect_list(struct(doc_id, md5(text) AS h))), x -> x.h), '')) AS h FROM {documents} GROUP BY source, doc_id div 1000)"
both("logical_hash", f"SELECT source, md5(array_join(transform(array_sort(collect_list(struct(block, h))), x -> x.h), '')) AS digest FROM {PIECES} GROUP BY source", "SELECT source, md5(string_agg(h, '' ORDER BY block)) AS digest FROM (SELECT source, doc_id // 1000 AS block, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) GROUP BY source")

# order checks
both("attempt_index", "SELECT user_id, COUNT(*) AS rows, COUNT(*) FILTER (WHERE stored <> k) AS broken FROM (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END AS stored FROM {events}) GROUP BY user_id")

IN_ROW = "OVER (PARTITION BY conv_id ORDER BY turn)"
both("prepared_order", f"SELECT conv_id, COUNT(*) FILTER (WHERE turn <> before + 1) AS gaps, COUNT(*) FILTER (WHERE turn <= before) AS unordered, MIN(turn) = 0 AS from_zero FROM (SELECT conv_id, turn, LAG(turn) {IN_ROW} AS before FROM {{conversations}} WHERE (conv_id * 31 + turn) % 19 <> 0) GROUP BY conv_id")
both("renamed_sequence", "SELECT user_id, md5(array_join(transform(array_sort(collect_list(struct(event_id, name))), x -> x.name), ',')) AS fingerprint FROM (SELECT user_id, event_id, CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY first_seen) AS STRING) AS name FROM (SELECT *, MIN(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen FROM {events})) GROUP BY user_id", "SELECT user_id, md5(string_agg(name, ',' ORDER BY event_id)) AS fingerprint FROM (SELECT user_id, event_id, CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY first_seen) AS VARCHAR) AS name FROM (SELECT *, MIN(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen FROM events)) GROUP BY user_id")

# leakage and uniqueness
both("task_uniqueness", f"SELECT COUNT(*) AS tasks, COUNT(*) - COUNT(DISTINCT task_id) AS repeated_ids, COUNT(*) - COUNT(DISTINCT input) AS repeated_inputs FROM {TASK}")
CROSS = "SELECT '{K}' AS name, COUNT(*) AS n, COUNT(*) FILTER (WHERE k > 1) AS crossing FROM (SELECT {K}, COUNT(DISTINCT split) AS k FROM {T} GROUP BY {K})"
both("split_disjointness", " UNION ALL ".join(CROSS.replace("{K}", k).replace("{T}", TASK) for k in ("task_id", "family", "source", "input")))
both("problem_identity", "SELECT problem, COUNT(*) AS attempts FROM (SELECT COALESCE(first_id, doc_id) AS problem FROM {documents} d LEFT JOIN (SELECT md5(text) AS input, MIN(doc_id) AS first_id FROM {documents} GROUP BY 1 HAVING COUNT(*) > 1) o ON md5(d.text) = o.input) GROUP BY problem")
both("component_guard", "SELECT input, COUNT(DISTINCT component) AS components FROM (SELECT md5(text) AS input, source AS component FROM {documents} UNION ALL SELECT md5(text) AS input, 'benchmark' AS component FROM {benchmark}) GROUP BY input HAVING COUNT(DISTINCT component) > 1")
both("family_intersections", f"SELECT a.split AS one, b.split AS other, COUNT(*) AS families FROM (SELECT DISTINCT split, source FROM {TASK}) a JOIN (SELECT DISTINCT split, source FROM {TASK}) b ON a.source = b.source AND a.split < b.split GROUP BY a.split, b.split")
both("collection_union", "SELECT component, COUNT(*) AS n, COUNT(DISTINCT input) AS inputs FROM (SELECT 'documents' AS component, md5(text) AS input FROM {documents} UNION ALL SELECT 'benchmark' AS component, md5(text) AS input FROM {benchmark} UNION ALL SELECT 'turns' AS component, md5(text) AS input FROM {conversations}) GROUP BY component")
both("search_audit", f"SELECT family, COUNT(DISTINCT split) AS splits, COUNT(*) AS tasks, COUNT(*) FILTER (WHERE n_chars <> length(text)) AS wrong FROM {TASK} GROUP BY family")

# row contracts: every violated rule of a row by name
CONTRACT = "SELECT task_id, {J} AS violations FROM (SELECT doc_id AS task_id, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE lang END AS family, source, CASE WHEN doc_id % 29 = 0 THEN 'exam' ELSE {S} END AS split, CASE WHEN doc_id % 31 = 0 THEN -1 ELSE n_chars END AS seed, CASE WHEN doc_id % 37 = 0 THEN md5(lang) ELSE md5(text) END AS stored, md5(text) AS input FROM {documents})".replace("{S}", SPLIT)
RULES = [("family", "family IS NULL OR family = ''"), ("split", "split NOT IN ('train', 'dev', 'test')"), ("seed", "seed < 0"), ("hash", "stored <> input")]
both(
    "task_contract",
    CONTRACT.replace("{J}", "array_join(filter(array(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES) + "), x -> x IS NOT NULL), ',')"),
    CONTRACT.replace("{J}", "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES) + "], lambda x: x IS NOT NULL), ',')").replace("{documents}", "documents"),
)
ARGUMENTS = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN CONCAT(chr(123), chr(125)) WHEN 1 THEN CONCAT(replace(props, chr(125), ''), ', \"x\": 1', chr(125)) WHEN 2 THEN CONCAT(chr(123), '\"k\": \"a\"', chr(125)) WHEN 3 THEN CONCAT(chr(123), '\"k\": -4', chr(125)) ELSE props END AS props FROM {events})"
ARGUMENT_RULES = "SELECT event_id, CASE WHEN {K} IS NULL THEN 'missing' WHEN {N} > 1 THEN 'unknown' WHEN TRY_CAST({K} AS BIGINT) IS NULL THEN 'type' WHEN TRY_CAST({K} AS BIGINT) NOT BETWEEN 0 AND 1000 THEN 'range' WHEN {B} > 64 THEN 'bytes' END AS violation FROM "
both(
    "argument_contract",
    ARGUMENT_RULES.replace("{K}", "get_json_object(props, '$.k')").replace("{N}", "size(json_object_keys(props))").replace("{B}", "octet_length(props)") + ARGUMENTS,
    ARGUMENT_RULES.replace("{K}", "json_extract_string(props, '$.k')").replace("{N}", "len(json_keys(props))").replace("{B}", "strlen(props)") + ARGUMENTS,
)
both("normalised_turns", "SELECT conv_id, turn, lower(trim(role)) AS role, COALESCE(md5(CASE WHEN turn % 5 = 0 THEN NULL ELSE text END), '') AS content FROM {conversations}")
both("trace_contract", f"SELECT t.task_id, CASE WHEN o.task_id IS NULL THEN 'unobserved' WHEN o.passed AND o.toxic = 1 THEN 'inconsistent' WHEN o.passed THEN 'success' ELSE 'failure' END AS status FROM {TASK} t LEFT JOIN {OBSERVED} o ON t.task_id = o.task_id")
both("adapters", "SELECT kind, id, size FROM (SELECT 'document' AS kind, doc_id AS id, n_chars AS size FROM {documents} UNION ALL SELECT 'item' AS kind, item_id AS id, CAST(length(text) AS BIGINT) AS size FROM {benchmark} UNION ALL SELECT 'page' AS kind, page_id AS id, CAST(length(html) AS BIGINT) AS size FROM {pages})")
both("light_rows", "SELECT doc_id, CONCAT(source, '/', CAST(doc_id AS VARCHAR(20))) AS reference, lang FROM {documents}")
both("action_packets", "SELECT conv_id, turn AS action, CAST(SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS prefix FROM {conversations} WHERE role <> 'system'")
both("failed_results", "SELECT event_id, event_type = 'error' OR value < 2 OR COALESCE(event_id % 50 = 0, FALSE) AS failed FROM {events}")
both("final_answers", "SELECT conv_id, regexp_extract(last, '([A-Za-z]+)', 1) AS answer FROM (SELECT conv_id, max_by(text, turn) AS last FROM {conversations} GROUP BY conv_id)", "SELECT conv_id, regexp_extract(last, '([A-Za-z]+)', 1) AS answer FROM (SELECT conv_id, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id)")
both("recomputed_answers", "SELECT c.c_custkey, COALESCE(n, 0) = COALESCE(m, 0) AS passed FROM {customer} c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey LEFT JOIN (SELECT o_custkey, COUNT(*) AS m FROM {orders} WHERE o_orderkey % 41 <> 0 GROUP BY o_custkey) b ON c.c_custkey = b.o_custkey")
both("planned_rows", "SELECT doc_id, 'planned' AS status, FALSE AS verified, CAST(NULL AS VARCHAR(10)) AS receipt FROM {documents}")
both("permitted_pages", "SELECT page_id FROM {pages} WHERE url LIKE 'https://%' AND url NOT LIKE '%#%' AND NOT contains(url, '..')")
both("sidecar_losses", "SELECT e.event_id, CASE WHEN s.loss IS NULL THEN e.value ELSE s.loss END AS loss, s.event_id IS NULL AS missing FROM {events} e LEFT JOIN (SELECT event_id, value / 2 AS loss FROM {events} WHERE event_type = 'view') s ON e.event_id = s.event_id")
both("unique_keys", "SELECT event_id, try_parse_json(raw) IS NOT NULL AS accepted FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CONCAT(chr(123), '\"k\": 1, \"k\": 2', chr(125)) ELSE props END AS raw FROM {events})", "SELECT event_id, len(json_keys(raw)) = len(list_distinct(json_keys(raw))) AS accepted FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CONCAT(chr(123), '\"k\": 1, \"k\": 2', chr(125)) ELSE props END AS raw FROM events)")
# the checkpoint to choose: the best worst family, then the best mean, among those that cover all families
both(
    "selection_key",
    "WITH f AS (SELECT source, lang, AVG(CAST(quality AS DOUBLE)) AS m FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source, lang), r AS (SELECT source, ROUND(MIN(m), 9) AS worst, ROUND(AVG(m), 9) AS mean, COUNT(*) AS families FROM f GROUP BY source) SELECT source, worst, mean, CAST(ROW_NUMBER() OVER (ORDER BY worst DESC, mean DESC, source) AS BIGINT) AS place FROM r WHERE families = (SELECT COUNT(DISTINCT lang) FROM {documents})",
)
both("best_active", "SELECT lang, max(struct(n_chars, doc_id)).doc_id AS doc_id FROM {documents} WHERE n_chars < 5000 GROUP BY lang", "SELECT lang, doc_id FROM (SELECT lang, doc_id, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS k FROM documents WHERE n_chars < 5000) WHERE k = 1")
