"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every window of 50 words, its smallest document, and the words that repeated windows cover.
SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM s),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN low USING (h) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit),
pos AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT pos.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Rules line by line, windows of five words by their text.
LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM again) GROUP BY rid),
l AS (SELECT rid, k, lines[k] AS line, translate(lines[k], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS solid FROM (SELECT rid, lines, unnest(generate_series(1, len(lines))) AS k FROM d)),
m AS (SELECT *, length(line) - length(solid) + 1 AS n, len(regexp_extract_all(line, '{rules._END_INSIDE}')) AS ends, len(regexp_extract_all(line, '{rules._NOISE}')) AS noise,
  upper(line) = line AND lower(line) <> line AND contains(line, '!!') AS shouted FROM l),
r AS (SELECT rid, k, line, length(solid) AS size, CASE WHEN solid = '' THEN NULL WHEN regexp_matches(lower(line), '{rules._BOILERPLATE}') THEN 'boilerplate' WHEN regexp_matches(line, '{rules._PARTS}') OR regexp_matches(line, '{rules._ELSEWHERE}') THEN 'navigation'
  WHEN NOT regexp_matches(line, '{rules._ENDED.replace("'", "''")}') AND ends * {rules._SENTENCE_WORDS} < n OR noise * 10 > n * 3 OR shouted THEN 'punctuation' END AS rule FROM m),
x AS (SELECT rid, coalesce(sum(size) FILTER (WHERE rule IS NOT NULL), 0) AS lost, count(*) FILTER (WHERE rule = 'punctuation') AS p, count(*) FILTER (WHERE rule = 'navigation') AS v, count(*) FILTER (WHERE rule = 'boilerplate') AS b,
  count(*) FILTER (WHERE size > 0) - count(DISTINCT line) FILTER (WHERE size > 0) AS dup, sum(size) AS chars, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE rule IS NULL), '') AS rest FROM r GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(w) AS base_failed, NOT (len(w) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(w)) AND lost <= {rules.MOST_LOST} * chars AS kept,
  CAST(lost AS BIGINT) AS lost_chars, p AS n_punctuation, v AS n_navigation, b AS n_boilerplate, sha256(rest) AS kept_sha256
FROM d JOIN x USING (rid) LEFT JOIN cov USING (rid)
"""

#: Kept terms, dense counts for every group, and every two groups compared term by term.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
gp AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_c JOIN v USING (lang)),
lp AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 10
"""


def _manifest(levels: int = 32, top: int = 12) -> str:
    """A CTE for each level of pairs, for the languages' trees and for the one over them; then every leaf's way up, level by level.

    CRC-32 bit by bit: each character of the id is followed by eight shifts.
    """
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n, 'text')))})"
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
    out = [
        f"d AS MATERIALIZED (SELECT coalesce('1' || lang, '0') AS tree, doc_id, {leaf('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS seen FROM documents)",
        "l0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS h, doc_id, seen FROM d)",
    ]

    def pairs(name: str, key: str, k: int) -> str:
        return f"{name}{k + 1} AS MATERIALIZED (SELECT {key}i // 2 AS i, (n + 1) // 2 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {key}i // 2, n)"

    def way(name: str, k: int, before: str, after: str, place: str, on: str) -> str:
        """seen and proof after one more level: siblings come from the node next to `place`."""
        x = f"CASE WHEN m.n = 1 THEN w.seen WHEN w.{place} % 2 = 1 THEN sha256(s.h || w.seen) ELSE sha256(w.seen || coalesce(s.h, '')) END"
        return f"{after} AS MATERIALIZED (SELECT w.* REPLACE ({x} AS seen, w.proof || coalesce(s.h, '') AS proof, w.{place} // 2 AS {place}) FROM {before} w JOIN {name}{k} m ON {on.format('m')} AND m.i = w.{place} LEFT JOIN {name}{k} s ON {on.format('s')} AND s.i = xor(w.{place}, 1))"

    out += [pairs("l", "tree, ", k) for k in range(levels)]
    out.append(f"t0 AS MATERIALIZED (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM l{levels})")
    out += [pairs("t", "", k) for k in range(top)]
    out.append("w0 AS MATERIALIZED (SELECT l0.tree, doc_id, l0.h AS leaf, seen, l0.i, t0.i AS j, t0.h AS subroot, '' AS proof FROM l0 JOIN t0 USING (tree))")
    out += [way("l", k, f"w{k}", f"w{k + 1}", "i", "{}.tree = w.tree") for k in range(levels)]
    out += [way("t", k, f"w{levels + k}", f"w{levels + k + 1}", "j", "true") for k in range(top)]
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, t{top}.h AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = t{top}.h AS verified FROM w{levels + top}, t{top}"


ORACLES = {"op9_substring_dedup": SUBSTRING, "op11_merkle_manifest": _manifest(), "op12_line_rules": LINES, "op13_source_divergence": DIVERGENCE}
