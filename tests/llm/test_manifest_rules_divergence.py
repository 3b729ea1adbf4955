"""Operators 11 to 13 against brute force and their SQL: nulls, repeats, ties, empty tables, clashing columns, long texts."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import divergence, manifest, oracles, rules
from tracemill.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, part string, item string, lines string, failed string, n_words string"
MENU = "Home | About | Contact"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000)) + "."
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from it.", None, "", " \t\n ", "one", LONG, f"{MENU}\nThe quick brown fox jumps over the lazy dog, then sleeps.\nAll rights reserved.",
    f"{MENU}\n{MENU}\nshort words here\nA sentence that has more than enough words to stay where it is.", "a b c d e a b c d e a b c d e", "x x x x x x x x x x x x", "É ü 日本語 🙂 # $ % & | < > ok.\nÉ ü 日本語 🙂 # $ % & | < > ok.",
    "BUY NOW!! CHEAP!! HERE!! TODAY!! ONLY!! FOR!! YOU!! AND!! ME!! TOO!!", "The quick brown fox jumps over the lazy dog and runs away from it.", "word\x0bword\x0cword\rword Word WORD wörd ÄRGER ſ K",
]


def rows_of(n=60):
    r = random.Random(5)
    out = [(i, TEXTS[i % len(TEXTS)], r.choice(["en", "de", None, "", "zz"]), r.choice(["s1", "s2", None, "é"]), r.choice([None, 5, 77])) for i in range(n)]
    return [*out, out[3], out[3], (None, "no id", "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "t", "d", "p", "i", "l", "f", "n") for r in rows_of()], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows_of())
    return con


def same(got, duck, name):
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(map(repr, want.fetchall()))


def test_sql(docs, duck):
    same(manifest.merkle_manifest(docs), duck, "op11_merkle_manifest")
    same(rules.line_rules(docs), duck, "op12_line_rules")
    same(divergence.audit(docs), duck, "op13_source_divergence")


def test_empty_tables(docs):
    none = docs.limit(0)
    for out in (manifest.merkle_manifest(none), rules.line_rules(none), rules.clean(none), divergence.audit(none)):
        assert out.collect() == []


# 11


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_forests_merge_in_any_order(arity):
    r = random.Random(arity)
    for n in (1, 2, 3, 7, 26, 64):
        leaves = [digest(str(i)) for i in range(n)]
        parts = [manifest.Forest({"t": n}, arity) for _ in range(4)]
        for i, x in enumerate(leaves):
            r.choice(parts).add(("t", 0, i), x)
        a, b, c, d = parts
        copy = lambda f: manifest.Forest(dict(f.widths), arity).merge(f)
        one = copy(a).merge(b).merge(c).merge(d).open
        other = copy(d).merge(copy(b).merge(copy(c).merge(a))).open
        want = levels(leaves, arity)
        assert one == other == {("t", len(want) - 1, 0): want[-1][0]}


def test_a_stretch_of_leaves_leaves_few_nodes():
    forest = manifest.Forest({"t": 1 << 20})
    for i in range(1000, 9000):
        forest.add(("t", 0, i), digest(str(i)))
    assert len(forest.open) <= 2 * 13


@pytest.mark.parametrize(("arity", "leaves", "fan"), [(2, 4, 2), (2, 3, 3), (3, 5, 2), (4, 1000, 64)])
def test_manifest_in_many_parts(spark, arity, leaves, fan):
    sizes = {"1a": 37, "1b": 1, "0": 16, "1c": 2}
    rows = [(t, i, digest(t, str(i))) for t, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "tree string, id long, digest string").repartition(5)
    proofs, subroots, root = manifest.manifest(df, ["id"], Scratch(spark), arity, leaves, fan)
    trees = {t: levels([digest(t, str(i)) for i in range(n)], arity) for t, n in sizes.items()}
    top = levels([trees[t][-1][0] for t in sorted(trees)], arity)
    assert root == top[-1][0] and {r.tree: r.subroot for r in subroots.collect()} == {t: x[-1][0] for t, x in trees.items()}
    got = manifest.folded(proofs, "digest", "again", arity).collect()
    assert len(got) == len(rows) and {r.again for r in got} == {root}
    for r in got:
        want, at = [], r["id"]
        for nodes, i in ((trees[r.tree], at), (top, sorted(trees).index(r.tree))):
            for level in nodes[:-1]:
                first = i // arity * arity
                want += [x for k, x in enumerate(level[first : first + arity], first) if k != i]
                i //= arity
        assert r.siblings == "".join(want)
    wrong = manifest.folded(proofs.withColumn("x", F.sha2("digest", 256)), "x", "again", arity).collect()
    assert root not in {r.again for r in wrong}


def test_repeated_rows_do_not_meet_in_one_part(spark):
    df = spark.createDataFrame([("1x", 7, digest("x"))] * 400, "tree string, id long, digest string").repartition(8)
    scratch = Scratch(spark)
    rows = manifest.placed(scratch.save(df, "same"), ["id", "digest"], scratch, 50)
    counts = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert sum(counts) == 400 and max(counts) <= 150 and sorted(r["index"] for r in rows.collect()) == list(range(400))


def test_tampered_rows_are_found(docs):
    for r in manifest.merkle_manifest(docs).collect():
        row_has_number = next(x[4] for x in rows_of() if x[0] == r.doc_id) is not None
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and row_has_number
        assert r.verified == (not hit) == (r.folded_root == r.root)


# 12


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_rules_equal_brute_force(spark):
    r = random.Random(2)
    texts = [*TEXTS, *("".join(r.choice(["a", "b", "c", " ", " ", "\n", "é", "#", "🙂", "\t"]) for _ in range(r.randrange(400))) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in rules.line_rules(docs).collect():
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert got == counts(texts[row.doc_id]), texts[row.doc_id]
        assert row.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (row.base_failed and row.kept)


def test_lines_that_fail_go_and_others_stay(spark):
    good = "A sentence that has more than enough words to stay where it is."
    cut = "One whole sentence stands here, and it is long. The next one is cut off before"
    text = f"{MENU}\n{good}\nLog in\nhttps://example.org/a\n\nAll rights reserved.\n{cut}\nno end and no sense at all in this line of words\nWIN!! BIG!! NOW!!"
    docs = spark.createDataFrame([(1, text), (2, f"{MENU}\n" * 5 + "Home\n" * 30), (3, good)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in rules.clean(docs, 0.9).collect()}
    assert got == {1: f"{good}\n\n{cut}", 3: good}
    row = rules.line_rules(docs).where("doc_id = 1").first()
    assert (row.n_navigation, row.n_boilerplate, row.n_punctuation) == (3, 1, 2)


def test_clean_keeps_columns(docs):
    assert rules.clean(docs).columns == docs.columns and rules.clean(docs).count() > 0


def test_rules_run_without_python_or_shuffle(docs):
    plan = rules.line_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


# 13


def test_sketch_never_underestimates_and_small_ones_change_nothing(spark, duck):
    r = random.Random(3)
    rows = [(i, " ".join(f"t{chr(97 + r.randrange(20))}{chr(97 + min(r.randrange(26), r.randrange(26)))}" for _ in range(30)), r.choice("xy"), f"s{r.randrange(4)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(70)
    in_docs = collections.Counter((lang, t) for _, text, lang, _ in rows for t in set(text.split()))
    for width in (1 << 16, 1 << 20):
        bits = divergence.sketch(docs.select("lang", "text"), Scratch(spark), 25, width)
        terms = sorted(in_docs)
        for lang in "xy":
            mine = [t for x, t in terms if x == lang]
            ok = divergence.possible(bits, lang.encode(), [t.encode() for t in mine], width)
            assert all(ok[i] for i, t in enumerate(mine) if in_docs[lang, t] >= 25) and not all(ok)
    crowded = divergence.audit(docs, 25, width=1 << 16, depth=1).collect()
    assert sorted(map(tuple, crowded)) == sorted(map(tuple, divergence.audit(docs, 25).collect())) and any(r.part == "term" for r in crowded)


def test_saturated_counters_merge_as_sums(spark):
    import pyarrow as pa

    batch = divergence._sparse(0, np.array([0, 3, 9, *[0] * 70000, 7], np.uint32))
    twice = pa.Table.from_batches([batch, batch])
    first = twice.filter(pa.array([True, False, True, False]))
    merged = divergence._merged(first, 10)
    assert np.frombuffer(merged["at"][0].as_py(), "<u2").tolist() == [1, 2] and list(merged["n"][0].as_py()) == [6, 10]


def test_terms_are_runs_of_letters_and_non_ascii():
    text = "Hello, ÉTÉ_x2y—日本 K 🙂z\x00a\x7fb"
    want = [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))]
    assert divergence.terms_of(text.encode()) == want
