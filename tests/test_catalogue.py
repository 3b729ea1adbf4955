"""Every catalogue query against its DuckDB oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracemill.plans import audit, catalogue, contexts, contracts, families, ordered, reports, sharded, stored, texts, training  # noqa: F401

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(SF))
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(r) for r in duck.sql(f"SELECT {quoted} FROM ({catalogue.ORACLES[name]})").fetchall())


def test_greedy_leaves_no_trace_of_rejected_rows(spark):
    from tracemill.operators.select import greedy_two_keys

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], "o int, a string, b string")
    assert sorted(r.o for r in greedy_two_keys(rows, "o", "a", "b").collect()) == [1, 3]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_equals_a_walk(spark, seed):
    import random

    from tracemill.operators.select import greedy_two_keys

    r = random.Random(seed)
    n = (40, 150, 150, 400)[seed]
    keys = (n, n // 2, 6, n)[seed]
    made = [(i, None if r.random() < 0.03 else f"a{r.randrange(keys)}", f"b{r.randrange(keys)}") for i in range(n)]
    used_a, used_b, want = set(), set(), []
    for i, a, b in made:
        if a is not None and a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append(i)
    r.shuffle(made)
    assert sorted(x.o for x in greedy_two_keys(spark.createDataFrame(made, "o int, a string, b string"), "o", "a", "b").collect()) == want


def test_greedy_along_a_path_of_conflicts_takes_few_tables(spark, monkeypatch):
    from tracemill.operators import select

    made = []
    monkeypatch.setattr(select, "written", lambda df, name, write=select.written: made.append(name) or write(df, name))
    path = spark.range(100_000).selectExpr("id AS o", "id div 2 AS a", "(id + 1) div 2 AS b")
    got = select.greedy_two_keys(path, "o", "a", "b")
    assert got.count() == 50_000 and got.where("o % 2 = 1").isEmpty() and len(made) < 30


def test_chain_matches_a_fold(spark):
    import hashlib

    from pyspark.sql import functions as F

    from tracemill.operators.chain import fold_chain

    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, o int, p string")
    link = ""
    for p in "ab":
        link = hashlib.sha256(f"{link}|{p}".encode()).hexdigest()
    assert fold_chain(rows, "k", "o", F.col("p")).first()["head"] == link


def test_chains_of_all_customers_equal_a_walk(spark, duck):
    orders = duck.sql("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2").fetchall()
    after = {a[1]: b[1] for a, b in zip(orders, orders[1:]) if a[0] == b[0]}
    want = {}
    for head in {k for _, k in orders} - set(after.values()):
        at, want[head] = head, 1
        while at in after:
            at, want[head] = after[at], want[head] + 1
    got = {r["head"]: r["links"] for r in catalogue.QUERIES["linked_chain"](spark, str(SF)).collect()}
    assert got == want and sum(got.values()) == len(orders)


def test_both_ways_of_searching_agree(spark):
    from tracemill.operators.retrieval import top_matches

    docs, asked = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one, other = (sorted(map(tuple, top_matches(docs, asked, 3, most_bytes=n).select("item_id", "doc_id", "score", "place").collect())) for n in (1 << 30, 0))
    assert one == other and len(one) > 0


def test_streams_in_many_batches_equal_one(spark, duck, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_journal", "stream_kv"):
        got, want = (catalogue.QUERIES[name](spark, d) for d in (str(tmp_path), str(SF)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
