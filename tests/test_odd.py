"""Queries over documents without text, language or source, and texts that both splits have, against their SQL."""

import duckdb
import pytest

from tracemill.plans import catalogue, sharded, stored  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# (text, lang, source, n_chars); every document is labelled good and clean, but the last
ODD = [("a", "en", "s", 1), ("b", "de", "s", 1), ("a", "de", "t", 1), ("a", None, "t", 1), (None, "en", "s", None), (None, None, "s", 0), ("c", None, "s", 1), ("d", None, "s", 1), ("e", "en", None, 1), ("f", "fr", None, 1), ("g", "en", "u", 1), ("h", "de", "s", 1), (None, "fr", "s", None), ("b", "en", "s", 9)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, *r) for i, r in enumerate(ODD)], DOCS).coalesce(1).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(ODD) - 1), 0) for i in range(len(ODD))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{home}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{home}/{name}.parquet/*.parquet'")
    return str(home), con


@pytest.mark.parametrize("name", ["frozen_dataset", "sealed_selection", "collection_guards", "sealed_shards"])
def test_odd_documents(spark, odd, name):
    got, want = catalogue.QUERIES[name](spark, odd[0]), odd[1].sql(catalogue.ORACLES[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_two_hop_searches_once(spark):
    from tracemill.plans import texts

    plan = texts.two_hop(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "regexp_extract(" not in plan


def test_ids_are_made_after_rows_are_numbered(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracemill.sources import tokens

    rows = spark.createDataFrame([("train", i, 0, i) for i in range(9)], "split string, row_ordinal long, event int, x int")
    tokens.write_tokens(rows, f"{tmp_path}/t", lambda r: r.withColumn("input_ids", F.array("x")).withColumn("labels", F.array("x")).drop("x"))
    assert "input_ids" not in spark.read.parquet(f"{tmp_path}/t/unnumbered").columns
    assert [r.input_ids for r in tokens.read_tokens(spark, f"{tmp_path}/t", 9).orderBy("ordinal").collect()] == [[i] for i in range(9)]
