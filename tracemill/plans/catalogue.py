"""The query catalogue over the driver tables: each name has a DataFrame query and the DuckDB SQL it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, duck: str | None = None) -> None:
    """Register SQL whose {table} names stand for driver tables; `duck` where the dialects differ."""
    tables = sorted(set(re.findall(r"{(\w+)}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = re.sub(r"{(\w+)}", r"\1", duck or sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_eligible
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 GROUP BY 1""")
def first_success(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256")).join(labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id")
    return good.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_eligible"))
