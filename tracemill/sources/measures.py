"""CSV files whose delimiter and headers vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")


def read_measures(spark: SparkSession, path: str, measure: str, aliases: tuple[str, ...] = ()) -> DataFrame:
    """All columns of a CSV as strings, the measure under its own name and as a decimal; blank rows are passed over.

    The delimiter is the one of comma, semicolon and tab that the header line has most of. ValueError if the measure or
    exactly one of its aliases is not a column, or a row has no number there.
    """
    header = spark.read.text(path).where(F.trim("value") != "").head(1)
    if not header:
        raise ValueError(f"{path} has no rows")
    sep = max(DELIMITERS, key=header[0]["value"].count)
    rows = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = [c for c in rows.columns if c.strip().lower() in {measure, *aliases}]
    if len(named) != 1:
        raise ValueError(f"{path} has {len(named)} columns for {measure}")
    rows = rows.withColumnRenamed(named[0], measure).where(F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in rows.withColumnRenamed(named[0], measure).columns]).isNotNull())
    out = rows.withColumn(measure, F.expr(f"try_cast(`{measure}` AS decimal(18,4))"))
    if not out.where(F.col(measure).isNull()).isEmpty():
        raise ValueError(f"{path} has rows without a number for {measure}")
    return out


def sole_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file or table below a folder whose name fits; ValueError if there is none or more than one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [s.getPath().toString() for s in found]
    if len(names) != 1:
        raise ValueError(f"{len(names)} files fit {pattern}")
    return names[0]
