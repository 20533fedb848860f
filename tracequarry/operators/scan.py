"""Texts to rows by a parser of the user's own, as a table function of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(spark, name: str, parser: type, schema: str) -> None:
    """parser: a class whose eval(text) yields rows of schema; usable in SQL as name(text)."""
    spark.udtf.register(name, F.udtf(parser, returnType=schema))


def scan(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, the table function's columns) for each row that it gives for a text; null texts give none."""
    kept = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("scan_key"), F.col(text).alias("scan_text"))
    return rows.sparkSession.sql(f"SELECT s.scan_key, t.* FROM {{kept}} s, LATERAL {name}(s.scan_text) t", kept=kept).withColumnRenamed("scan_key", key)
