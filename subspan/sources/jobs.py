"""Requests from JSON and results to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subspan.model import REQUEST, RESULT


def broker_address(url: str) -> tuple[Column, Column]:
    """Host and port of a broker URL column; the port defaults to 1883."""
    parts = F.split(F.regexp_replace(F.col(url), "^tcp://", ""), ":")
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(1883))


def metric_of(name: Column | str) -> Column:
    """chordal, or geodesic for any other name."""
    return F.when((F.col(name) if isinstance(name, str) else name) == "chordal", "chordal").otherwise("geodesic")


def parse_requests(rows: DataFrame, column: str = "value") -> DataFrame:
    """rows with request, the parsed struct, and error where the text or bytes are no request. Unknown fields are ignored."""
    text = F.col(column).cast("string")
    parsed = F.from_json(text, REQUEST + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = rows.withColumn("request", parsed)
    bad = F.col("request").isNull() | F.col("request._broken").isNotNull() | F.col("request.job_id").isNull() | F.col("request.mode").isNull()
    return rows.withColumn("error", F.when(bad, F.lit("Parse error: not a valid request")))


def serialize_results(results: DataFrame) -> DataFrame:
    """(value): one JSON text for each result; fields that are null are left out."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def read_results(rows: DataFrame, column: str = "value") -> DataFrame:
    return rows.select(F.from_json(F.col(column), RESULT).alias("r")).select("r.*")
