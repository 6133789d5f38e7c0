"""Corpora: embeddings in JSON files, Markdown documents, and tables of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.model import CORPUS


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry of {model, dimension, entries: [...]} files, in the order of the array; entity is doc, else cluster, else id.

    Entries whose vector does not have the stated dimension raise when read.
    """
    rows = spark.read.schema(CORPUS).option("multiLine", True).json(path).select("model", "dimension", F.posexplode("entries").alias("pos", "e"))
    checked = F.when(F.col("dimension").isNull() | (F.size("e.embedding") == F.col("dimension")), F.col("e.embedding")).otherwise(F.raise_error(F.concat(F.lit("wrong dimension: "), F.coalesce("e.id", F.lit("?")))))
    return rows.select("model", F.col("pos").cast("long").alias("vec_id"), "e.id", F.coalesce("e.doc", "e.cluster", "e.id").alias("entity"), "e.text", checked.alias("embedding"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of the .md files under path; doc is the file name without ending."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("doc"), F.col("value").alias("text"))


def write_embeddings(entries: DataFrame, path: str) -> None:
    """One JSON line an entry."""
    entries.write.mode("overwrite").json(path)
