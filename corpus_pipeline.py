"""Toxicity filter, line dedup, near-duplicate removal, source mixing and tokenisation of one corpus.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before returned; what it
returns is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.llm.bpe import encode_documents, public_vocabulary
from subspan.llm.common import scratch, table
from subspan.llm.linededup import dedup_lines
from subspan.llm.mixing import mix
from subspan.llm.simhash import components
from subspan.llm.toxicity import keep_clean, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return keep_clean(docs.select(*COLUMNS), train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those of which no line is left go."""
    found = dedup_lines(docs.select(*COLUMNS)).where("_n_lines = 0 OR _n_dropped < _n_lines")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document: the least by doc_id, nulls last, then by the text's md5, null texts first.

    Rows with equal doc_id and text are one document. Texts move once, by a key of both.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))
    rows = docs.select(*COLUMNS, key.alias("_key"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("_key").alias("key")))
    stay = components(rows, carry=("_key",)).groupBy("component").agg(first.alias("first")).select(F.col("first.key").alias("_key"))
    return rows.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document that the budget reaches, the last one of a source cut."""
    return mix(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix."""
    return encode_documents(docs, *public_vocabulary())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("tokenize", tokenize)]

#: Toxicity scores, SimHash and byte-level BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
