"""Markdown chunking as column expressions. Lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS, MAX_CHARS = 200, 3000
WHITE = " \t\n\x0b\x0c\r"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def sections(text: Column | str) -> Column:
    """The text cut before each heading of level 2 or 3; pieces are stripped, blank ones dropped."""
    parts = F.split(text, r"\n(?=#{2,3}[ \t\x0b\x0c\r])", -1)
    return F.filter(F.transform(parts, _strip), lambda x: x != "")


def merge_short(parts: Column | str, least: int = MIN_CHARS) -> Column:
    """A part under `least` characters joins the one before it, if both have under twice that together."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.length(last) + F.length(part) < 2 * least) & (F.length(part) < least)
        return F.when(joins, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), F.concat(last, F.lit("\n\n"), part))).otherwise(F.array_append(done, part))

    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(step(a, x)))


def split_long(parts: Column | str, most: int = MAX_CHARS) -> Column:
    """A part over `most` characters is packed anew from its paragraphs; a longer paragraph stays whole."""

    def pack(done: Column, paragraph: Column) -> Column:
        last = F.element_at(done, -1)
        full = (F.length(last) + F.length(paragraph) > most) & (_strip(last) != "")
        return F.when(F.size(done) == 0, F.array(paragraph)).when(full, F.array_append(done, paragraph)).otherwise(F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), F.concat(last, F.lit("\n\n"), paragraph)))

    def spread(part: Column) -> Column:
        packed = F.aggregate(F.split(part, "\n\n+", -1), F.array().cast("array<string>"), pack)
        return F.when(F.length(part) > most, F.filter(F.transform(packed, _strip), lambda x: x != "")).otherwise(F.array(part))

    return F.flatten(F.transform(parts, spread))


def chunk_id(doc: Column | str, number: Column | str) -> Column:
    """doc, underscore, number of at least two digits."""
    n = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.concat(F.col(doc) if isinstance(doc, str) else doc, F.lit("_"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def chunk_markdown(docs: DataFrame, doc: str, text: str, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """(doc, chunk_idx, chunk_id, text): one row a chunk, numbered from 1. Null and blank texts have none."""
    chunks = split_long(merge_short(sections(text), least), most)
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.posexplode(chunks).alias("pos", "text"))
    return rows.select("doc", (F.col("pos") + 1).cast("long").alias("chunk_idx"), chunk_id("doc", F.col("pos") + 1).alias("chunk_id"), "text")
