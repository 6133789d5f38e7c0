"""Chunks: one row a vector, (entity_idx, entity_id, chunk_pos, chunk_id, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ("entity_idx", "entity_id", "chunk_pos", "chunk_id", "vec")


def from_vectors(vectors: DataFrame, entity: Column, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Chunks of a table of vectors: entity names each row's entity, rows are ordered by id.

    Entities are numbered from 1 by the least id they hold, chunks from 1 within their entity and,
    as chunk_id, by id over all. Components become doubles before any arithmetic.
    """
    rows = vectors.select(entity.cast("string").alias("entity_id"), F.col(id_).cast("long").alias("chunk_id"), F.col(vector).cast("array<double>").alias("vec"))
    firsts = rows.groupBy("entity_id").agg(F.min("chunk_id").alias("first"))
    index = firsts.select("entity_id", F.row_number().over(W.orderBy("first")).cast("long").alias("entity_idx"))
    pos = F.row_number().over(W.partitionBy("entity_id").orderBy("chunk_id")).cast("long")
    return rows.withColumn("chunk_pos", pos).join(index, "entity_id").select(*COLUMNS)


def by_label(vectors: DataFrame) -> DataFrame:
    return from_vectors(vectors, F.col("label"))


def by_label_and_rest(vectors: DataFrame, parts: int = 5) -> DataFrame:
    return from_vectors(vectors, F.concat_ws("_", F.col("label").cast("string"), (F.col("vec_id") % parts).cast("string")))


def from_entities(entities: DataFrame) -> DataFrame:
    """Chunks of rows (entity_idx, id, embeddings), in the order of both arrays."""
    rows = entities.select(F.col("entity_idx").cast("long"), F.col("id").alias("entity_id"), F.posexplode("embeddings").alias("pos", "vec"))
    order = F.row_number().over(W.orderBy("entity_idx", "pos")).cast("long")  # a request's vectors: one JSON document
    return rows.select("entity_idx", "entity_id", (F.col("pos") + 1).cast("long").alias("chunk_pos"), order.alias("chunk_id"), F.col("vec").cast("array<double>").alias("vec"))


def entities_of(chunks: DataFrame) -> DataFrame:
    """(entity_idx, entity_id, n_chunks)."""
    return chunks.groupBy("entity_idx", "entity_id").agg(F.count("*").alias("n_chunks"))


def contiguous(rows: DataFrame, entity: str, position: str) -> DataFrame:
    """(entity, first, last, n) of rows whose positions each entity must hold without gaps; raises ValueError if one does not."""
    spans = rows.groupBy(F.col(entity).alias("entity")).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    bad = spans.where("last - first + 1 <> n").orderBy("first").select("entity").first()
    if bad:
        raise ValueError(f"chunks of entity are not contiguous: {bad[0]!r}")
    return spans


def check(chunks: DataFrame, ids: list[str] | None = None) -> int:
    """The vectors' common length. Raises ValueError for ragged or null vectors, and for listed ids that repeat or have no chunk."""
    sizes = [r[0] for r in chunks.select(F.coalesce(F.size("vec"), F.lit(-1))).distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] <= 0:
        raise ValueError("chunks need vectors of one length")
    if ids is not None:
        if len(set(ids)) != len(ids):
            raise ValueError("an entity id repeats")
        wanted = chunks.sparkSession.createDataFrame([(i,) for i in ids], "entity_id string")
        lost = wanted.join(chunks, "entity_id", "left_anti").first()
        if lost:
            raise ValueError(f"no chunks for entity: {lost[0]!r}")
    return sizes[0]


def representatives(chunks: DataFrame, max_chunks: int = 5) -> DataFrame:
    """At most max_chunks chunks of each entity, evenly spread over its positions, rounded half to even.

    With max_chunks 1 an entity may hold one chunk only.
    """
    n, m = F.col("n_chunks"), max_chunks
    counted = chunks.withColumn("n_chunks", F.count("*").over(W.partitionBy("entity_idx")))
    if m == 1:
        spread = n == 1
    else:
        picks = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda t: F.rint(1 + (n - 1) * t / (m - 1)).cast("long"))
        spread = (n <= m) | F.array_contains(picks, F.col("chunk_pos"))
    return counted.where(spread).drop("n_chunks")
