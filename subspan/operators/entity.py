"""Distances between entities: the mean over pairs of their representative chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.config import GraphConfig, SpaceConfig
from subspan.functions.subspace import distances
from subspan.operators.blocks import count_blocks, pair_blocks, vectors_of
from subspan.operators.chunks import representatives
from subspan.operators.tangent import tangents_of_chunks
from subspan.plans.lineage import durable

HALF = "src long, dst long, d double"


def pairwise_means(rows: DataFrame, column: str, width: int, score, blocks: int | None = None, with_self: bool = False) -> DataFrame:
    """(src, dst, d) with src < dst (<= if with_self) for rows (entity_idx, ord, column).

    column holds `width` numbers a row. score(a, b) gives the matrix of scores between two stacks of
    rows; d is its mean over the rows of the two entities. Entities fall into blocks that meet
    pairwise; an entity's rows stay together, so that every mean is finished in one task.
    """
    spark = rows.sparkSession
    if blocks is None:
        blocks = count_blocks(rows.count(), 8 * width, spark.sparkContext.defaultParallelism, least=64)

    def block(table: pa.Table):
        order = np.lexsort((table.column("ord").to_numpy(), table.column("entity_idx").to_numpy()))
        ids = table.column("entity_idx").to_numpy()[order]
        return ids, vectors_of(table, column, width)[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            (a_ids, a), (b_ids, b) = block(left), block(right)
            b_own, b_first, b_n = np.unique(b_ids, return_index=True, return_counts=True)
            a_own, a_first, a_n = np.unique(a_ids, return_index=True, return_counts=True)
            same = a_own[0] % blocks == b_own[0] % blocks
            step = max(1, (1 << 19) // len(b))
            at = 0
            while at < len(a_own):  # some entities of the left block at a time, to bound the score matrix
                stop = max(at + 1, int(np.searchsorted(a_first, a_first[at] + step, side="right")) - 1)
                rows_ = a[a_first[at] : a_first[stop - 1] + a_n[stop - 1]]
                sums = np.add.reduceat(np.add.reduceat(score(rows_, b), b_first, axis=1), a_first[at:stop] - a_first[at], axis=0)
                means = sums / (a_n[at:stop, None] * b_n[None, :])
                x, y = a_own[at:stop, None], b_own[None, :]
                i, j = np.nonzero(((x <= y) if with_self else (x < y)) if same else (x == x) & (y == y))
                out[0].append(np.minimum(x[i, 0], y[0, j]))
                out[1].append(np.maximum(x[i, 0], y[0, j]))
                out[2].append(means[i, j])
                at = stop
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"src": pa.array(cols[0].astype("int64")), "dst": pa.array(cols[1].astype("int64")), "d": pa.array(cols[2].astype("float64"))})

    return pair_blocks(rows, rows, F.col("entity_idx"), blocks, run, HALF, half=True)


def entity_distances(tangents: DataFrame, p: int, metric: str = "geodesic", with_self: bool = False) -> DataFrame:
    """(src, dst, d), src < dst, from tangents (entity_idx, chunk_pos, basis): means of subspace distances.

    All inner products of two blocks' basis vectors are one matrix product; planes and lines have
    closed forms, higher dimensions take singular values. with_self adds src = dst, which is the
    mean over all ordered pairs of an entity's chunks and not 0.
    """
    rows = tangents.select("entity_idx", F.col("chunk_pos").alias("ord"), F.flatten("basis").alias("flat"))
    first = rows.select(F.size("flat")).first()
    if first is None:
        return tangents.sparkSession.createDataFrame([], HALF)
    width = first[0]
    dim = width // p

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        products = a.reshape(-1, dim) @ b.reshape(-1, dim).T
        return distances(products.reshape(len(a), p, len(b), p).transpose(0, 2, 1, 3), metric)

    return pairwise_means(rows, "flat", width, score, with_self=with_self)


def mean_directions(chunks: DataFrame) -> DataFrame:
    """(entity_idx, mean): the mean of each entity's unit vectors. Tasks send sums, so an entity of any size is spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("entity_idx").to_numpy()
            v = vectors_of(pa.table(batch), "vec", len(batch.column("vec")[0]))
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            order = np.argsort(ids, kind="stable")
            own, first, n = np.unique(ids[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(v[order], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype("int64")), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["entity_idx", "n", "sums"])

    parts = chunks.select("entity_idx", "vec").mapInArrow(run, "entity_idx long, n long, sums array<double>")
    parts = parts.select("entity_idx", "n", F.posexplode("sums").alias("pos", "x")).groupBy("entity_idx", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    listed = parts.groupBy("entity_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m"))  # as many as dimensions
    return listed.select("entity_idx", F.transform("m", lambda e: e["x"]).alias("mean"))


def cosine_similarities(chunks: DataFrame) -> DataFrame:
    """(src, dst, d), src < dst: the mean cosine over all pairs of chunks of two entities.

    That mean is the inner product of the entities' mean directions, so no pair of chunks is formed.
    """
    rows = durable(mean_directions(chunks).withColumn("ord", F.lit(1).cast("long")))
    first = rows.select(F.size("mean")).first()
    if first is None:
        return chunks.sparkSession.createDataFrame([], HALF)
    return pairwise_means(rows, "mean", first[0], lambda a, b: a @ b.T)


def symmetric(half: DataFrame) -> DataFrame:
    """Both directions of a relation (src, dst, d) that holds each pair once."""
    return half.union(half.where("src <> dst").select("dst", "src", "d"))


def with_diagonal(dist: DataFrame, entities: DataFrame) -> DataFrame:
    """A symmetric relation and a distance of 0 from each entity to itself."""
    own = entities.select(F.col("entity_idx").alias("src"), F.col("entity_idx").alias("dst"), F.lit(0.0).alias("d"))
    return dist.where("src <> dst").union(own)


def adjacency(dist: DataFrame, k: int, lower_is_closer: bool = True) -> DataFrame:
    """(src, dst, rank, d): the k closest others of each entity, ties to the smaller index."""
    by = F.col("d").asc() if lower_is_closer else F.col("d").desc()
    rank = F.row_number().over(W.partitionBy("src").orderBy(by, "dst"))
    return dist.where("src <> dst").withColumn("rank", rank).where(F.col("rank") <= k).select("src", "dst", "rank", "d")


def chunk_tangents(chunks: DataFrame, space: SpaceConfig, graph: GraphConfig, self_exclusion: str = "duplicate") -> DataFrame:
    """Tangent spaces of the representatives, fitted to neighbours among all chunks, stored once."""
    return durable(tangents_of_chunks(chunks, space.k, space.p, self_exclusion, only=representatives(chunks, graph.max_chunks)))
