"""Nearest neighbours by squared distance, exact, in block pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.operators.blocks import count_blocks, pair_blocks, vectors_of

SAME = 1e-24  # squared distances under this are the query itself, or a copy of it


def nearest(queries: DataFrame, candidates: DataFrame, k: int, self_exclusion: str = "duplicate", blocks: int | None = None) -> DataFrame:
    """(id, neighbour, rank, d2): the k candidates nearest to each query; both tables are (id, vec).

    Ranks start at 1; ties go to the smaller neighbour; fewer than k is no error. With
    self_exclusion "duplicate" candidates at a squared distance under SAME are left out, exact
    copies included; with "index" only the row of the query's own id is. Blocks of both tables meet
    pairwise: a matrix product estimates all squared distances, and those that can be among the k
    least are computed again from differences, so that results and ties are those of the plain sum.
    Each pair of blocks returns k rows a query, and a window takes the k least of these.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if self_exclusion not in ("duplicate", "index"):
        raise ValueError(f"unknown self_exclusion: {self_exclusion}")
    first = candidates.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not first[0]:
        return queries.sparkSession.createDataFrame([], "id long, neighbour long, rank int, d2 double")
    rows, dim = first
    blocks = blocks or count_blocks(rows, 8 * dim, queries.sparkSession.sparkContext.defaultParallelism)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("id").to_numpy(), kind="stable")
            ids, x = right.column("id").to_numpy()[order], vectors_of(right, "vec", dim)[order]
            q_ids, q = left.column("id").to_numpy(), vectors_of(left, "vec", dim)
            square = (x * x).sum(axis=1)
            for a in range(0, len(q), 512):
                part, own = q[a : a + 512], q_ids[a : a + 512]
                norms = (part * part).sum(axis=1)
                rough = norms[:, None] + square[None, :] - 2 * part @ x.T
                slack = 1e-11 * (norms[:, None] + square.max()) + 1e-300
                if self_exclusion == "index":
                    rough[own[:, None] == ids[None, :]] = np.inf
                else:
                    r, c = np.nonzero(rough <= slack)
                    copies = ((part[r] - x[c]) ** 2).sum(axis=1) < SAME
                    rough[r[copies], c[copies]] = np.inf
                cut = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.full((len(part), 1), np.inf)
                r, c = np.nonzero((rough <= cut + 2 * slack) & np.isfinite(rough))
                d2 = ((part[r] - x[c]) ** 2).sum(axis=1)
                order = np.lexsort((ids[c], d2, r))
                r, c, d2 = r[order], c[order], d2[order]
                top = np.arange(len(r)) - np.searchsorted(r, r) < k
                out[0].append(own[r[top]])
                out[1].append(ids[c[top]])
                out[2].append(d2[top])
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"id": pa.array(cols[0].astype("int64")), "neighbour": pa.array(cols[1].astype("int64")), "d2": pa.array(cols[2].astype("float64"))})

    found = pair_blocks(queries.select("id", "vec"), candidates.select("id", "vec"), F.xxhash64("id"), blocks, run, "id long, neighbour long, d2 double")
    rank = F.row_number().over(W.partitionBy("id").orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", "rank", "d2")


def knn(query: list[float], candidates: DataFrame, k: int) -> DataFrame:
    """nearest for a single query vector, as (neighbour, rank, d2)."""
    spark = candidates.sparkSession
    one = spark.createDataFrame([(-1, [float(x) for x in query])], "id long, vec array<double>")
    return nearest(one, candidates, k).select("neighbour", "rank", "d2")
