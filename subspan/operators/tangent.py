"""Tangent spaces: the leading directions of a chunk's centred neighbourhood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subspan.operators.knn import nearest


def fit(neighbours: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bases (n, p, dim), centres and singular values of stacks of neighbourhoods (n, k, dim).

    Bases are the first p right singular vectors of the centred rows. Raises ValueError if there are
    fewer rows than p, or fewer directions. Centring leaves a rank of at most k - 1, so with p = k
    the last direction is arbitrary; the singular values tell.
    """
    if neighbours.shape[1] < p or neighbours.shape[2] < p:
        raise ValueError(f"p = {p} needs as many neighbours and dimensions")
    centre = neighbours.mean(axis=1)
    _, s, vt = np.linalg.svd(neighbours - centre[:, None, :], full_matrices=False)
    return vt[:, :p], centre, s


def tangent_spaces(points: DataFrame, corpus: DataFrame, k: int, p: int, self_exclusion: str = "duplicate") -> DataFrame:
    """(id, basis, center, gap) for each point, from its k nearest corpus rows; both tables are (id, vec).

    basis is p arrays, gap the p-th less the next singular value over the first: near 0 the space is
    not determined by the data. A point with fewer than p neighbours raises.
    """
    near = nearest(points, corpus, k, self_exclusion)
    rows = near.join(corpus.select(F.col("id").alias("neighbour"), "vec"), "neighbour")
    stacks = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec"))).alias("near"))  # k rows
    flat = stacks.select("id", F.size("near").alias("n"), F.flatten(F.transform("near", lambda x: x["vec"])).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            values, ends = batch.column("near").values.to_numpy(), batch.column("near").offsets.to_numpy()
            for n in np.unique(sizes):
                own = np.nonzero(sizes == n)[0]
                stack = np.stack([values[ends[i] : ends[i + 1]] for i in own]).reshape(len(own), n, -1)
                basis, centre, s = fit(stack, p)
                after = s[:, p] if s.shape[1] > p else np.zeros(len(s))
                gap = np.divide(s[:, p - 1] - after, s[:, 0], out=np.zeros(len(s)), where=s[:, 0] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(basis.tolist(), pa.list_(pa.list_(pa.float64()))), pa.array(centre.tolist(), pa.list_(pa.float64())), pa.array(gap)], ["id", "basis", "center", "gap"])

    return flat.mapInArrow(run, "id long, basis array<array<double>>, center array<double>, gap double")


def tangents_of_chunks(chunks: DataFrame, k: int, p: int, self_exclusion: str = "duplicate", only: DataFrame | None = None) -> DataFrame:
    """Chunks (or those in only) with basis, center and gap, from neighbours among all chunks."""
    corpus = chunks.select(F.col("chunk_id").alias("id"), "vec")
    points = (only if only is not None else chunks).select(F.col("chunk_id").alias("id"), "vec")
    found = tangent_spaces(points, corpus, k, p, self_exclusion).withColumnRenamed("id", "chunk_id")
    return (only if only is not None else chunks).drop("vec").join(found, "chunk_id")
