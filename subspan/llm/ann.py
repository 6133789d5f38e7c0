"""Nearest neighbours by randomly rotated one-bit codes, with reranking chosen by error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.llm.common import table
from subspan.operators.blocks import count_blocks, pair_blocks, vectors_of


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, uniform over rotations and reflections."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec) as long and doubles, without null vectors and such as are zero, empty or hold a null or non-finite component.

    Rows without an id go too: they can neither ask nor be named in an answer.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_).cast("long").alias("id"), v.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and each code's inner product with its vector."""
    turned = _unit(vectors) @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])


def estimate(codes: np.ndarray, align: np.ndarray, queries: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of rows (codes) with turned unit queries, as estimated from the bits, and the rows' error bound.

    <code, q> / <code, vector> is an unbiased estimate; its error has a standard deviation of at most
    sqrt((1 - align^2) / align^2 / (dim - 1)), of which `bound` times are allowed.
    """
    dim = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    est = (signs @ queries.T.astype(np.float32)) / align[:, None].astype(np.float32)
    return est, bound * np.sqrt(np.maximum(0, 1 - align**2) / align**2 / max(1, dim - 1)) + 1e-5


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of components.

    Rows are first scaled by powers of two, which changes no digit, so that no square overflows.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    return np.clip(total(a * b) / np.sqrt(total(a * a) * total(b * b)), -1.0, 1.0)


class Nearest:
    """The best k so far of each query: exact scores, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, turn: np.ndarray, k: int, bound: float):
        self.ids, self.vecs, self.k, self.bound, self.turn = ids, vecs, k, bound, turn
        self.unit = _unit(vecs)
        self.turned = self.unit @ turn
        self.best = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.reranked = 0

    def add(self, ids: np.ndarray, vecs: np.ndarray, codes: np.ndarray, align: np.ndarray) -> None:
        """Take in rows: the k + 4 best by estimate are scored first, then all whose upper bound reaches the k-th score."""
        rows = np.ascontiguousarray(vecs).view(f"V{vecs.itemsize * vecs.shape[1]}").ravel()
        _, group = np.unique(rows, return_inverse=True)
        order = np.lexsort((ids, group))
        at = group[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)  # of equal vectors only the k + 1 least ids can be wanted
        keep = order[place <= self.k]
        ids, vecs, codes, align = ids[keep], vecs[keep], codes[keep], align[keep]
        est, slack = estimate(codes, align, self.turned, self.bound)
        unit = _unit(vecs)
        n = min(len(ids), self.k + 4)
        first = np.argpartition(-est, n - 1, axis=0)[:n] if n < len(ids) else np.repeat(np.arange(n)[:, None], len(self.ids), axis=1)
        self._rerank(first.ravel(), np.tile(np.arange(len(self.ids)), n), ids, vecs, unit)
        est += slack[:, None].astype(np.float32)
        np.put_along_axis(est, first, -np.inf, axis=0)
        r, q = np.nonzero((est >= (self.best[:, -1] - 1e-6).astype(np.float32)[None, :]) & np.isfinite(est))
        for a in range(0, len(r), 1 << 17):
            self._rerank(r[a : a + (1 << 17)], q[a : a + (1 << 17)], ids, vecs, unit)

    def _rerank(self, r: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, unit: np.ndarray) -> None:
        self.reranked += len(r)
        rough = np.einsum("ij,ij->i", unit[r], self.unit[q])
        may = (rough >= self.best[q, -1] - 1e-9) & (ids[r] != self.ids[q])
        r, q = r[may], q[may]
        if not len(r):
            return
        s = cosine(vecs[r], self.vecs[q])
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        s = np.concatenate([s, self.best[touched].ravel()])
        i = np.concatenate([ids[r], self.found[touched].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.best[q[top], place[top]], self.found[q[top], place[top]] = s[top], i[top]


def build_index(vectors: DataFrame, dim: int, seed: int = 7) -> DataFrame:
    """(id, vec, code, align) for every vector of dim components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes, align = encode(v, turn)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(align)], ["id", "vec", "code", "align"])

    return vectors.where(F.size("vec") == dim).mapInArrow(run, "id long, vec array<double>, code binary, align double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, bound: float = 2.5, block: int = 16_384, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors by cosine for each row of queries, its own id left out.

    Both hold (id, vec) as `usable` returns them. Each vector becomes sign bits of its rotation and
    one scalar. A query's cosine with a row is estimated from the bits; the best by estimate are
    scored in full, then the rows whose upper bound reaches the k-th best score so far. `bound` is
    how many standard deviations of the estimate's error are allowed; 2.5 leaves one true neighbour
    in some 160 to chance. Blocks of at most about `block` queries meet blocks of the index, each
    pair in one task that returns k rows a query; neither queries nor results go through the driver.

    Each length of vector has an index of its own, and a query meets the vectors of its length. A
    query id that repeats counts once for each length, with its least vector; repeated candidate rows
    each count. Fewer candidates than k are all returned; without queries the result is empty.
    """
    dims = sorted(r["dim"] for r in queries.select(F.size("vec").alias("dim")).distinct().collect())  # lengths only
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_search_length(vectors, queries, dim, k, bound, block, seed) for dim in dims]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(vectors: DataFrame, queries: DataFrame, dim: int, k: int, bound: float, block: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score): what each pair of blocks finds for the queries of dim components."""
    asked = queries.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))
    index = build_index(vectors, dim, seed)
    n_index = vectors.where(F.size("vec") == dim).count()
    query_blocks = max(1, -(-asked.count() // block))
    index_blocks = count_blocks(n_index, 9 * dim, (queries.sparkSession.sparkContext.defaultParallelism ** 2 + 1) // 2, least=1024)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            turn = rotation(dim, seed)
            ids, rows = left.column("id").to_numpy(), vectors_of(left, "vec", dim)
            other, vecs = right.column("id").to_numpy(), vectors_of(right, "vec", dim)
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(vecs), -1)
            align = right.column("align").to_numpy()
            for a in range(0, len(ids), 2048):
                best = Nearest(ids[a : a + 2048], rows[a : a + 2048], turn, k, bound)
                for b in range(0, len(other), 4096):
                    best.add(other[b : b + 4096], vecs[b : b + 4096], codes[b : b + 4096], align[b : b + 4096])
                q, place = np.nonzero(best.best > -np.inf)
                for own, found in zip(out, (best.ids[q], best.found[q, place], best.best[q, place]), strict=True):
                    own.append(found)
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype("int64")), "vec_id": pa.array(cols[1].astype("int64")), "score": pa.array(cols[2].astype("float64"))})

    return pair_blocks(asked, index, F.xxhash64("id"), (query_blocks, index_blocks), run, "query_id long, vec_id long, score double")


def op7_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("id % 50 = 0"))


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.vec, c.vec) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
