import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subspan import queries
from subspan.config import GraphConfig, SpaceConfig, WorkerConfig, parse_broker_url
from subspan.functions import subspace as sp
from subspan.functions import vectors as vec
from subspan.operators import chunks as ch
from subspan.operators import entity as ent
from subspan.operators import ranking
from subspan.operators.knn import knn, nearest
from subspan.operators.tangent import fit, tangent_spaces
from tests import model

VEC = "id long, vec array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(rows)], VEC)


def basis(rng, dim, p):
    return np.linalg.qr(rng.standard_normal((dim, p)))[0]


def test_knn_known_answers(spark):
    x = frame(spark, [(0, 0, 0), (1, 0, 0), (5, 5, 5), (2, 0, 0), (10, 10, 10)])
    ids = lambda q, k, t=x: [r["neighbour"] for r in knn(q, t, k).orderBy("rank").collect()]
    assert ids((0.8, 0, 0), 2) == [1, 0] and ids((0.8, 0, 0), 3) == [1, 0, 3]
    line = frame(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    assert ids((0, 0, 0), 2, line) == [1, 2] and ids((0, 0, 0), 3, line) == [1, 2]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            knn((0, 0, 0), line, bad)


@pytest.mark.parametrize("blocks", [1, 3])
def test_nearest_against_model(spark, blocks):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    x[50], x[51] = x[3], x[3]  # copies
    x[40:44] = [[1, 0, 0, 0, 0], [-1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0]]  # ties
    t = frame(spark, x)
    got = {}
    for r in nearest(t, t, 6, blocks=blocks).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i in range(60):
        assert [n for _, n in sorted(got[i])] == model.knn(x, x[i], 6), i
    by_index = nearest(t, t, 1, self_exclusion="index", blocks=blocks)
    assert {r["neighbour"] for r in by_index.where("id = 3").collect()} == {50}
    assert nearest(t, t.where("false"), 3).collect() == []


def test_bases_of_planes_and_lines():
    rng = np.random.default_rng(1)
    flat = np.c_[rng.standard_normal((10, 2)), np.zeros(10)]
    b, _, s = fit(flat[None], 2)
    assert np.allclose(b[0][:, 2], 0) and np.allclose(b[0] @ b[0].T, np.eye(2)) and s[0, 2] < 1e-12
    b, _, _ = fit(np.c_[rng.standard_normal(20), np.zeros((20, 2))][None], 1)
    assert abs(b[0][0, 0]) > 0.999
    with pytest.raises(ValueError):
        fit(flat[None, :2], 3)


def test_tangents_against_model(spark):
    x = np.random.default_rng(2).standard_normal((40, 6))
    t = frame(spark, x)
    for r in tangent_spaces(t.where("id % 8 = 0"), t, 7, 3).collect():
        b = np.array(r["basis"])
        u = model.tangent(x, r["id"], 7, 3)
        assert np.allclose(b.T @ b, u @ u.T, atol=1e-10) and 0 <= r["gap"] <= 1


def test_distance_properties():
    rng = np.random.default_rng(3)
    a, b, c = (basis(rng, 12, 3) for _ in range(3))
    for m in ("geodesic", "chordal"):
        assert sp.distance(a, a, m) < 1e-6
        assert sp.distance(a, b, m) == pytest.approx(sp.distance(b, a, m))
        assert sp.distance(a, c, m) <= sp.distance(a, b, m) + sp.distance(b, c, m) + 1e-12
    e1, e2 = np.eye(3)[:, :1], np.eye(3)[:, 1:2]
    assert sp.distance(e1, e2) == pytest.approx(math.pi / 2) and sp.distance(e1, e2, "chordal") == pytest.approx(1)
    for t in (0.1, 0.5, 1, math.pi / 4, math.pi / 3):
        assert sp.distance(e1, math.cos(t) * e1 + math.sin(t) * e2) == pytest.approx(t, abs=1e-10)
    with pytest.raises(ValueError):
        sp.distance(a, basis(rng, 12, 2))
    with pytest.raises(ValueError):
        sp.distance(a, b, "cosine")


@pytest.mark.parametrize("p", [1, 2, 3, 4])
@pytest.mark.parametrize("metric", ["geodesic", "chordal"])
def test_stacked_distances_against_svd(p, metric):
    rng = np.random.default_rng(p)
    pairs = [(basis(rng, 9, p), basis(rng, 9, p)) for _ in range(30)]
    got = sp.distances(np.array([a.T @ b for a, b in pairs]), metric)
    assert np.allclose(got, [sp.distance(a, b, metric) for a, b in pairs], atol=1e-9)


def test_angle_pairs(spark):
    rng = np.random.default_rng(21)
    bases = [basis(rng, 7, 3) for _ in range(40)]
    t = spark.createDataFrame([(i, b.T.tolist()) for i, b in enumerate(bases)], "id long, basis array<array<double>>")
    got = {(r["a"], r["b"]): r["angles"] for r in ranking.angle_pairs(t, 3).collect()}
    assert len(got) == 40 * 39 // 2 and all(a < b for a, b in got)
    assert all(np.allclose(angles, sp.principal_angles(bases[a], bases[b]), atol=1e-7) for (a, b), angles in got.items())


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("metric", ["geodesic", "chordal"])
def test_ranking(spark, p, metric):
    rng = np.random.default_rng(10 + p)
    bases = [basis(rng, 7, p) for _ in range(9)]
    t = spark.createDataFrame([(i, b.T.tolist()) for i, b in enumerate(bases)], "id long, basis array<array<double>>")
    got = ranking.rank_tangents(t.where("id = 0"), t, p, metric).orderBy("rank").collect()
    want = sorted(range(9), key=lambda i: (round(sp.distance(bases[0], bases[i], metric), 7), i))
    assert [r["id"] for r in got] == want
    assert [r["distance"] for r in got] == pytest.approx([sp.distance(bases[0], bases[i], metric) for i in want], abs=1e-6)
    assert ranking.rank_tangents(t.where("id = 0"), t, p, metric, top=2).count() == 2


def test_ranking_known_angles(spark):
    turn = lambda t: [[math.cos(t), math.sin(t), 0.0]]
    t = spark.createDataFrame([(0, turn(0)), (1, turn(math.pi / 6)), (2, turn(math.pi / 3)), (3, turn(math.pi / 2))], "id long, basis array<array<double>>")
    got = ranking.rank_tangents(t.where("id = 0"), t.where("id > 0"), 1).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3] and got[0]["distance"] == pytest.approx(math.pi / 6)


def test_prefiltered_query_ranks_every_chunk_for_every_representative(spark, tmp_path):
    rng = np.random.default_rng(31)
    x, labels = rng.standard_normal((70, 24)), [i % 3 for i in range(70)]
    spark.createDataFrame([(i, v.tolist(), l, "c") for i, (v, l) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int, code string").write.parquet(f"{tmp_path}/embeddings.parquet")
    chunks = queries.label_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()
    ids, x, owners = [r["chunk_id"] for r in chunks], np.array([r["vec"] for r in chunks]), [r["entity_idx"] for r in chunks]
    own = [sorted((r["chunk_pos"], i) for i, r in enumerate(chunks) if r["entity_idx"] == e) for e in sorted(set(owners))]
    reps = [o[r][1] for o in own for r in model.representatives(len(o), 5)]
    cut = x[:, :16] / np.linalg.norm(x[:, :16], axis=1, keepdims=True)
    spaces = [model.tangent(x, i, 20, 2) for i in range(70)]
    got: dict = {}
    for r in queries.QUERIES["j_prefiltered_ranking"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert sorted(got) == sorted(ids[i] for i in reps) and len(reps) == 15
    for i in reps:
        near = sorted(range(70), key=lambda j: (-float(cut[i] @ cut[j]), ids[j]))[:20]
        want = {ids[j]: model.distance(spaces[i], spaces[j], "geodesic") for j in near}
        assert dict(got[ids[i]]) == pytest.approx(want, abs=1e-5)
        assert [want[c] for c, _ in got[ids[i]]] == pytest.approx(sorted(want.values()), abs=1e-5)


@pytest.mark.parametrize("p, metric, m", [(2, "geodesic", 5), (1, "geodesic", 3), (3, "geodesic", 4), (2, "chordal", 2)])
def test_entity_distances_against_model(spark, p, metric, m):
    rng = np.random.default_rng(4)
    owners = [f"e{i % 6}" for i in range(47)]
    x = rng.standard_normal((47, 8))
    rows = spark.createDataFrame([(i, x[i].tolist(), owners[i]) for i in range(47)], "vec_id long, embedding array<double>, o string")
    chunks = ch.from_vectors(rows, F.col("o"))
    t = ent.chunk_tangents(chunks, SpaceConfig(9, p, metric), GraphConfig(max_chunks=m))
    ids, want = model.entity_matrix(x, owners, 9, p, m, metric)
    got = {(r["src"], r["dst"]): r["d"] for r in ent.entity_distances(t, p, metric).collect()}
    assert len(got) == 15 and all(got[i + 1, j + 1] == pytest.approx(want[i, j], abs=1e-9) for i in range(6) for j in range(i + 1, 6))


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_pairwise_means_in_any_blocks(spark, blocks):
    rng = np.random.default_rng(5)
    rows = [(e, n, rng.standard_normal(3).tolist()) for e in range(1, 12) for n in range(1, 1 + e % 4 + 1)]
    t = spark.createDataFrame(rows, "entity_idx long, ord long, v array<double>")
    got = {(r["src"], r["dst"]): r["d"] for r in ent.pairwise_means(t, "v", 3, lambda a, b: a @ b.T, blocks, with_self=True).collect()}
    by = {}
    for e, _, v in rows:
        by.setdefault(e, []).append(v)
    assert len(got) == 66
    for (a, b), d in got.items():
        assert a <= b and d == pytest.approx(np.mean(np.array(by[a]) @ np.array(by[b]).T))


def test_representatives_round_half_to_even(spark):
    rows = [(e, i, i) for e, n in ((1, 3), (2, 6), (3, 12), (4, 1)) for i in range(1, n + 1)]
    t = spark.createDataFrame(rows, "entity_idx long, chunk_pos long, chunk_id long")
    got = {}
    for r in ch.representatives(t, 5).collect():
        got.setdefault(r["entity_idx"], set()).add(r["chunk_pos"])
    for e, n in ((1, 3), (2, 6), (3, 12), (4, 1)):
        assert got[e] == {i + 1 for i in model.representatives(n, 5)}
    assert {r["entity_idx"] for r in ch.representatives(t, 1).collect()} == {4}


def test_vector_columns(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0])], "a array<double>, b array<double>").select(
        vec.dot("a", "b").alias("dot"), vec.squared_distance("a", "b").alias("d2"), vec.norm("a").alias("n"), vec.normalise("a").alias("u"), vec.angle(F.lit(1.0000001)).alias("t"),
        *[vec.round_half_even(F.lit(x)).alias(f"r{i}") for i, x in enumerate((0.5, 1.5, 2.5))],
    ).first()
    assert (r["dot"], r["d2"], r["n"], r["u"], r["t"]) == (4.0, 18.0, 5.0, [0.6, 0.8], 0.0)
    assert (r["r0"], r["r1"], r["r2"]) == (0.0, 2.0, 2.0)


def test_checks(spark):
    rows = lambda p: spark.createDataFrame(p, "who string, pos long")
    assert ch.contiguous(rows([("a", 1), ("a", 2), ("b", 3)]), "who", "pos").count() == 2
    with pytest.raises(ValueError):
        ch.contiguous(rows([("a", 1), ("b", 2), ("a", 3)]), "who", "pos")
    ragged = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "entity_id string, vec array<double>")
    with pytest.raises(ValueError):
        ch.check(ragged)
    good = ragged.where("entity_id = 'a'")
    assert ch.check(good, ["a"]) == 1
    for ids in (["a", "a"], ["a", "c"]):
        with pytest.raises(ValueError):
            ch.check(good, ids)
    for bad in ({"k": 0}, {"p": 0}, {"distance": "cosine"}):
        with pytest.raises(ValueError):
            SpaceConfig(**bad)


def test_settings():
    assert parse_broker_url("tcp://host:99") == ("host", 99) and parse_broker_url("host") == ("host", 1883)
    with pytest.raises(ValueError):
        WorkerConfig.load({})
    c = WorkerConfig.load({"JOB_ID": "7", "USE_GPU": "TRUE"})
    assert (c.broker, c.use_gpu, c.worker_id) == ("tcp://localhost:1883", True, "worker-7")
