import numpy as np
import pytest
from pyspark.sql import functions as F

from subspan import queries
from subspan.config import GraphConfig, SpaceConfig
from subspan.operators import baseline, topology
from subspan.operators import chunks as ch
from subspan.operators import graph as gr
from subspan.operators import paths
from subspan.operators.entity import adjacency, cosine_similarities, symmetric, with_diagonal
from subspan.plans.components import connected_components
from tests import model


def matrix(n, seed, ties=False):
    rng = np.random.default_rng(seed)
    d = rng.integers(1, 5, (n, n)).astype(float) if ties else rng.random((n, n)) + 0.1
    d = np.triu(d, 1)
    return d + d.T


def frames(spark, d):
    n = len(d)
    half = spark.createDataFrame([(i + 1, j + 1, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "src long, dst long, d double")
    entities = spark.createDataFrame([(i + 1, f"n{i:02d}", 1) for i in range(n)], "entity_idx long, entity_id string, n_chunks long")
    return symmetric(half), entities


def by_start(rows, *key):
    out = {}
    for r in sorted(rows, key=lambda r: r["hop"]):
        out.setdefault(tuple(r[k] for k in key), []).append(r)
    return out


CASES = [(1, False), (2, True), (3, True)]


@pytest.mark.parametrize("seed, ties", CASES)
def test_neighbours_and_greedy(spark, seed, ties):
    d = matrix(9, seed, ties)
    dist, entities = frames(spark, d)
    got = {}
    for r in adjacency(dist, 3).orderBy("rank").collect():
        got.setdefault(r["src"] - 1, []).append(r["dst"] - 1)
    assert [got[i] for i in range(9)] == model.adjacency(d, 3)
    for (s,), hops in by_start(paths.greedy_paths(dist, entities, 4).collect(), "start").items():
        assert [h["node"] - 1 for h in hops] == model.greedy(d, s - 1, 4)
        assert hops[-1]["total"] == pytest.approx(sum(h["hop_distance"] for h in hops[1:]))
    long = by_start(paths.greedy_paths(dist, entities.where("entity_idx = 1"), 12).collect(), "start")
    assert len(long[(1,)]) == 9  # none is left after all are visited


def test_targeted_greedy(spark):
    d = matrix(6, 4)
    d[2, 4] = d[4, 2] = 0.0  # an entity at distance 0 from the target comes before it
    dist, entities = frames(spark, d)
    pairs = spark.createDataFrame([(a, b) for a in range(1, 7) for b in range(1, 7)], "start long, target long")
    for depth in (0, 1, 4):
        got = by_start(paths.greedy_paths_to(dist, entities, pairs, depth).collect(), "start", "target")
        for a in range(6):
            for b in range(6):
                want = model.greedy_to(d, a, b, depth)
                assert [h["node"] - 1 for h in got.get((a + 1, b + 1), [])] == (want or []), (a, b, depth)


@pytest.mark.parametrize("seed, ties", CASES)
def test_shortest_and_reachable(spark, seed, ties):
    d = matrix(12, seed, ties)
    dist, entities = frames(spark, d)
    knn = adjacency(dist, 2)
    adj = model.adjacency(d, 2)
    sources = entities.select(F.col("entity_idx").alias("source"))
    got = {(r["source"], r["node"]): r for r in paths.shortest_paths(knn, sources).collect()}
    for a in range(12):
        want = model.shortest(d, adj, a)
        assert {n - 1 for s, n in got if s == a + 1} == set(want)
        for b, total in want.items():
            r = got[a + 1, b + 1]
            p = [x - 1 for x in r["path"]]
            assert r["total"] == pytest.approx(total) and sum(d[x, y] for x, y in zip(p, p[1:])) == pytest.approx(total)
            assert all(y in adj[x] for x, y in zip(p, p[1:])) and (p[0], p[-1]) == (a, b)
    hops = paths.path_hops(paths.shortest_paths(knn, sources.where("source = 1")), dist).where("hop > 0").agg(F.count_if(F.col("hop_distance").isNull())).first()[0]
    assert hops == 0
    for h in (0, 1, 3):
        got = {(r["source"], r["node"]): (r["total"], r["hops"]) for r in paths.reachable(knn, sources, h).collect()}
        for a in range(12):
            want = model.reachable(d, adj, a, h)
            assert {n - 1 for s, n in got if s == a + 1} == set(want)
            for b, (total, n) in want.items():
                assert got[a + 1, b + 1][0] == pytest.approx(total) and got[a + 1, b + 1][1] == n


@pytest.mark.parametrize("seed, ties", CASES)
def test_topology(spark, seed, ties):
    d = matrix(14, seed, ties)
    dist, entities = frames(spark, d)
    knn = adjacency(dist, 2)
    adj = model.adjacency(d, 2)
    edges = {(min(i, j), max(i, j)) for i in range(14) for j in adj[i] if i in adj[j]}
    assert {(int(r["a"][1:]), int(r["b"][1:])) for r in topology.mutual_edges(knn, entities).collect()} == edges
    roots = model.components(14, edges)
    members = topology.communities(knn, entities)
    rows = members.collect()
    assert {int(r["member"][1:]): int(r["root"][1:]) for r in rows} == dict(enumerate(roots))
    order = sorted({(-roots.count(x), x) for x in roots})
    number = {x: i + 1 for i, (_, x) in enumerate(order)}
    assert all(r["community"] == number[int(r["root"][1:])] and r["size"] == roots.count(int(r["root"][1:])) for r in rows)
    got = {int(r["member"][1:]): int(r["attractor"][1:]) for r in topology.basins(dist, entities).collect()}
    assert got == {i: model.attractor(d, i) for i in range(14)}
    got = {int(r["entity"][1:]): (r["home"], r["reached"]) for r in topology.bridges(knn, entities, members).collect()}
    want = {i: (number[roots[i]], sorted({number[roots[j]] for j in adj[i]})) for i in range(14)}
    assert got == {i: v for i, v in want.items() if any(x != v[0] for x in v[1])}
    degree = [sum(i in a for a in adj) for i in range(14)]
    hubs = topology.hub_centrality(knn, entities)
    assert {r["entity_idx"] - 1: r["in_degree"] for r in hubs.collect()} == dict(enumerate(degree))
    g = topology.hub_concentration(hubs).first()[0]
    assert g == pytest.approx(model.gini(degree))
    assert topology.lorenz_concentration(hubs).first()[0] == pytest.approx(g - 1 / 14)


def test_single_entity(spark):
    entities = spark.createDataFrame([(1, "only", 2)], "entity_idx long, entity_id string, n_chunks long")
    dist = spark.createDataFrame([], "src long, dst long, d double")
    knn = adjacency(dist, 3)
    assert knn.collect() == []
    assert [(r["attractor"], r["member"]) for r in topology.basins(dist, entities).collect()] == [("only", "only")]
    assert [r["size"] for r in topology.communities(knn, entities).collect()] == [1]
    hubs = topology.hub_centrality(knn, entities)
    assert topology.hub_concentration(hubs).first()[0] == 0.0 and topology.lorenz_concentration(hubs).first()[0] == 0.0
    assert [r["node"] for r in paths.greedy_paths(dist, entities, 4).collect()] == [1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 299)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert got[300] == got[299] == 299 and 200 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def clustered(spark, seed=42):
    """Seven entities of three chunks: three around c, three around -c, one anywhere."""
    rng = np.random.default_rng(seed)
    c = rng.standard_normal(20)
    rows = []
    for e in range(7):
        middle = c if e < 3 else -c if e < 6 else rng.standard_normal(20)
        rows += [(len(rows) + n, (middle + 0.05 * rng.standard_normal(20)).tolist(), f"N{e + 1}") for n in range(3)]
    return ch.from_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, o string"), F.col("o"))


def test_build_save_load(spark, tmp_path):
    g = gr.build_graph(clustered(spark), SpaceConfig(10, 2), GraphConfig(2, 5), all_tangents=True)
    assert (g.entities.count(), g.dist.count(), g.knn.count(), g.tangents.count()) == (7, 42, 14, 21)
    both = g.dist.join(g.dist.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("e")), ["src", "dst"])
    assert both.where("d <> e OR d < 0 OR d > 2.2215").count() == 0 and with_diagonal(g.dist, g.entities).count() == 49
    again = gr.load_graph(spark, gr.save_graph(g, str(tmp_path / "graph")))
    for name in ("entities", "dist", "knn"):
        assert sorted(map(tuple, getattr(again, name).collect())) == sorted(map(tuple, getattr(g, name).collect()))
    assert (again.space, again.graph, again.tangents) == (g.space, g.graph, None)
    assert again.index_of("N3") == 3
    with pytest.raises(ValueError, match="unknown entity"):
        again.index_of("X")
    assert sum(r["in_degree"] for r in topology.hub_centrality(g.knn, g.entities).collect()) == 14
    assert {frozenset(r["member"] for r in rows) for rows in _groups(topology.communities(g.knn, g.entities))}


def _groups(members):
    out = {}
    for r in members.collect():
        out.setdefault(r["community"], []).append(r)
    return out.values()


def test_duplicate_vectors_by_either_rule(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12, 4))
    x[11] = x[0]
    rows = spark.createDataFrame([(i, x[i].tolist(), f"e{i % 3}") for i in range(12)], "vec_id long, embedding array<double>, o string")
    c = ch.from_vectors(rows, F.col("o"))
    a, b = (gr.build_graph(c, SpaceConfig(4, 2), GraphConfig(1, 4), rule).dist.where("src = 1").orderBy("dst").collect() for rule in ("duplicate", "index"))
    assert [r["d"] for r in a] != [r["d"] for r in b]


def test_cosine_baseline(spark):
    c = clustered(spark)
    g = gr.from_scores(ch.entities_of(c), cosine_similarities(c), 2, lower_is_closer=False)
    rows = sorted(c.collect(), key=lambda r: r["chunk_id"])
    unit = {}
    for r in rows:
        v = np.array(r["vec"])
        unit.setdefault(r["entity_idx"], []).append(v / np.linalg.norm(v))
    for r in g.dist.collect():
        assert r["d"] == pytest.approx(np.mean(np.array(unit[r["src"]]) @ np.array(unit[r["dst"]]).T))
    near = {}
    for r in g.knn.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    assert all(near[i] == {1, 2, 3} - {i} for i in (1, 2, 3))
    ranking = baseline.cosine_ranking(c, c)
    assert ranking.count() == 21 * 20
    top = baseline.cosine_ranking(c, c, 4)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, ranking.where("rank <= 4").collect()))
    sizes = ch.entities_of(c)
    precise = baseline.precision_at(ranking, sizes)
    assert precise.count() == 21 and precise.agg(F.min("k"), F.max("k")).first()[:] == (2, 2)
    compared = baseline.compare_precision(precise, precise)
    assert {r["winner"] for r in compared.collect()} == {"tie"}
    assert baseline.overall_precision(precise, True).first()[0] == pytest.approx(baseline.overall_precision(precise, False).first()[0])
    agree = baseline.nearest_agreement(g.dist, g.dist, a_lower=False)
    assert all(r["agree"] for r in agree.collect())
    same = baseline.path_divergence(g.dist, g.dist, g.entities, a_lower=False).first()
    assert (same["different"], same["percent"]) == (0, 0.0) and same["compared"] == 28
    edges = topology.mutual_edges(g.knn, g.entities)
    assert {r["side"] for r in baseline.edge_overlap(edges, edges).collect()} == {"both"}
    assert baseline.edge_overlap(edges, edges.where("false")).where("side = 'a only'").count() == edges.count()


def test_precision_at_size_makes_no_ranking(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, (60, 3)).astype(float)  # many ties, copies and zero vectors
    rows = [(i, v.tolist(), int(rng.integers(0, 4)) if i else 9) for i, v in enumerate(x)]
    c = ch.by_label(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    sizes = ch.entities_of(c)
    listed = lambda t: sorted((r["id"], r["entity_idx"], r["k"], round(r["precision"], 9)) for r in t.collect())
    want = listed(baseline.precision_at(baseline.cosine_ranking(c, c), sizes))
    assert listed(baseline.cosine_precision_at_size(c, sizes)) == want and 0 < len(want) < 60
    bases = np.linalg.qr(rng.integers(-1, 2, (60, 4, 2)) + 0.5 * np.eye(4, 2))[0].transpose(0, 2, 1)
    t = c.select("entity_idx", "chunk_id").join(spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(bases)], "chunk_id long, basis array<array<double>>"), "chunk_id")
    assert listed(baseline.subspace_precision_at_size(t, sizes, 2)) == listed(baseline.precision_at(baseline.subspace_ranking(t, 2), sizes))
    assert baseline.cosine_precision_at_size(c.where("false"), sizes).count() == 0

    def forbidden(*_, **__):
        raise AssertionError("a row for each pair")

    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(rng.standard_normal((90, 8)))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(baseline, "rank_tangents", forbidden)
    assert queries.QUERIES["i4_overall_precision"](spark, str(tmp_path)).count() == 2
    monkeypatch.setattr(baseline, "ranked_pairs", forbidden)
    assert queries.QUERIES["i3_precision_at_size"](spark, str(tmp_path)).count() == 180
