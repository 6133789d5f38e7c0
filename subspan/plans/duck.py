"""DuckDB SQL for the same results, by other means: bases from power iteration instead of a decomposition.

Neighbourhood Gram matrices are squared until only the leading direction is left, which gives one
basis vector after the other; the rest is joins, windows and the closed form for two planes.
"""

from __future__ import annotations

SQUARINGS = 14

ENTITIES = {
    "label": "CAST(label AS VARCHAR)",
    "e50": "concat_ws('_', CAST(label AS VARCHAR), CAST(vec_id % 5 AS VARCHAR))",
}


def chunks(entity: str = "label") -> str:
    """CTE chunks (entity_idx, entity_id, chunk_pos, chunk_id, vec) and entities."""
    return f"""raw AS MATERIALIZED (SELECT {ENTITIES[entity]} AS entity_id, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
entities AS MATERIALIZED (SELECT entity_id, row_number() OVER (ORDER BY min(chunk_id)) AS entity_idx, count(*) AS n_chunks FROM raw GROUP BY entity_id),
chunks AS MATERIALIZED (SELECT entity_idx, raw.entity_id, row_number() OVER (PARTITION BY raw.entity_id ORDER BY chunk_id) AS chunk_pos, chunk_id, vec, n_chunks
  FROM raw JOIN entities USING (entity_id))"""


def representatives(m: int = 5) -> str:
    picks = ", ".join(f"CAST(round_even(1 + (n_chunks - 1) * {t} / CAST({m - 1} AS DOUBLE), 0) AS BIGINT)" for t in range(m))
    return f"reps AS MATERIALIZED (SELECT * FROM chunks WHERE n_chunks <= {m} OR chunk_pos IN ({picks}))"


def neighbours(k: int = 20, points: str = "reps", duplicates: bool = True) -> str:
    """CTE nb (i, j, r, d2) of the k nearest chunks of each point."""
    own = "d2 >= 1e-24" if duplicates else "i <> j"
    return f"""nb AS MATERIALIZED (SELECT * FROM (SELECT i, j, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM (
  SELECT a.chunk_id AS i, b.chunk_id AS j, pow(list_distance(a.vec, b.vec), 2) AS d2 FROM {points} a, chunks b) WHERE {own}) WHERE r <= {k})"""


def bases(p: int = 2) -> str:
    """CTEs up to u0 .. u(p-1) (i, u): orthonormal bases of the points' neighbourhoods, one CTE a vector."""
    out = ["""nv AS MATERIALIZED (SELECT nb.i, nb.r, c.vec FROM nb JOIN chunks c ON c.chunk_id = nb.j)""",
        """mean AS (SELECT i, list(m ORDER BY pos) AS m FROM (SELECT i, pos, avg(x) AS m FROM (
  SELECT i, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM nv) GROUP BY i, pos) GROUP BY i)""",
        """x AS MATERIALIZED (SELECT nv.i, nv.r, list_transform(list_zip(vec, m), lambda z: z[1] - z[2]) AS v FROM nv JOIN mean USING (i))""",
        """g0 AS MATERIALIZED (SELECT a.i, a.r AS r, b.r AS c, list_dot_product(a.v, b.v) AS g FROM x a JOIN x b USING (i))"""]  # fmt: skip
    for n in range(p):
        out.append(f"s{n}_0 AS MATERIALIZED (SELECT i, r, c, g / sum(CASE WHEN r = c THEN g END) OVER (PARTITION BY i) AS g FROM g{n})")
        for t in range(SQUARINGS):
            out.append(f"""s{n}_{t + 1} AS MATERIALIZED (SELECT i, r, c, g / sum(CASE WHEN r = c THEN g END) OVER (PARTITION BY i) AS g FROM (
  SELECT a.i, a.r, b.c, sum(a.g * b.g) AS g FROM s{n}_{t} a JOIN s{n}_{t} b ON a.i = b.i AND a.c = b.r GROUP BY a.i, a.r, b.c))""")
        last = f"s{n}_{SQUARINGS}"
        out += [f"top{n} AS (SELECT i, arg_max(r, g) AS r FROM {last} WHERE r = c GROUP BY i)",
            f"w{n} AS MATERIALIZED (SELECT s.i, s.r, s.g / sqrt(dia.g) AS w FROM {last} s JOIN top{n} t ON s.i = t.i AND s.c = t.r JOIN {last} dia ON dia.i = t.i AND dia.r = t.r AND dia.c = t.r)",
            f"l{n} AS MATERIALIZED (SELECT g.i, sum(a.w * g.g * b.w) AS l FROM g{n} g JOIN w{n} a ON a.i = g.i AND a.r = g.r JOIN w{n} b ON b.i = g.i AND b.r = g.c GROUP BY g.i)",
            f"""u{n} AS MATERIALIZED (SELECT i, list(v ORDER BY pos) AS u FROM (SELECT e.i, pos, sum(x * w) / sqrt(any_value(l)) AS v FROM (
  SELECT i, r, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM x) e JOIN w{n} w ON w.i = e.i AND w.r = e.r JOIN l{n} l ON l.i = e.i GROUP BY e.i, pos) GROUP BY i)""",
            f"g{n + 1} AS MATERIALIZED (SELECT g.i, g.r, g.c, g.g - l.l * a.w * b.w AS g FROM g{n} g JOIN w{n} a ON a.i = g.i AND a.r = g.r JOIN w{n} b ON b.i = g.i AND b.r = g.c JOIN l{n} l ON l.i = g.i)"]
    return ",\n".join(out)


def _distance(p: int, metric: str) -> str:
    dots = [f"list_dot_product(a{i}.u, b{j}.u)" for i in range(p) for j in range(p)]
    if metric == "chordal":
        return f"sqrt(greatest(0, {p} - ({' + '.join(f'pow({d}, 2)' for d in dots)})))"
    if p == 1:
        return f"acos(least(1, abs({dots[0]})))"
    return "geo2(" + ", ".join(dots) + ")"


#: sum of squared angles from trace and determinant of the squared product
_GEO = """sqrt(pow(acos(least(1, sqrt(greatest(0, tr / 2 + sqrt(greatest(0, tr * tr / 4 - det * det)))))), 2)
 + pow(acos(least(1, sqrt(greatest(0, tr / 2 - sqrt(greatest(0, tr * tr / 4 - det * det)))))), 2))"""


def plane_distances(left: str, right: str, on: str) -> str:
    """A subquery (a, b, distance) of chunks x of left and y of right: geodesic distances of their planes. Needs bases of both."""
    a, b, c, d = (f"list_dot_product(a{i}.u, b{j}.u)" for i in range(2) for j in range(2))
    joins = " ".join(f"JOIN u{i} a{i} ON a{i}.i = x.chunk_id JOIN u{i} b{i} ON b{i}.i = y.chunk_id" for i in range(2))
    return f"""(SELECT a, b, {_GEO} AS distance FROM (SELECT a, b, p * p + q * q + r * r + s * s AS tr, p * s - q * r AS det FROM (
  SELECT x.chunk_id AS a, y.chunk_id AS b, {a} AS p, {b} AS q, {c} AS r, {d} AS s FROM {left} x JOIN {right} y ON {on} {joins})))"""


def _cubic() -> str:
    """Sum of squared angles of two 3-d subspaces with inner products m00 .. m22: eigenvalues of the squared matrix in trigonometric form."""
    g = {(i, j): " + ".join(f"m{k}{i} * m{k}{j}" for k in range(3)) for i in range(3) for j in range(i, 3)}
    squares = ", ".join(f"{v} AS g{i}{j}" for (i, j), v in g.items())
    angle = "pow(acos(least(1, sqrt(greatest(0, {})))), 2)"
    return f"""(SELECT *, sqrt({angle.format('e1')} + {angle.format('3 * q - e1 - e3')} + {angle.format('e3')}) AS distance FROM (
  SELECT *, q + 2 * h * cos(phi) AS e1, q + 2 * h * cos(phi + 2 * pi() / 3) AS e3 FROM (
  SELECT *, CASE WHEN h > 0 THEN acos(greatest(-1, least(1, ((g00 - q) * ((g11 - q) * (g22 - q) - g12 * g12) - g01 * (g01 * (g22 - q) - g12 * g02) + g02 * (g01 * g12 - (g11 - q) * g02)) / (2 * h * h * h)))) / 3 ELSE 0 END AS phi FROM (
  SELECT *, sqrt((pow(g00 - q, 2) + pow(g11 - q, 2) + pow(g22 - q, 2) + 2 * (g01 * g01 + g02 * g02 + g12 * g12)) / 6) AS h FROM (
  SELECT *, (g00 + g11 + g22) / 3 AS q FROM (SELECT src, dst, {squares} FROM mm))))))"""


def entity_pairs(p: int = 2, metric: str = "geodesic", with_self: bool = False) -> str:
    """CTE half (src, dst, d), src < dst (<= with_self): means over pairs of representatives."""
    joins = " ".join(f"JOIN u{i} a{i} ON a{i}.i = x.chunk_id JOIN u{i} b{i} ON b{i}.i = y.chunk_id" for i in range(p))
    pairs = f"FROM reps x JOIN reps y ON x.entity_idx {'<=' if with_self else '<'} y.entity_idx {joins}"
    if metric == "geodesic" and p == 2:
        a, b, c, d = (f"list_dot_product(a{i}.u, b{j}.u)" for i in range(2) for j in range(2))
        return f"""half AS MATERIALIZED (SELECT src, dst, avg({_GEO}) AS d FROM (
  SELECT src, dst, a * a + b * b + c * c + d * d AS tr, a * d - b * c AS det FROM (
    SELECT x.entity_idx AS src, y.entity_idx AS dst, {a} AS a, {b} AS b, {c} AS c, {d} AS d {pairs})) GROUP BY src, dst)"""
    if metric == "geodesic" and p == 3:
        dots = ", ".join(f"list_dot_product(a{i}.u, b{j}.u) AS m{i}{j}" for i in range(3) for j in range(3))
        return f"mm AS MATERIALIZED (SELECT x.entity_idx AS src, y.entity_idx AS dst, {dots} {pairs}), half AS MATERIALIZED (SELECT src, dst, avg(distance) AS d FROM {_cubic()} GROUP BY src, dst)"
    return f"half AS MATERIALIZED (SELECT x.entity_idx AS src, y.entity_idx AS dst, avg({_distance(p, metric)}) AS d {pairs} GROUP BY 1, 2)"


DIST = "dist AS MATERIALIZED (SELECT src, dst, d FROM half WHERE src <> dst UNION ALL SELECT dst, src, d FROM half WHERE src <> dst)"


def adjacency(k: int = 3, order: str = "ASC", name: str = "knn", dist: str = "dist") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d {order}, dst) AS rank FROM {dist} WHERE src <> dst) WHERE rank <= {k})"


def distances(entity: str = "label", k: int = 20, p: int = 2, metric: str = "geodesic", m: int = 5, duplicates: bool = True, with_self: bool = False) -> str:
    return ",\n".join([chunks(entity), representatives(m), neighbours(k, "reps", duplicates), bases(p), entity_pairs(p, metric, with_self), DIST])


def graph(entity: str = "e50", k_graph: int = 3, **more) -> str:
    return distances(entity, **more) + ",\n" + adjacency(k_graph)


def cosine_graph(entity: str = "e50", k_graph: int = 3, tag: str = "c") -> str:
    """CTEs ch, cd, ck: mean cosine over all chunk pairs, both directions, and its neighbour graph. Needs chunks."""
    return f"""un AS MATERIALIZED (SELECT entity_idx, chunk_id, chunk_pos, n_chunks, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS v FROM chunks),
{tag}h AS MATERIALIZED (SELECT a.entity_idx AS src, b.entity_idx AS dst, avg(list_dot_product(a.v, b.v)) AS d FROM un a JOIN un b ON a.entity_idx < b.entity_idx GROUP BY 1, 2),
{tag}d AS MATERIALIZED (SELECT src, dst, d FROM {tag}h UNION ALL SELECT dst, src, d FROM {tag}h),
{adjacency(k_graph, "DESC", f"{tag}k", f"{tag}d")}"""


def greedy(depth: int, dist: str = "dist", order: str = "ASC", tag: str = "p") -> str:
    """CTEs tag0 .. tag<depth> (start, hop, node, hop_distance, total, visited) of open greedy walks."""
    out = [f"{tag}0 AS (SELECT entity_idx AS start, 0 AS hop, entity_idx AS node, CAST(NULL AS DOUBLE) AS hop_distance, CAST(0 AS DOUBLE) AS total, [entity_idx] AS visited FROM entities)"]
    for h in range(1, depth + 1):
        out.append(f"""{tag}{h} AS MATERIALIZED (SELECT start, {h} AS hop, dst AS node, d AS hop_distance, total + d AS total, list_append(visited, dst) AS visited FROM (
  SELECT p.start, p.total, p.visited, e.dst, e.d, row_number() OVER (PARTITION BY p.start ORDER BY e.d {order}, e.dst) AS n
  FROM {tag}{h - 1} p JOIN {dist} e ON e.src = p.node WHERE NOT list_contains(p.visited, e.dst)) WHERE n = 1)""")
    return ",\n".join(out)


def reach(hops: int, edges: str = "knn") -> str:
    """CTEs r0 .. r<hops> (source, node, total, hops) of cheapest bounded walks."""
    out = ["r0 AS (SELECT entity_idx AS source, entity_idx AS node, CAST(0 AS DOUBLE) AS total, 0 AS hops FROM entities)"]
    for h in range(1, hops + 1):
        out.append(f"""r{h} AS MATERIALIZED (SELECT source, node, total, hops FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY total, hops) AS n FROM (
  SELECT * FROM r{h - 1} UNION ALL SELECT r.source, e.dst, r.total + e.d, r.hops + 1 FROM r{h - 1} r JOIN {edges} e ON e.src = r.node)) WHERE n = 1)""")
    return ",\n".join(out)


def components(edges: str = "mutual", nodes: str = "(SELECT entity_id AS n FROM entities)", tag: str = "comm") -> str:
    """CTEs ending in tag (community, root, size, member); needs WITH RECURSIVE and edges (a, b)."""
    return f"""{tag}_e AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
{tag}_r AS (SELECT n AS a, n AS b FROM {nodes} UNION SELECT r.a, e.b FROM {tag}_r r JOIN {tag}_e e ON r.b = e.a),
{tag}_m AS MATERIALIZED (SELECT a AS member, min(b) AS root FROM {tag}_r GROUP BY a),
{tag}_g AS (SELECT root, count(*) AS size FROM {tag}_m GROUP BY root),
{tag} AS MATERIALIZED (SELECT community, m.root, size, member FROM {tag}_m m JOIN (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) AS community FROM {tag}_g) g ON g.root = m.root)"""


def mutual(knn: str = "knn", name: str = "mutual") -> str:
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT least(x.entity_id, y.entity_id) AS a, greatest(x.entity_id, y.entity_id) AS b
  FROM {knn} k JOIN {knn} o ON o.src = k.dst AND o.dst = k.src JOIN entities x ON x.entity_idx = k.src JOIN entities y ON y.entity_idx = k.dst)"""


def hubs(knn: str = "knn", name: str = "hubs") -> str:
    return f"{name} AS MATERIALIZED (SELECT entity_id AS entity, entity_idx, count(k.dst) AS in_degree FROM entities LEFT JOIN {knn} k ON k.dst = entity_idx GROUP BY 1, 2)"


def nearest(dist: str = "dist", order: str = "ASC", name: str = "nn") -> str:
    return f"{name} AS MATERIALIZED (SELECT src AS node, dst AS next FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d {order}, dst) AS n FROM {dist} WHERE src <> dst) WHERE n = 1)"
