"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Entities are the labels of `embeddings` (10), or label and vec_id mod 5 (50) where a graph is asked
for. Distances are rounded to 6 digits in what is returned; ranks come from unrounded ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.config import GraphConfig, SpaceConfig
from subspan.functions import text as md
from subspan.functions import vectors as vec
from subspan.operators import baseline as base
from subspan.operators import chunks as ch
from subspan.operators import entity as ent
from subspan.operators import graph as gr
from subspan.operators import paths, ranking, topology
from subspan.operators.knn import nearest
from subspan.operators.tangent import tangents_of_chunks
from subspan.plans import duck
from subspan.plans.lineage import durable, scratch
from subspan.sources import corpus, jobs
from subspan.streaming import jobs as worker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SPACE, GRAPH = SpaceConfig(), GraphConfig()


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_chunks(spark, sf_dir) -> DataFrame:
    return ch.by_label(table(spark, sf_dir, "embeddings"))


def e50_chunks(spark, sf_dir) -> DataFrame:
    return ch.by_label_and_rest(table(spark, sf_dir, "embeddings"))


def e50_graph(spark, sf_dir) -> gr.Graph:
    return gr.build_graph(e50_chunks(spark, sf_dir), SPACE, GRAPH)


def cosine_graph(chunks: DataFrame, k: int = 3) -> gr.Graph:
    return gr.from_scores(ch.entities_of(chunks), ent.cosine_similarities(chunks), k, lower_is_closer=False)


def r6(c):
    return F.round(c, 6)


def points(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("id"), "vec")


# ---------------------------------------------------------------- sources and scalars


@query("SELECT n_name AS name, replace(n_name, ' ', '-') AS host, CASE WHEN n_nationkey % 3 = 0 THEN 1883 ELSE CAST(n_nationkey AS INTEGER) + 1000 END AS port FROM nation")
def a5_broker_address(spark, sf_dir):
    url = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "tcp://").otherwise(""), F.replace(F.col("n_name"), F.lit(" "), F.lit("-")), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit(":"), (F.col("n_nationkey") + 1000).cast("string"))))
    host, port = jobs.broker_address("url")
    return table(spark, sf_dir, "nation").withColumn("url", url).select(F.col("n_name").alias("name"), host.alias("host"), port.alias("port"))


_REQUEST = """'{"job_id":"j' || conv_id || '-' || turn || '","mode":"' || CASE WHEN turn % 2 = 0 THEN 'build' ELSE 'query' END || '","query":{"graph":"g","query":{"type":"reachable","from":"' || role || '","depth":' || turn || '}}}'"""


@query("SELECT DISTINCT 'j' || conv_id || '-' || turn AS job_id, CASE WHEN turn % 2 = 0 THEN 'build' ELSE 'query' END AS mode, role AS from_id, CAST(turn AS INTEGER) AS depth, false AS broken FROM conversations")
def a7_parse_requests(spark, sf_dir):
    parsed = jobs.parse_requests(table(spark, sf_dir, "conversations").select(F.expr(_REQUEST).alias("value")))
    q = "request.query.query"
    return parsed.select("request.job_id", "request.mode", F.col(f"{q}.from").alias("from_id"), F.col(f"{q}.depth").alias("depth"), F.col("error").isNotNull().alias("broken")).distinct()


@query("""SELECT '{"job_id":"' || n_name || '","success":' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false,"error":"bad"' END || ',"worker_id":"w"}' AS value FROM nation""")
def a8_serialize_results(spark, sf_dir):
    even = F.col("n_nationkey") % 2 == 0
    return jobs.serialize_results(table(spark, sf_dir, "nation").select(F.col("n_name").alias("job_id"), even.alias("success"), F.when(~even, "bad").alias("error"), F.lit("w").alias("worker_id")))


@query(f"WITH {duck.chunks('e50')} SELECT entity_idx, entity_id, chunk_pos, chunk_id FROM chunks")
def a11_chunks(spark, sf_dir):
    return e50_chunks(spark, sf_dir).select("entity_idx", "entity_id", "chunk_pos", "chunk_id")


@query("SELECT e, CASE WHEN e = 'chordal' THEN 'chordal' ELSE 'geodesic' END AS metric FROM (SELECT DISTINCT CASE WHEN value > 50 THEN 'chordal' ELSE event_type END AS e FROM events)")
def a12_metric_name(spark, sf_dir):
    e = F.when(F.col("value") > 50, "chordal").otherwise(F.col("event_type")).alias("e")
    return table(spark, sf_dir, "events").select(e).distinct().select("e", jobs.metric_of("e").alias("metric"))


@query("SELECT vec_id, round(pow(list_distance(CAST(embedding AS DOUBLE[]), CAST(o AS DOUBLE[])), 2), 6) AS d2 FROM embeddings, (SELECT embedding AS o FROM embeddings WHERE vec_id = 0)")
def c1_squared_distance(spark, sf_dir):
    e = ch.from_vectors(table(spark, sf_dir, "embeddings"), F.lit("all"))
    one = e.where("chunk_id = 0").select(F.col("vec").alias("o"))
    return e.crossJoin(F.broadcast(one)).select(F.col("chunk_id").alias("vec_id"), r6(vec.squared_distance("vec", "o")).alias("d2"))  # one row is broadcast


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n)), 6) AS total FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def c2_normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", r6(F.aggregate(vec.normalise("v"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def c5_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    return rows.groupBy("label", (F.col("p") + 1).alias("pos")).agg(r6(F.avg("x")).alias("mean"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS rounded, round(acos(least(1, greatest(0, l_discount * 12))), 6) AS angle FROM lineitem")
def c8_round_and_clamp(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", vec.round_half_even(F.col("l_quantity") / 2).cast("long").alias("rounded"), r6(vec.angle(F.col("l_discount") * 12)).alias("angle"))


# ---------------------------------------------------------------- text chunks

_MD = "SELECT doc_id, string_agg(CASE WHEN pos % 5 = 0 THEN '## ' ELSE '' END || line || CASE WHEN pos % 3 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY pos) AS md FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY doc_id"
_SECTIONS = f"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(md, '\\n(#{{2,3}}[ \\t\\r])', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS parts FROM ({_MD})"


def markdown(spark, sf_dir) -> DataFrame:
    """documents with headings and blank lines: every fifth line a heading, a blank line after every third."""
    lines = F.split("text", "\n", -1)
    marked = F.transform(lines, lambda x, i: F.concat(F.when((i + 1) % 5 == 0, "## ").otherwise(""), x, F.when((i + 1) % 3 == 0, "\n").otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("md"))


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(part) AS part FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM ({_SECTIONS}))")
def b1_sections(spark, sf_dir):
    rows = markdown(spark, sf_dir).select("doc_id", F.posexplode(md.sections("md")).alias("p", "part"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), F.md5("part").alias("part"))


_MERGED = f"""WITH RECURSIVE s AS (SELECT doc_id, parts, len(parts) AS n FROM ({_SECTIONS}) WHERE len(parts) > 0),
f AS (SELECT doc_id, parts, n, 1 AS k, [parts[1]] AS done FROM s UNION ALL
  SELECT doc_id, parts, n, k + 1, CASE WHEN length(done[-1]) + length(parts[k + 1]) < 400 AND length(parts[k + 1]) < 200
    THEN list_append(done[:-2], done[-1] || chr(10) || chr(10) || parts[k + 1]) ELSE list_append(done, parts[k + 1]) END FROM f WHERE k < n)
SELECT doc_id, done AS merged FROM f WHERE k = n"""


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(part) AS part FROM (SELECT doc_id, unnest(merged) AS part, generate_subscripts(merged, 1) AS pos FROM ({_MERGED}))")
def b2_merge_short(spark, sf_dir):
    rows = markdown(spark, sf_dir).select("doc_id", F.posexplode(md.merge_short(md.sections("md"))).alias("p", "part"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), F.md5("part").alias("part"))


_CHUNKS = f"""{_MERGED.replace("SELECT doc_id, done AS merged FROM f WHERE k = n", "")},
m AS (SELECT doc_id, unnest(done) AS part, generate_subscripts(done, 1) AS pos FROM f WHERE k = n),
l AS (SELECT doc_id, pos, string_split_regex(part, '\n\n+') AS ps FROM m WHERE length(part) > {md.MAX_CHARS}),
h AS (SELECT doc_id, pos, ps, 1 AS i, [ps[1]] AS acc FROM l UNION ALL
  SELECT doc_id, pos, ps, i + 1, CASE WHEN length(acc[-1]) + length(ps[i + 1]) > {md.MAX_CHARS} AND trim(acc[-1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
    THEN list_append(acc, ps[i + 1]) ELSE list_append(acc[:-2], acc[-1] || chr(10) || chr(10) || ps[i + 1]) END FROM h WHERE i < len(ps)),
w AS (SELECT doc_id, pos, 1 AS sub, part FROM m WHERE length(part) <= {md.MAX_CHARS} UNION ALL
  SELECT doc_id, pos, sub, part FROM (SELECT doc_id, pos, generate_subscripts(acc, 1) AS sub, trim(unnest(acc), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part FROM h WHERE i = len(ps)) WHERE part <> ''),
c AS (SELECT CAST(doc_id AS VARCHAR) AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS chunk_idx, part FROM w)
SELECT doc, chunk_idx, doc || '_' || CASE WHEN chunk_idx < 10 THEN '0' ELSE '' END || CAST(chunk_idx AS VARCHAR) AS chunk_id, length(part) AS chars, md5(part) AS text FROM c"""


@query(_CHUNKS)
def b3_chunk_markdown(spark, sf_dir):
    return md.chunk_markdown(markdown(spark, sf_dir), "doc_id", "md").select("doc", "chunk_idx", "chunk_id", F.length("text").alias("chars"), F.md5("text").alias("text"))


@query("SELECT conv_id, turn, role || '_' || CASE WHEN length(CAST(conv_id AS VARCHAR)) < 2 THEN lpad(CAST(conv_id AS VARCHAR), 2, '0') ELSE CAST(conv_id AS VARCHAR) END AS chunk_id FROM conversations")
def b4_chunk_id(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", md.chunk_id("role", "conv_id").alias("chunk_id"))


# ---------------------------------------------------------------- geometry


@query(f"WITH {duck.chunks()}, {duck.neighbours(20, 'chunks')} SELECT i AS id, j AS neighbour, CAST(r AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nb")
def d1_knn(spark, sf_dir):
    p = durable(points(label_chunks(spark, sf_dir)))
    return nearest(p, p, 20).withColumn("d2", r6("d2"))


@query(f"WITH {duck.chunks()}, {duck.neighbours(5, 'chunks', False)} SELECT i AS id, j AS neighbour, CAST(r AS INTEGER) AS rank, round(d2, 6) AS d2 FROM nb")
def d2_knn_by_index(spark, sf_dir):
    p = durable(points(label_chunks(spark, sf_dir)))
    return nearest(p, p, 5, self_exclusion="index").withColumn("d2", r6("d2"))


_TANGENTS = ",\n".join([duck.chunks(), duck.representatives(), duck.neighbours(), duck.bases()])
_ALL_TANGENTS = ",\n".join([duck.chunks(), duck.neighbours(points="chunks"), duck.bases()])


@query(f"""WITH {_ALL_TANGENTS}, w AS (SELECT i, unnest(u0.u) AS x, unnest(u1.u) AS y, unnest(m) AS c, list_sum(list_transform(u0.u, lambda x, k: x * k)) AS s0, list_sum(list_transform(u1.u, lambda x, k: x * k)) AS s1, generate_subscripts(u0.u, 1) AS pos
  FROM u0 JOIN u1 USING (i) JOIN mean USING (i)) SELECT i AS chunk_id, CAST(pos AS INTEGER) AS pos, round(c, 6) AS center, round(x * s0 + y * s1, 3) + 0.0 AS projected FROM w""")
def d4_tangent_projectors(spark, sf_dir):
    """Of every chunk the centre, and the whole projector applied to (1, 2, ...), by component; to 3 digits where singular values lie close."""
    chunks = durable(label_chunks(spark, sf_dir))
    t = tangents_of_chunks(chunks, 20, 2)
    along = lambda i: F.aggregate(F.transform(F.col("basis")[i], lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    t = t.select("chunk_id", "basis", F.posexplode("center").alias("p", "c"), along(0).alias("s0"), along(1).alias("s1"))
    value = F.col("basis")[0][F.col("p")] * F.col("s0") + F.col("basis")[1][F.col("p")] * F.col("s1")
    return t.select("chunk_id", (F.col("p") + 1).alias("pos"), r6("c").alias("center"), (F.round(value, 3) + 0.0).alias("projected"))


_ANGLES = f"""WITH {_TANGENTS}, pr AS (SELECT x.chunk_id AS a, y.chunk_id AS b, list_dot_product(a0.u, b0.u) AS p, list_dot_product(a0.u, b1.u) AS q, list_dot_product(a1.u, b0.u) AS r, list_dot_product(a1.u, b1.u) AS s
  FROM reps x JOIN reps y ON x.chunk_id < y.chunk_id JOIN u0 a0 ON a0.i = x.chunk_id JOIN u1 a1 ON a1.i = x.chunk_id JOIN u0 b0 ON b0.i = y.chunk_id JOIN u1 b1 ON b1.i = y.chunk_id),
t AS (SELECT a, b, p * p + q * q + r * r + s * s AS tr, abs(p * s - q * r) AS det FROM pr)
SELECT a, b, round(acos(least(1, (sqrt(tr + 2 * det) + sqrt(greatest(0, tr - 2 * det))) / 2)), 6) AS first, round(acos(least(1, abs(sqrt(tr + 2 * det) - sqrt(greatest(0, tr - 2 * det))) / 2)), 6) AS second,
  round(sqrt(pow(acos(least(1, (sqrt(tr + 2 * det) + sqrt(greatest(0, tr - 2 * det))) / 2)), 2) + pow(acos(least(1, abs(sqrt(tr + 2 * det) - sqrt(greatest(0, tr - 2 * det))) / 2)), 2)), 6) AS distance FROM t"""


@query(_ANGLES)
def d6_principal_angles(spark, sf_dir):
    chunks = durable(label_chunks(spark, sf_dir))
    t = durable(tangents_of_chunks(chunks, 20, 2, only=ch.representatives(chunks)).select(F.col("chunk_id").alias("id"), "basis"))
    first, second = F.col("angles")[0], F.col("angles")[1]
    return ranking.angle_pairs(t, 2).select("a", "b", r6(first).alias("first"), r6(second).alias("second"), r6(F.sqrt(first * first + second * second)).alias("distance"))


def _distances(spark, sf_dir, p, metric, with_self=False, exclusion="duplicate"):
    chunks = durable(label_chunks(spark, sf_dir))
    t = ent.chunk_tangents(chunks, SpaceConfig(20, p, metric), GRAPH, exclusion)
    return ent.entity_distances(t, p, metric, with_self).select("src", "dst", r6("d").alias("d"))


def _half(**more) -> str:
    return f"WITH {duck.distances(**more)} SELECT src, dst, round(d, 6) AS d FROM half"


@query(_half(metric="geodesic"))
def d7_geodesic_planes(spark, sf_dir):
    return _distances(spark, sf_dir, 2, "geodesic")


@query(_half(metric="chordal"))
def d8_chordal_planes(spark, sf_dir):
    return _distances(spark, sf_dir, 2, "chordal")


@query(_half(p=1))
def d8_geodesic_lines(spark, sf_dir):
    return _distances(spark, sf_dir, 1, "geodesic")


@query(_half(p=3, metric="chordal"))
def d8_chordal_3d(spark, sf_dir):
    return _distances(spark, sf_dir, 3, "chordal")


@query(_half(p=3).replace("round(d, 6)", "round(d, 3)"))
def d10_geodesic_3d(spark, sf_dir):
    """To 3 digits: where singular values lie close, the SQL's power iteration finds the third direction less exactly."""
    return _distances(spark, sf_dir, 3, "geodesic").withColumn("d", F.round("d", 3))


@query(f"WITH {duck.chunks()}, {duck.representatives()} SELECT entity_id, chunk_pos, chunk_id FROM reps")
def d11_representatives(spark, sf_dir):
    return ch.representatives(label_chunks(spark, sf_dir)).select("entity_id", "chunk_pos", "chunk_id")


@query(_half(with_self=True).replace("round(d, 6)", "round(d, 3)"))
def d12_entity_distance_with_self(spark, sf_dir):
    """To 3 digits: an angle near 0 loses half the digits of its cosine, in any method."""
    return _distances(spark, sf_dir, 2, "geodesic", with_self=True).withColumn("d", F.round("d", 3))


@query(_half(duplicates=False))
def d13_entity_distance_by_index(spark, sf_dir):
    return _distances(spark, sf_dir, 2, "geodesic", exclusion="index")


_RANKED = _ANGLES.replace("x.chunk_id < y.chunk_id", "x.chunk_pos = 1 AND x.chunk_id <> y.chunk_id")


@query(f"SELECT query_id, id, distance, rank FROM (SELECT a AS query_id, b AS id, distance, CAST(row_number() OVER (PARTITION BY a ORDER BY distance, b) AS INTEGER) AS rank FROM ({_RANKED})) WHERE rank <= 10")
def d14_rank_candidates(spark, sf_dir):
    chunks = durable(label_chunks(spark, sf_dir))
    reps = durable(ch.representatives(chunks))
    t = durable(tangents_of_chunks(chunks, 20, 2, only=reps).withColumnRenamed("chunk_id", "id"))
    ranked = ranking.rank_tangents(t.where("chunk_pos = 1"), t, 2, top=20, others=True).drop("rank")
    w = ranking.W.partitionBy("query_id").orderBy("distance", "id")  # by 6 digits, as the SQL has them
    return ranked.withColumn("distance", r6("distance")).withColumn("rank", F.row_number().over(w)).where("rank <= 10")


# ---------------------------------------------------------------- entity graph

_E50 = duck.graph("e50")


@query(f"WITH {duck.chunks('e50')} SELECT entity_idx, entity_id, n_chunks FROM entities")
def e1_entities(spark, sf_dir):
    return ch.entities_of(e50_chunks(spark, sf_dir))


@query("SELECT label, min(pos) AS first, max(pos) AS last, count(*) AS n FROM (SELECT label, row_number() OVER (ORDER BY label, vec_id) AS pos FROM embeddings) GROUP BY label")
def e1_contiguous_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    ahead = F.coalesce(F.sum("n").over(ranking.W.orderBy("label").rowsBetween(ranking.W.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("label").agg(F.count("*").alias("n")).select("label", ahead.alias("ahead"))  # one row a label
    rows = rows.join(offsets, "label").select("label", (F.col("ahead") + F.row_number().over(ranking.W.partitionBy("label").orderBy("vec_id"))).cast("long").alias("pos"))
    return ch.contiguous(rows, "label", "pos").withColumnRenamed("entity", "label")


@query(f"WITH {duck.distances('label')} SELECT src, dst, round(d, 6) AS d FROM dist")
def e4_distance_matrix(spark, sf_dir):
    return gr.build_graph(label_chunks(spark, sf_dir), SPACE, GRAPH).dist.withColumn("d", r6("d"))


@query(f"WITH {duck.graph('label')} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM knn")
def e5_adjacency(spark, sf_dir):
    return gr.build_graph(label_chunks(spark, sf_dir), SPACE, GRAPH).knn.select("src", "dst", "rank", r6("d").alias("distance"))


@query(f"WITH {_E50} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM knn")
def e7_build_graph(spark, sf_dir):
    return e50_graph(spark, sf_dir).knn.select("src", "dst", "rank", r6("d").alias("distance"))


@query(f"WITH {_E50} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM knn")
def a9_saved_graph(spark, sf_dir):
    path = gr.save_graph(e50_graph(spark, sf_dir), scratch(spark, "graph"))
    return gr.load_graph(spark, path).knn.select("src", "dst", "rank", r6("d").alias("distance"))


@query("SELECT len(embedding) AS width, count(*) AS chunks FROM embeddings GROUP BY ALL")
def e2_shape(spark, sf_dir):
    """The common length that building a graph asks of all vectors."""
    chunks = label_chunks(spark, sf_dir)
    return chunks.agg(F.lit(ch.check(chunks)).cast("long").alias("width"), F.count("*").alias("chunks"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS entity, 64 AS dimension, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def a13_read_embeddings(spark, sf_dir):
    """embeddings written as JSON corpora of at most 100 entries a file, and read again."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 100).cast("long").alias("file"), F.struct(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("doc"), F.col("embedding").cast("array<double>").alias("embedding")).alias("e"), F.size("embedding").alias("n"))
    files = v.groupBy("file").agg(F.max("n").alias("dimension"), F.collect_list("e").alias("entries"))
    path = scratch(spark, "corpora")
    files.select("file", F.to_json(F.struct(F.lit("own").alias("model"), "dimension", "entries")).alias("value")).write.partitionBy("file").text(path)
    got = corpus.read_embeddings(spark, f"{path}/*")
    return got.select("id", "entity", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT vec_id, CAST(label AS VARCHAR) AS entity, len(embedding) AS n FROM embeddings")
def a16_write_embeddings(spark, sf_dir):
    path = scratch(spark, "embeddings")
    corpus.write_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("entity"), "embedding"), path)
    return spark.read.schema("vec_id long, entity string, embedding array<double>").json(path).select("vec_id", "entity", F.size("embedding").cast("long").alias("n"))


@query(f"WITH {duck.chunks('e50')} SELECT entity_id AS asked, entity_idx FROM entities WHERE entity_idx IN (1, 7) UNION ALL SELECT 'nobody', NULL")
def f5_entity_index(spark, sf_dir):
    """Known entities have an index; asking for another raises."""
    entities = durable(ch.entities_of(e50_chunks(spark, sf_dir)))
    g = gr.Graph(entities, None, None, SPACE, GRAPH)
    rows = []
    for name in [r[0] for r in entities.where("entity_idx IN (1, 7)").select("entity_id").collect()] + ["nobody"]:
        try:
            rows.append((name, g.index_of(name)))
        except ValueError:
            rows.append((name, None))
    return spark.createDataFrame(rows, "asked string, entity_idx long")


# ---------------------------------------------------------------- paths

_HOPS = "start, CAST(hop AS INTEGER) AS hop, node, round(hop_distance, 6) AS hop_distance, round(total, 6) AS total"


def _walks(depth: int, tag: str = "p") -> str:
    return " UNION ALL ".join(f"SELECT * FROM {tag}{h}" for h in range(depth + 1))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"hop_distance": r6("hop_distance"), "total": r6("total")})


@query(f"WITH {_E50}, {duck.greedy(4)} SELECT {_HOPS} FROM ({_walks(4)})")
def f1_greedy_paths(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return _rounded(paths.greedy_paths(g.dist, g.entities, 4))


@query(f"""WITH {_E50}, pairs AS (SELECT a.entity_idx AS start, b.entity_idx AS target FROM entities a JOIN entities b ON b.entity_idx = (a.entity_idx * 7) % 50 + 1)
SELECT start, target, 0 AS hop, start AS node, CAST(NULL AS DOUBLE) AS hop_distance, CAST(0 AS DOUBLE) AS total FROM pairs
UNION ALL SELECT start, target, 1, target, round(d, 6), round(d, 6) FROM pairs JOIN dist ON src = start AND dst = target""")
def f2_greedy_paths_to(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    pairs = g.entities.select(F.col("entity_idx").alias("start"), (F.col("entity_idx") * 7 % 50 + 1).alias("target"))
    pairs = pairs.join(g.entities.select(F.col("entity_idx").alias("target")), "target", "left_semi")
    return _rounded(paths.greedy_paths_to(g.dist, g.entities, pairs, 4))


@query(f"WITH {_E50}, {duck.reach(24)} SELECT source, node, round(total, 6) AS total, CAST(hops AS INTEGER) AS hops FROM r24")
def f3_shortest_paths(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    found = paths.shortest_paths(durable(g.knn), g.entities.select(F.col("entity_idx").alias("source")))
    return found.select("source", "node", r6("total").alias("total"), (F.size("path") - 1).alias("hops"))


@query(f"WITH {_E50}, {duck.reach(3)} SELECT source, node, CAST(hops AS INTEGER) AS hops, round(total, 6) AS total FROM r3 WHERE source <> node")
def f4_reachable(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return paths.reachable(durable(g.knn), g.entities.select(F.col("entity_idx").alias("source"))).withColumn("total", r6("total"))


# ---------------------------------------------------------------- topology


@query(f"WITH {_E50}, {duck.mutual()} SELECT a, b FROM mutual")
def g1_mutual_edges(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.mutual_edges(durable(g.knn), g.entities)


@query(f"WITH RECURSIVE {_E50}, {duck.mutual()}, {duck.components()} SELECT community, root, size, member FROM comm")
def g2_communities(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.communities(durable(g.knn), g.entities)


def _basins(dist="dist", order="ASC") -> str:
    return f"""{duck.nearest(dist, order)}, pairs AS (SELECT a.node FROM nn a JOIN nn b ON b.node = a.next AND b.next = a.node),
walk AS (SELECT node AS start, node FROM nn UNION SELECT w.start, nn.next FROM walk w JOIN nn ON nn.node = w.node WHERE w.node NOT IN (SELECT node FROM pairs)),
att AS (SELECT start, node FROM walk WHERE node IN (SELECT node FROM pairs)),
bas AS (SELECT x.entity_id AS attractor, y.entity_id AS member FROM att JOIN entities x ON x.entity_idx = att.node JOIN entities y ON y.entity_idx = att.start),
bsz AS (SELECT attractor, count(*) AS size FROM bas GROUP BY attractor),
basins AS (SELECT basin, attractor, size, member FROM bas JOIN (SELECT attractor, size, row_number() OVER (ORDER BY size DESC, attractor) AS basin FROM bsz) USING (attractor))"""


@query(f"WITH RECURSIVE {_E50}, {_basins()} SELECT basin, attractor, size, member FROM basins")
def g3_basins(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.basins(g.dist, g.entities)


def _bridges(knn="knn") -> str:
    return f"""be AS (SELECT x.entity_id AS entity, hx.community AS home, hy.community AS there FROM {knn} k JOIN entities x ON x.entity_idx = k.src JOIN entities y ON y.entity_idx = k.dst
  JOIN comm hx ON hx.member = x.entity_id JOIN comm hy ON hy.member = y.entity_id),
bridges AS (SELECT DISTINCT entity, home, there FROM be WHERE entity IN (SELECT entity FROM be WHERE home <> there))"""


@query(f"WITH RECURSIVE {_E50}, {duck.mutual()}, {duck.components()}, {_bridges()} SELECT entity, home, there AS reached FROM bridges")
def g4_bridges(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.bridges(durable(g.knn), g.entities).select("entity", "home", F.explode("reached").alias("reached"))


@query(f"WITH {_E50}, {duck.hubs()} SELECT entity, entity_idx, in_degree FROM hubs")
def g5_hub_centrality(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.hub_centrality(g.knn, g.entities)


_PAIR_GINI = "SELECT round(sum(abs(a.in_degree - b.in_degree)) / (2.0 * count(DISTINCT a.entity) * (SELECT sum(in_degree) FROM hubs)), 6)"


@query(f"WITH {_E50}, {duck.hubs()} {_PAIR_GINI} AS gini FROM hubs a, hubs b")
def g6_hub_concentration(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.hub_concentration(topology.hub_centrality(g.knn, g.entities)).select(r6("gini").alias("gini"))


@query(f"WITH {_E50}, {duck.hubs()}, cum AS (SELECT sum(in_degree) OVER (ORDER BY in_degree, entity_idx ROWS UNBOUNDED PRECEDING) AS c FROM hubs) SELECT round(1 - 2 * sum(c) / (SELECT sum(in_degree) FROM hubs) / (SELECT count(*) FROM hubs), 6) AS concentration FROM cum")
def g7_lorenz_concentration(spark, sf_dir):
    g = e50_graph(spark, sf_dir)
    return topology.lorenz_concentration(topology.hub_centrality(g.knn, g.entities)).select(r6("concentration").alias("concentration"))


# ---------------------------------------------------------------- cosine baseline

_COS = f"{duck.chunks('e50')}, {duck.cosine_graph()}"
_BOTH = f"{_E50}, {duck.cosine_graph()}"
_COSRANK = f"""{duck.chunks('label')}, un AS (SELECT entity_idx, chunk_id, n_chunks, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS v FROM chunks),
cr AS MATERIALIZED (SELECT * FROM (SELECT a.chunk_id AS id, a.entity_idx, a.n_chunks, b.chunk_id AS other, b.entity_idx AS other_entity, list_dot_product(a.v, b.v) AS score,
  CAST(row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_dot_product(a.v, b.v) DESC, b.chunk_id) AS INTEGER) AS rank FROM un a, un b WHERE a.chunk_id <> b.chunk_id))"""


@query(f"WITH {_COSRANK} SELECT id, other, rank, round(score, 6) AS score FROM cr WHERE rank <= 10")
def i1_cosine_ranking(spark, sf_dir):
    c = durable(label_chunks(spark, sf_dir))
    return base.cosine_ranking(c, c, 10).select("id", "other", "rank", r6("score").alias("score"))


def _precision(k: str, ranks: str = "cr") -> str:
    return f"SELECT id, entity_idx, CAST({k} AS BIGINT) AS k, round(avg(CASE WHEN other_entity = entity_idx THEN 1.0 ELSE 0.0 END), 6) AS precision FROM {ranks} WHERE n_chunks > 1 AND rank <= {k} GROUP BY id, entity_idx, n_chunks"


_SUBRANK = f"""{duck.neighbours(points="chunks")}, {duck.bases()},
sr AS MATERIALIZED (SELECT a AS id, x.entity_idx, x.n_chunks, b AS other, y.entity_idx AS other_entity, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank
  FROM {duck.plane_distances("chunks", "chunks", "x.chunk_id <> y.chunk_id")} JOIN chunks x ON x.chunk_id = a JOIN chunks y ON y.chunk_id = b)"""


def _rankings(spark, sf_dir, top: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rankings by cosine and by subspace distance, and the entities."""
    c = durable(label_chunks(spark, sf_dir))
    return base.cosine_ranking(c, c, top), base.subspace_ranking(durable(tangents_of_chunks(c, SPACE.k, SPACE.p)), SPACE.p, top=top), durable(ch.entities_of(c))


def _both_precisions(spark, sf_dir, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Precision by cosine and by subspace distance; most None: at the entity's size."""
    if most is None:
        c = durable(label_chunks(spark, sf_dir))
        sizes = durable(ch.entities_of(c))
        return base.cosine_precision_at_size(c, sizes), base.subspace_precision_at_size(durable(tangents_of_chunks(c, SPACE.k, SPACE.p)), sizes, SPACE.p)
    cosine, subspace, sizes = _rankings(spark, sf_dir, most)
    return base.precision_at(cosine, sizes, most), base.precision_at(subspace, sizes, most)


def _by_method(cosine: DataFrame, subspace: DataFrame) -> DataFrame:
    return cosine.withColumn("method", F.lit("cosine")).unionByName(subspace.withColumn("method", F.lit("subspace")))


def _methods(one: str, other: str) -> str:
    return f"SELECT 'cosine' AS method, * FROM ({one}) UNION ALL SELECT 'subspace' AS method, * FROM ({other})"


@query(f"WITH {_COSRANK}, {_SUBRANK} " + _methods(_precision("least(n_chunks - 1, 10)"), _precision("least(n_chunks - 1, 10)", "sr")))
def i2_precision_at_10(spark, sf_dir):
    return _by_method(*_both_precisions(spark, sf_dir, 10)).withColumn("precision", r6("precision"))


@query(f"WITH {_COSRANK}, {_SUBRANK} " + _methods(_precision("n_chunks - 1"), _precision("n_chunks - 1", "sr")))
def i3_precision_at_size(spark, sf_dir):
    return _by_method(*_both_precisions(spark, sf_dir, None)).withColumn("precision", r6("precision"))


@query(f"WITH {_COSRANK}, {_SUBRANK}, a AS ({_precision('least(n_chunks - 1, 10)', 'sr')}), b AS ({_precision('least(n_chunks - 1, 10)')}), g AS (SELECT entity_idx, round(avg(a.precision), 5) AS subspace, round(avg(b.precision), 5) AS cosine FROM a JOIN b USING (id, entity_idx) GROUP BY entity_idx) SELECT *, CASE WHEN subspace > cosine THEN 'subspace' WHEN subspace < cosine THEN 'cosine' ELSE 'tie' END AS winner FROM g")
def i4_compare_precision(spark, sf_dir):
    cosine, subspace = _both_precisions(spark, sf_dir, 10)
    return base.compare_precision(subspace, cosine, "subspace", "cosine", 5)


@query(f"WITH {_COSRANK}, {_SUBRANK}, a AS ({_precision('least(n_chunks - 1, 10)')}), b AS ({_precision('n_chunks - 1', 'sr')}) SELECT 'cosine' AS method, round(avg(p), 5) AS precision FROM (SELECT avg(precision) AS p FROM a GROUP BY entity_idx) UNION ALL SELECT 'subspace', round(avg(precision), 5) FROM b")
def i4_overall_precision(spark, sf_dir):
    """Of cosine at 10 the mean over entities, of subspaces at the entity's size the mean over queries."""
    c = durable(label_chunks(spark, sf_dir))
    sizes = durable(ch.entities_of(c))
    cosine = base.precision_at(base.cosine_ranking(c, c, 10), sizes, 10)
    subspace = base.subspace_precision_at_size(durable(tangents_of_chunks(c, SPACE.k, SPACE.p)), sizes, SPACE.p)
    return _by_method(base.overall_precision(cosine, True), base.overall_precision(subspace, False)).withColumn("precision", F.round("precision", 5))


@query(f"WITH {_COS} SELECT src, dst, round(d, 6) AS d FROM cd")
def i5_cosine_matrix(spark, sf_dir):
    return cosine_graph(durable(e50_chunks(spark, sf_dir))).dist.withColumn("d", r6("d"))


@query(f"WITH {_COS} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(d, 6) AS d FROM ck")
def i7_cosine_neighbours(spark, sf_dir):
    return cosine_graph(durable(e50_chunks(spark, sf_dir))).knn.withColumn("d", r6("d"))


def _two_graphs(spark, sf_dir) -> tuple[gr.Graph, gr.Graph]:
    return e50_graph(spark, sf_dir), cosine_graph(durable(e50_chunks(spark, sf_dir)))


@query(f"WITH {_BOTH}, {duck.hubs()}, {duck.hubs('ck', 'chubs')} SELECT entity, hubs.in_degree AS a, chubs.in_degree AS b FROM hubs JOIN chubs USING (entity)")
def i8_degree_comparison(spark, sf_dir):
    s, c = _two_graphs(spark, sf_dir)
    return base.degree_comparison(s.knn, c.knn, s.entities)


@query(f"WITH {_BOTH}, {duck.mutual()}, {duck.mutual('ck', 'cm')} SELECT 'both' AS side, a, b FROM (SELECT * FROM mutual INTERSECT SELECT * FROM cm) UNION ALL SELECT 'a only', a, b FROM (SELECT * FROM mutual EXCEPT SELECT * FROM cm) UNION ALL SELECT 'b only', a, b FROM (SELECT * FROM cm EXCEPT SELECT * FROM mutual)")
def i9_edge_overlap(spark, sf_dir):
    s, c = _two_graphs(spark, sf_dir)
    return base.edge_overlap(topology.mutual_edges(s.knn, s.entities), topology.mutual_edges(c.knn, s.entities))


@query(f"WITH RECURSIVE {_COS}, {duck.mutual('ck', 'cm')}, {duck.components('cm')} SELECT community, root, size, member FROM comm")
def i10_cosine_communities(spark, sf_dir):
    g = cosine_graph(durable(e50_chunks(spark, sf_dir)))
    return topology.communities(durable(g.knn), g.entities)


@query(f"WITH RECURSIVE {_COS}, {_basins('cd', 'DESC')} SELECT basin, attractor, size, member FROM basins")
def i10_cosine_basins(spark, sf_dir):
    g = cosine_graph(durable(e50_chunks(spark, sf_dir)))
    return topology.basins(g.dist, g.entities, lower_is_closer=False)


@query(f"WITH RECURSIVE {_COS}, {duck.mutual('ck', 'cm')}, {duck.components('cm')}, {_bridges('ck')} SELECT entity, home, there AS reached FROM bridges")
def i10_cosine_bridges(spark, sf_dir):
    g = cosine_graph(durable(e50_chunks(spark, sf_dir)))
    return topology.bridges(durable(g.knn), g.entities).select("entity", "home", F.explode("reached").alias("reached"))


@query(f"WITH {_COS}, {duck.greedy(4, 'cd', 'DESC')} SELECT {_HOPS} FROM ({_walks(4)})")
def i11_cosine_greedy(spark, sf_dir):
    g = cosine_graph(durable(e50_chunks(spark, sf_dir)))
    return _rounded(paths.greedy_paths(g.dist, g.entities, 4, lower_is_closer=False))


@query(f"WITH {_BOTH}, {duck.greedy(4)}, {duck.greedy(4, 'cd', 'DESC', 'q')}, w AS (SELECT a.node AS x, b.node AS y FROM ({_walks(4)}) a JOIN ({_walks(4, 'q')}) b ON a.start = b.start AND a.hop = b.hop WHERE a.hop > 0) SELECT count(*) AS compared, count(*) FILTER (x <> y) AS different, round(100.0 * count(*) FILTER (x <> y) / count(*), 6) AS percent FROM w")
def i12_path_divergence(spark, sf_dir):
    s, c = _two_graphs(spark, sf_dir)
    return base.path_divergence(s.dist, c.dist, s.entities).withColumn("percent", r6("percent"))


@query(f"WITH {_BOTH}, {duck.nearest()}, {duck.nearest('cd', 'DESC', 'cn')} SELECT node, nn.next AS a, cn.next AS b, nn.next = cn.next AS agree FROM nn JOIN cn USING (node)")
def i13_nearest_agreement(spark, sf_dir):
    s, c = _two_graphs(spark, sf_dir)
    return base.nearest_agreement(s.dist, c.dist)


@query(f"""WITH {_COS}, {duck.nearest('cd', 'DESC')}, {duck.neighbours(points="chunks")}, {duck.bases()},
first AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM {duck.plane_distances("chunks", "chunks", "x.chunk_pos = 1 AND x.entity_idx <> y.entity_idx")})
SELECT node, next AS cosine, y.entity_idx AS subspace FROM nn JOIN chunks x ON x.entity_idx = node AND x.chunk_pos = 1 JOIN first ON a = x.chunk_id AND n = 1 JOIN chunks y ON y.chunk_id = b""")
def i14_nearest_document(spark, sf_dir):
    """By mean cosine over all pairs of chunks, and by the closest chunk to the first one's tangent space."""
    c = durable(e50_chunks(spark, sf_dir))
    t = durable(tangents_of_chunks(c, SPACE.k, SPACE.p).withColumnRenamed("chunk_id", "id"))
    best = ranking.rank_tangents(t.where("chunk_pos = 1"), t, SPACE.p, top=1, apart="entity_idx")
    own = t.select("id", "entity_idx")
    best = best.join(own.select("id", F.col("entity_idx").alias("subspace")), "id").join(own.select(F.col("id").alias("query_id"), F.col("entity_idx").alias("node")), "query_id")
    cosine = topology.nearest_of(cosine_graph(c).dist, lower_is_closer=False).select("node", F.col("next").alias("cosine"))
    return cosine.join(best, "node").select("node", "cosine", "subspace")


@query(f"SELECT query_id, id FROM (SELECT a AS query_id, b AS id, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS n FROM ({_RANKED}) WHERE b % 2 = 1) WHERE n = 1")
def i15_nearest_of_some(spark, sf_dir):
    chunks = durable(label_chunks(spark, sf_dir))
    reps = durable(ch.representatives(chunks))
    t = durable(tangents_of_chunks(chunks, 20, 2, only=reps).withColumnRenamed("chunk_id", "id"))
    ranked = ranking.rank_tangents(t.where("chunk_pos = 1"), t.where("id % 2 = 1"), 2, top=10, others=True)
    best = ranked.withColumn("n", F.row_number().over(ranking.W.partitionBy("query_id").orderBy(r6("distance"), "id"))).where("n = 1")
    return best.select("query_id", "id")


def _spread(value: str, ranks: str) -> str:
    return f"SELECT entity_idx, round(avg({value}), 5) AS mean, round(stddev_samp({value}), 5) AS std, round(min({value}), 5) AS low, round(max({value}), 5) AS high FROM {ranks} WHERE entity_idx = other_entity GROUP BY entity_idx"


@query(f"WITH {_COSRANK}, {_SUBRANK} " + _methods(_spread("score", "cr"), _spread("distance", "sr")))
def i16_spread_by_cluster(spark, sf_dir):
    c = durable(label_chunks(spark, sf_dir))
    t = durable(tangents_of_chunks(c, SPACE.k, SPACE.p))
    cosine = base.spread_within(c.select(F.col("chunk_id").alias("id"), "entity_idx", "vec"), "vec", base.cosines)
    subspace = base.spread_within(t.select(F.col("chunk_id").alias("id"), "entity_idx", F.flatten("basis").alias("flat")), "flat", ranking.subspace_scores(SPACE.p))
    return _by_method(cosine, subspace).withColumns({x: F.round(x, 5) for x in ("mean", "std", "low", "high")})


def _prefix_cosines(dims: str) -> str:
    return f"list_cosine_similarity(a.vec[:{dims}], b.vec[:{dims}])"


@query(f"""WITH {_ALL_TANGENTS}, {duck.representatives()},
near AS MATERIALIZED (SELECT * FROM (SELECT a.chunk_id AS a, b.chunk_id AS b, row_number() OVER (PARTITION BY a.chunk_id ORDER BY {_prefix_cosines('16')} DESC, b.chunk_id) AS n FROM reps a, chunks b) WHERE n <= 20),
d AS (SELECT p.a, p.b, distance, row_number() OVER (PARTITION BY p.a ORDER BY distance, p.b) AS rank FROM {duck.plane_distances("reps", "chunks", "true")} p JOIN near USING (a, b))
SELECT a AS query_id, b AS id, round(distance, 3) AS distance, CAST(rank AS INTEGER) AS rank FROM d""")
def j_prefiltered_ranking(spark, sf_dir):
    """To 3 digits, as d12: each query is among its own candidates."""
    chunks = durable(label_chunks(spark, sf_dir))
    reps = points(durable(ch.representatives(chunks)))
    every = points(chunks)
    found = ranking.prefiltered(reps, every, every, 16, 20)
    return found.withColumn("distance", F.round("distance", 3))


@query(f"""WITH {duck.chunks()}, s AS (SELECT dims, a.chunk_id AS id, b.chunk_id AS other, row_number() OVER (PARTITION BY dims, a.chunk_id ORDER BY {_prefix_cosines('dims')} DESC, b.chunk_id) AS n
  FROM chunks a JOIN chunks b ON a.chunk_id <> b.chunk_id CROSS JOIN (SELECT unnest([4, 8, 16, 32, 64]) AS dims)),
t AS (SELECT * FROM s WHERE n <= 10)
SELECT c.dims, round(count(f.id) / CAST(count(*) AS DOUBLE), 5) AS kept FROM t c LEFT JOIN (SELECT id, other FROM t WHERE dims = 64) f ON f.id = c.id AND f.other = c.other WHERE c.dims < 64 GROUP BY c.dims""")
def j_dimension_sweep(spark, sf_dir):
    """What share of the 10 nearest by cosine the first components alone find."""
    return ranking.dimension_sweep(points(durable(label_chunks(spark, sf_dir))), (4, 8, 16, 32), 10).withColumn("kept", F.round("kept", 5))


# ---------------------------------------------------------------- jobs


@query()
def h1_worker(spark, sf_dir):
    """A build request over the whole table, then every kind of query, through the stream."""
    import json

    config = {"k": 20, "p": 2, "k_graph": 3, "max_chunks": 5, "distance": "geodesic"}
    build = {"job_id": "build", "mode": "build", "build": {"table": f"{sf_dir}/embeddings.parquet", "entity": "label", "config": config}}
    inbox, out = scratch(spark, "inbox"), scratch(spark, "outbox")

    def send(*requests) -> None:
        for r in requests:  # a file each
            spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),)], "value string").coalesce(1).write.mode("append").text(inbox)
        worker.run_worker(worker.request_stream(spark, inbox), out).awaitTermination()

    send(build)
    results = lambda: jobs.read_results(spark.read.option("recursiveFileLookup", True).text(f"{out}/results"))
    handle = results().where("job_id = 'build'").first()["result"]["graph"]
    ids = ["1", "2"]
    ask = lambda kind, **more: {"job_id": kind, "mode": "query", "query": {"graph": handle, "query": {"type": kind} | more}}
    send(ask("greedy_path", **{"from": ids[0]}), ask("shortest_path", **{"from": ids[0], "to": ids[-1]}), ask("reachable", **{"from": ids[0]}), ask("communities"), ask("basins"), ask("topology"), ask("nonsense"), "not json", {"job_id": "m", "mode": "explode"})
    return results().select("job_id", "success", F.col("error").isNotNull().alias("failed"), F.size("result.path.nodes").alias("path"), F.size("result.reachable").alias("reached"), F.size("result.topology.communities").alias("communities"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e5_adjacency(spark, sf_dir)
