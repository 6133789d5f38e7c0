"""The worker: requests from a stream, graphs built or queried, results, status and log written."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subspan.config import GraphConfig, SpaceConfig, wire_metric
from subspan.model import EMPTY_TOPOLOGY, LOG, RESULT, STATUS
from subspan.operators.chunks import from_entities, from_vectors
from subspan.operators.graph import Graph, build_graph, load_graph, save_graph
from subspan.operators.paths import greedy_paths, greedy_paths_to, path_hops, reachable, shortest_paths
from subspan.operators.topology import basins, bridges, communities, hub_centrality, hub_concentration, mutual_edges
from subspan.plans.lineage import scratch
from subspan.sources.jobs import parse_requests, serialize_results

QUERY_TYPES = ("greedy_path", "shortest_path", "reachable", "communities", "basins", "topology")


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def _names(graph: Graph, indices: list[int]) -> dict[int, str]:
    return {r["entity_idx"]: r["entity_id"] for r in graph.entities.where(F.col("entity_idx").isin(indices)).collect()}


def _path(graph: Graph, hops: list) -> dict | None:
    """A path result from rows (hop, node, hop_distance) of one walk."""
    if not hops:
        return None
    hops = sorted(hops, key=lambda r: r["hop"])
    names = _names(graph, [r["node"] for r in hops])
    steps = [r["hop_distance"] for r in hops[1:]]
    return {"nodes": [names[r["node"]] for r in hops], "distances": steps, "total_distance": float(sum(steps))}


def greedy_path(graph: Graph, start: str, target: str | None = None, depth: int = 4) -> dict | None:
    spark, a = graph.entities.sparkSession, graph.index_of(start)
    if target is None:
        own = graph.entities.where(F.col("entity_idx") == a)
        return _path(graph, greedy_paths(graph.dist, own, depth).collect())
    pairs = spark.createDataFrame([(a, graph.index_of(target))], "start long, target long")
    return _path(graph, greedy_paths_to(graph.dist, graph.entities, pairs, depth).collect())


def shortest_path(graph: Graph, start: str, target: str) -> dict | None:
    spark, a, b = graph.entities.sparkSession, graph.index_of(start), graph.index_of(target)
    found = shortest_paths(graph.knn, spark.createDataFrame([(a,)], "source long")).where(F.col("node") == b)
    return _path(graph, path_hops(found, graph.dist).collect())


def reach(graph: Graph, start: str, max_hops: int = 3) -> list[dict]:
    spark = graph.entities.sparkSession
    found = reachable(graph.knn, spark.createDataFrame([(graph.index_of(start),)], "source long"), max_hops)
    rows = found.join(graph.entities, F.col("node") == F.col("entity_idx")).orderBy("total", "node")
    return [{"id": r["entity_id"], "hops": r["hops"], "distance": r["total"]} for r in rows.collect()]


def community_list(members: DataFrame) -> list[dict]:
    rows = members.groupBy("community", "root").agg(F.array_sort(F.collect_list("member")).alias("members")).orderBy("community")
    return [{"members": r["members"], "root": r["root"]} for r in rows.collect()]


def basin_list(members: DataFrame) -> list[dict]:
    rows = members.groupBy("basin", "attractor").agg(F.array_sort(F.collect_list("member")).alias("members")).orderBy("basin")
    return [{"attractor": r["attractor"], "members": r["members"]} for r in rows.collect()]


def topology(graph: Graph) -> dict:
    members = communities(graph.knn, graph.entities)
    hubs = hub_centrality(graph.knn, graph.entities)
    found = bridges(graph.knn, graph.entities, members).orderBy(F.desc(F.size("reached")), "entity").collect()
    return {
        "communities": community_list(members), "basins": basin_list(basins(graph.dist, graph.entities)),
        "bridges": [{"id": r["entity"], "home_community": r["home"], "reached_communities": r["reached"]} for r in found],
        "hub_centrality": [{"id": r["entity"], "in_degree": r["in_degree"]} for r in hubs.orderBy(F.desc("in_degree"), "entity_idx").collect()],
        "hub_concentration": hub_concentration(hubs).first()[0],
        "bidirectional_edges": [[r["a"], r["b"]] for r in mutual_edges(graph.knn, graph.entities).orderBy("a", "b").collect()],
    }


def answer(graph: Graph, query: dict) -> dict:
    """The result of one query; raises ValueError for an unknown type or entity."""
    kind, depth = query.get("type"), query.get("depth")
    if kind == "greedy_path":
        return {"path": greedy_path(graph, query["from"], query.get("to"), 4 if depth is None else depth)}
    if kind == "shortest_path":
        return {"path": shortest_path(graph, query["from"], query["to"])}
    if kind == "reachable":
        return {"reachable": reach(graph, query["from"], 3 if depth is None else depth)}
    if kind == "communities":
        return {"topology": EMPTY_TOPOLOGY | {"communities": community_list(communities(graph.knn, graph.entities))}}
    if kind == "basins":
        return {"topology": EMPTY_TOPOLOGY | {"basins": basin_list(basins(graph.dist, graph.entities))}}
    if kind == "topology":
        return {"topology": topology(graph)}
    raise ValueError(f"unknown query type: {kind}")


def build(spark: SparkSession, request: dict, log=lambda level, message: None) -> dict:
    """Build and store a graph of the vectors in the request, or of a stored table that it names.

    A table is Parquet with vec_id and embedding; entity names the column that tells whose a vector
    is. Its vectors never pass the driver.
    """
    c = request["config"]
    space, graph_ = SpaceConfig(c["k"], c["p"], wire_metric(c["distance"])), GraphConfig(c["k_graph"], c["max_chunks"])
    log("info", "Building graph")
    if request.get("table"):
        chunks = from_vectors(spark.read.parquet(request["table"]), F.col(request.get("entity") or "label"))
        graph = build_graph(chunks, space, graph_)
        entities, n = graph.entities.agg(F.count("*"), F.sum("n_chunks")).first()
    else:
        given = request["entities"] or []
        ids = [e["id"] for e in given]
        if len(set(ids)) != len(ids):
            raise ValueError("an entity id repeats")
        for e in given:
            if not e["embeddings"]:
                raise ValueError(f"no chunks for entity: {e['id']!r}")
        rows = spark.createDataFrame([(i + 1, e["id"], e["embeddings"]) for i, e in enumerate(given)], "entity_idx long, id string, embeddings array<array<double>>")
        graph = build_graph(from_entities(rows), space, graph_)
        entities, n = len(given), sum(len(e["embeddings"]) for e in given)
    handle = save_graph(graph, scratch(spark, "graph"))
    log("info", f"Graph built: entities={entities} chunks={n}")
    return {"graph": handle, "entities": entities, "chunks": n}


def process(spark: SparkSession, request: dict | None, worker_id: str, error: str | None = None, log=lambda level, message: None) -> dict:
    """The result of one request; never raises. error is what kept the request from being parsed."""
    done = {"job_id": "unknown", "success": False, "worker_id": worker_id, "timestamp": now()}
    if error or request is None:
        log("error", error or "Parse error: empty")
        return done | {"error": error or "Parse error: empty"}
    done["job_id"], mode = request["job_id"], request["mode"]
    log("info", f"Job received: mode={mode}")
    try:
        if mode not in ("build", "query"):
            return done | {"error": f"Unknown mode: {mode}"}
        if request.get(mode) is None:
            return done | {"error": f"{mode} mode requires {mode} params"}
        if mode == "build":
            result = build(spark, request["build"], log)
        else:
            log("info", f"Query: type={request['query']['query']['type']}")
            result = answer(load_graph(spark, request["query"]["graph"]), request["query"]["query"])
        return done | {"success": True, "result": result}
    except Exception as e:  # noqa: BLE001  whatever fails becomes the job's error
        message = f"Computation failed: {e}"
        log("error", message)
        return done | {"error": message}


def run_worker(requests: DataFrame, out: str, worker_id: str = "worker", checkpoint: str | None = None):
    """A streaming query over requests (value: JSON): results, status and log are appended as JSON lines under out.

    All requests that are there are worked off, then the stream ends (availableNow). A batch holds
    requests, which are few and small next to the data they start work on. Status "processing" is
    written before the work. What is written lies under the batch's number and the request's hash,
    so that a batch that is run again replaces its results. Read them with recursiveFileLookup.
    """
    spark = requests.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        for r in parse_requests(rows.withColumn("key", F.md5(F.col("value").cast("string")))).select("key", "request", "error").distinct().collect():
            request = r["request"].asDict(True) if r["request"] is not None else None
            logs: list[tuple] = []
            job, at = (request or {}).get("job_id") or "unknown", f"{number:06d}-{r['key']}"
            begun = [(job, "processing", worker_id, now())]
            spark.createDataFrame(begun, STATUS).write.mode("overwrite").json(f"{out}/status/{at}-0")
            result = process(spark, request, worker_id, r["error"], lambda level, message, job=job, logs=logs: logs.append((job, level, message, now())))
            serialize_results(spark.createDataFrame([result], RESULT)).write.mode("overwrite").text(f"{out}/results/{at}")
            ended = [(result["job_id"], "completed" if result["success"] else "error", worker_id, now())]
            spark.createDataFrame(ended, STATUS).write.mode("overwrite").json(f"{out}/status/{at}-1")
            spark.createDataFrame(logs, LOG).write.mode("overwrite").json(f"{out}/log/{at}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests from the text files that appear under path, one JSON document a file."""
    return spark.readStream.schema("value string").text(path, wholetext=True)
