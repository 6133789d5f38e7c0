"""The entity graph: entities, distances, neighbours; built once, stored as Parquet, queried many times."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from subspan.config import GraphConfig, SpaceConfig
from subspan.operators.chunks import check, entities_of
from subspan.operators.entity import adjacency, chunk_tangents, entity_distances, symmetric
from subspan.operators.tangent import tangents_of_chunks
from subspan.plans.lineage import durable


@dataclass(frozen=True)
class Graph:
    """entities (entity_idx, entity_id, n_chunks), dist (src, dst, d) in both directions without diagonal, knn (src, dst, rank, d).

    tangents is None in a graph that was loaded: what is stored is what queries need.
    """

    entities: DataFrame
    dist: DataFrame
    knn: DataFrame
    space: SpaceConfig
    graph: GraphConfig
    tangents: DataFrame | None = None

    def index_of(self, entity_id: str) -> int:
        row = self.entities.where(self.entities["entity_id"] == entity_id).select("entity_idx").first()
        if row is None:
            raise ValueError(f"unknown entity: {entity_id!r}")
        return row[0]


def build_graph(chunks: DataFrame, space: SpaceConfig | None = None, graph: GraphConfig | None = None, self_exclusion: str = "duplicate", all_tangents: bool = False) -> Graph:
    """Chunks to graph: neighbours, tangent spaces, entity distances, nearest entities.

    Only the representatives of an entity need tangent spaces; all_tangents fits every chunk. One
    entity gives an empty dist and knn. Work on distances grows with the square of the number of
    entities, as any full distance matrix does; it is cut into block pairs.
    """
    space, graph = space or SpaceConfig(), graph or GraphConfig()
    check(chunks)
    chunks = durable(chunks)
    chosen = chunk_tangents(chunks, space, graph, self_exclusion)
    dist = durable(symmetric(entity_distances(chosen, space.p, space.distance)))
    tangents = tangents_of_chunks(chunks, space.k, space.p, self_exclusion) if all_tangents else chosen
    return Graph(entities_of(chunks), dist, adjacency(dist, graph.k_graph), space, graph, tangents)


def from_scores(entities: DataFrame, half: DataFrame, k_graph: int = 3, lower_is_closer: bool = True) -> Graph:
    """A graph over any symmetric relation (src, dst, d); similarities are kept as they are, with the direction in knn only."""
    dist = durable(symmetric(half))
    return Graph(entities, dist, adjacency(dist, k_graph, lower_is_closer), SpaceConfig(), GraphConfig(k_graph=k_graph))


def save_graph(graph: Graph, path: str) -> str:
    """Write entities, dist (each pair once), knn and the settings under path, which is returned as the graph's handle."""
    graph.entities.write.mode("overwrite").parquet(f"{path}/entities")
    graph.dist.where("src < dst").write.mode("overwrite").parquet(f"{path}/dist")
    graph.knn.write.mode("overwrite").parquet(f"{path}/knn")
    settings = json.dumps({"space": asdict(graph.space), "graph": asdict(graph.graph)})
    graph.entities.sparkSession.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    return path


def load_graph(spark: SparkSession, path: str) -> Graph:
    settings = json.loads(spark.read.parquet(f"{path}/config").first()[0])
    entities, half, knn = (spark.read.parquet(f"{path}/{t}") for t in ("entities", "dist", "knn"))
    return Graph(entities, symmetric(half), knn, SpaceConfig(**settings["space"]), GraphConfig(**settings["graph"]))
