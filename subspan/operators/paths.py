"""Path queries over a distance relation (src, dst, d) and a neighbour relation (src, dst, rank, d)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.operators.entity import adjacency, with_diagonal
from subspan.plans.lineage import durable

HOPS = ("start", "hop", "node", "hop_distance", "total")


def greedy_paths(dist: DataFrame, entities: DataFrame, depth: int = 4, lower_is_closer: bool = True) -> DataFrame:
    """(start, hop, node, hop_distance, total) of the greedy walk from every entity, hop 0 being the start.

    A hop goes to the closest entity of all that the walk has not visited, ties to the smaller
    index; the walk ends at depth or when none is left. All walks advance in one plan. Before its
    h-th hop a walk has visited h - 1 others, so each node's `depth` closest hold every next node,
    and walks that gather at a hub meet that many rows, not all distances.
    """
    near = durable(adjacency(dist, depth, lower_is_closer).select("src", "dst", "d")) if depth else None
    sign = 1.0 if lower_is_closer else -1.0
    step = entities.select(F.col("entity_idx").alias("start"), F.lit(0).alias("hop"), F.col("entity_idx").alias("node"), F.lit(None).cast("double").alias("hop_distance"), F.lit(0.0).alias("total"), F.array("entity_idx").alias("visited"))
    out = step
    for hop in range(1, depth + 1):
        reach = step.join(near, F.col("node") == F.col("src")).where(~F.array_contains("visited", F.col("dst")))
        best = reach.groupBy("start", "total", "visited").agg(F.min(F.struct((F.col("d") * sign).alias("key"), F.col("dst"))).alias("m"))
        d = F.col("m.key") * sign
        step = best.select("start", F.lit(hop).alias("hop"), F.col("m.dst").alias("node"), d.alias("hop_distance"), (F.col("total") + d).alias("total"), F.array_append("visited", F.col("m.dst")).alias("visited"))
        out = out.union(step)
    return out.select(*HOPS)


def greedy_paths_to(dist: DataFrame, entities: DataFrame, pairs: DataFrame, depth: int = 10) -> DataFrame:
    """(start, target, hop, node, hop_distance, total) of the greedy walk for each of pairs (start, target).

    A hop goes to the unvisited entity closest to the target, the target itself at distance 0
    included, ties to the smaller index. Walks that do not arrive within depth have no rows; a walk
    from the target to itself is the single node. Before its h-th hop a walk has visited h nodes, so
    the depth + 1 closest to a target hold every next node.
    """
    order = F.row_number().over(W.partitionBy("dst").orderBy("d", "src"))
    full = durable(with_diagonal(dist, entities).withColumn("rank", order).where(F.col("rank") <= depth + 1).drop("rank"))
    step = pairs.select("start", "target", F.lit(0).alias("hop"), F.col("start").alias("node"), F.lit(None).cast("double").alias("hop_distance"), F.lit(0.0).alias("total"), F.array("start").alias("visited"))
    out = step
    for hop in range(1, depth + 1):
        going = step.where("node <> target")
        reach = going.join(full, F.col("target") == F.col("dst")).where(~F.array_contains("visited", F.col("src")))
        best = reach.groupBy("start", "target", "node", "total", "visited").agg(F.min(F.struct("d", "src")).alias("m")).withColumn("next", F.col("m.src"))
        cost = dist.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("d").alias("cost"))
        step = best.join(cost, ["node", "next"]).select("start", "target", F.lit(hop).alias("hop"), F.col("next").alias("node"), F.col("cost").alias("hop_distance"), (F.col("total") + F.col("cost")).alias("total"), F.array_append("visited", F.col("next")).alias("visited"))
        out = out.union(step)
    arrived = out.where("node = target").select("start", "target")
    return out.join(arrived, ["start", "target"], "left_semi").select("start", "target", *HOPS[1:])


def shortest_paths(knn: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(source, node, total, path) for all that is reachable over directed neighbour edges from sources (source).

    path lists the nodes from source to node. Distances are relaxed over edges, round by round,
    until none falls; of equal totals the path with fewer nodes, then the smaller one, is kept. Each
    round is checkpointed and one number reaches the driver. Unreachable nodes have no row.
    """
    edges = knn.select(F.col("src"), F.col("dst"), F.col("d").alias("w"))
    state = durable(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("total"), F.array("source").alias("path")).distinct())
    seen, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        grown = state.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("source", F.col("dst").alias("node"), (F.col("total") + F.col("w")).alias("total"), F.array_append("path", F.col("dst")).alias("path"))
        best = state.union(grown).groupBy("source", "node").agg(F.min(F.struct("total", F.size("path").alias("n"), "path")).alias("b"))
        state = durable(best.select("source", "node", F.col("b.total").alias("total"), F.col("b.path").alias("path")))
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("source", "node", "path").cast("decimal(38,0)"))).first())
        rounds += 1
        if now == seen:
            break
        seen = now
    return state


def path_hops(paths: DataFrame, dist: DataFrame) -> DataFrame:
    """(source, target, hop, node, hop_distance) of paths (source, node, path), hop distances read from dist."""
    hops = paths.select("source", F.col("node").alias("target"), "path", F.posexplode("path").alias("hop", "at"))
    hops = hops.withColumn("before", F.when(F.col("hop") > 0, F.get("path", F.col("hop") - 1))).drop("path")
    joined = hops.join(dist, (F.col("before") == F.col("src")) & (F.col("at") == F.col("dst")), "left")
    return joined.select("source", "target", "hop", F.col("at").alias("node"), F.col("d").alias("hop_distance"))


def reachable(knn: DataFrame, sources: DataFrame, max_hops: int = 3) -> DataFrame:
    """(source, node, hops, total): for each node within max_hops edges the cheapest walk of at most so many, and its edges.

    hops is that walk's length, not the least number of edges; of equal totals the fewest. The
    source is left out.
    """
    edges = knn.select("src", "dst", F.col("d").alias("w"))
    state = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("total"), F.lit(0).alias("hops")).distinct()
    for _ in range(max_hops):
        grown = state.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("total") + F.col("w")).alias("total"), (F.col("hops") + 1).alias("hops"))
        best = state.union(grown).groupBy("source", "node").agg(F.min(F.struct("total", "hops")).alias("b"))
        state = best.select("source", "node", F.col("b.total").alias("total"), F.col("b.hops").alias("hops"))
    return state.where("node <> source").select("source", "node", "hops", "total")
