"""Topology of the entity graph. Lists are numbered by size, largest first, then least member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.plans.components import connected_components
from subspan.plans.lineage import durable


def named(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """rows with index columns replaced by entity ids."""
    for c in columns:
        rows = rows.join(entities.select(F.col("entity_idx").alias("_i"), F.col("entity_id").alias("_id")), F.col(c) == F.col("_i")).withColumn(c, F.col("_id")).drop("_i", "_id")
    return rows


def mutual_edges(knn: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b), a < b as strings: pairs of entities that are among each other's neighbours."""
    back = knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = named(knn.select("src", "dst").join(back, ["src", "dst"], "left_semi"), entities, "src", "dst")
    return both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _numbered(members: DataFrame, key: str) -> DataFrame:
    """(community, root, size, member): groups of (key, member) numbered from 1."""
    groups = members.groupBy(key).agg(F.count("*").alias("size"), F.min("member").alias("root"))
    number = F.row_number().over(W.orderBy(F.desc("size"), "root", key)).cast("long")  # one row a group
    return members.join(groups.withColumn("community", number), key).select("community", "root", "size", "member")


def communities(knn: DataFrame, entities: DataFrame) -> DataFrame:
    """(community, root, size, member): connected components over mutual edges, lone entities included."""
    edges = mutual_edges(knn, entities).select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = connected_components(edges).withColumnRenamed("node", "entity_id")
    members = entities.join(joined, "entity_id", "left").select(F.coalesce("component", "entity_id").alias("c"), F.col("entity_id").alias("member"))
    return _numbered(durable(members), "c")


def nearest_of(dist: DataFrame, lower_is_closer: bool = True) -> DataFrame:
    """(node, next): each entity's closest other, ties to the smaller index."""
    sign = 1.0 if lower_is_closer else -1.0
    best = dist.where("src <> dst").groupBy("src").agg(F.min(F.struct((F.col("d") * sign).alias("key"), F.col("dst"))).alias("m"))
    return best.select(F.col("src").alias("node"), F.col("m.dst").alias("next"))


def attractors(dist: DataFrame, entities: DataFrame, lower_is_closer: bool = True, max_rounds: int = 64) -> DataFrame:
    """(node, attractor): where following closest others first comes to a pair that are each other's closest.

    On a symmetric relation with ties by index such chains end in pairs only. Pointers are doubled
    each round, so chains of n nodes take log n rounds, each checkpointed.
    """
    nn = nearest_of(dist, lower_is_closer)
    back = nn.select(F.col("node").alias("next"), F.col("next").alias("again"))
    at = nn.join(back, "next").select("node", F.when(F.col("again") == F.col("node"), F.col("node")).otherwise(F.col("next")).alias("attractor"))
    lone = entities.select(F.col("entity_idx").alias("node")).join(nn, "node", "left_anti").select("node", F.col("node").alias("attractor"))
    at = durable(at.union(lone))
    for _ in range(max_rounds):
        far = at.select(F.col("node").alias("attractor"), F.col("attractor").alias("far"))
        new = durable(at.join(far, "attractor").select("node", "attractor", "far"))
        moved = new.where("attractor <> far").limit(1).count()
        at = new.select("node", F.col("far").alias("attractor"))
        if not moved:
            break
    return at


def basins(dist: DataFrame, entities: DataFrame, lower_is_closer: bool = True) -> DataFrame:
    """(basin, attractor, size, member), numbered by size, then attractor."""
    at = named(attractors(dist, entities, lower_is_closer), entities, "node", "attractor").withColumnRenamed("node", "member")
    groups = at.groupBy("attractor").agg(F.count("*").alias("size"))
    number = F.row_number().over(W.orderBy(F.desc("size"), "attractor")).cast("long")
    return at.join(groups.withColumn("basin", number), "attractor").select("basin", "attractor", "size", "member")


def bridges(knn: DataFrame, entities: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(entity, home, reached): entities with a neighbour outside their community; reached are their neighbours' communities, ascending.

    members is the result of communities, computed if not given. home is in reached only if a
    neighbour is at home.
    """
    members = communities(knn, entities) if members is None else members
    of = members.select(F.col("member"), F.col("community"))
    edges = named(knn.select("src", "dst"), entities, "src", "dst")
    edges = edges.join(of.withColumnsRenamed({"member": "src", "community": "home"}), "src").join(of.withColumnsRenamed({"member": "dst", "community": "there"}), "dst")
    found = edges.groupBy(F.col("src").alias("entity"), "home").agg(F.array_sort(F.collect_set("there")).alias("reached"))  # at most k a row
    return found.where(F.exists("reached", lambda c: c != F.col("home")))


def hub_centrality(knn: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, entity_idx, in_degree), entities that nobody links to included."""
    seen = knn.groupBy(F.col("dst").alias("entity_idx")).agg(F.count("*").alias("in_degree"))
    return entities.join(seen, "entity_idx", "left").select(F.col("entity_id").alias("entity"), "entity_idx", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def _ranked(hubs: DataFrame) -> DataFrame:
    """Sums by in-degree: as many rows as there are different degrees, in ascending order of degree."""
    by = hubs.groupBy("in_degree").agg(F.count("*").alias("n"))
    up = W.orderBy("in_degree").rowsBetween(W.unboundedPreceding, -1)
    return by.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("mass", F.coalesce(F.sum(F.col("n") * F.col("in_degree")).over(up), F.lit(0)))


def hub_concentration(hubs: DataFrame) -> DataFrame:
    """(gini): the Gini coefficient of in-degrees, 0 without links. Ranks are summed by degree, so nothing is sorted but degrees."""
    r = _ranked(hubs)
    ranks = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    sums = r.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("in_degree")).alias("total"), F.sum(ranks * F.col("in_degree")).alias("weighted"))
    gini = 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return sums.select(F.when(F.col("total") > 0, gini).otherwise(0.0).alias("gini"))


def lorenz_concentration(hubs: DataFrame) -> DataFrame:
    """(concentration): 1 less twice the mean cumulative share of links, which is the Gini coefficient less 1 / n."""
    r = _ranked(hubs)
    inner = F.col("n") * F.col("mass") + F.col("in_degree") * F.col("n") * (F.col("n") + 1) / 2
    sums = r.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("in_degree")).alias("total"), F.sum(inner).alias("cum"))
    return sums.select(F.when(F.col("total") > 0, 1 - 2 * F.col("cum") / F.col("total") / F.col("n")).otherwise(0.0).alias("concentration"))
