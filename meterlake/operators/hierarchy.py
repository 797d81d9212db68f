"""Asset topology: transitive closure, denormalised hierarchy, and graph questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, materialised

SEPARATOR = " > "


def _edges(assets: DataFrame) -> DataFrame:
    return assets.where("parent_asset_id is not null and asset_id is not null").select(F.col("parent_asset_id").alias("parent"), F.col("asset_id").alias("child")).distinct()


def closure(assets: DataFrame, max_depth: int = 12) -> DataFrame:
    """``ancestor_id, descendant_id, depth, path`` with a pair of each asset with itself at depth 0.

    Walks double their length a round: the longest ones so far are continued by all that start where they end, so
    each walk is made once, in as many rounds as the depth has binary digits.  No walk meets a node
    twice, so cycles end.  The result is written to the shared folder, the walks are deleted.
    """
    own, ids = F.col("asset_id"), assets.where("asset_id is not null").select("asset_id").distinct()
    links = _edges(assets).where("parent <> child").join(ids.withColumnRenamed("asset_id", "parent"), "parent", "left_semi")
    parts = [materialised(links.select(F.col("parent").alias("ancestor_id"), F.col("child").alias("descendant_id"), F.lit(1).alias("depth"), F.array("parent", "child").alias("walk")), "walks")]
    reach = 1
    while reach < max_depth:
        walks = reduce(DataFrame.unionByName, parts)
        after = walks.select(F.col("ancestor_id").alias("at"), F.col("descendant_id").alias("end"), F.col("depth").alias("more"), F.slice("walk", 2, max_depth).alias("rest"))
        step = parts[-1].where(F.col("depth") == reach).join(after, F.col("descendant_id") == F.col("at")).where((F.col("more") <= max_depth - reach) & ~F.arrays_overlap("walk", "rest"))
        parts.append(materialised(step.select("ancestor_id", F.col("end").alias("descendant_id"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("walk", "rest").alias("walk")), "walks"))
        reach *= 2
        if parts[-1].where(F.col("depth") == reach).isEmpty():
            break
    paths = reduce(DataFrame.unionByName, parts).where(F.col("depth") <= max_depth).groupBy("ancestor_id", "descendant_id", "depth").agg(F.min(F.array_join("walk", SEPARATOR)).alias("path"))
    itself = ids.select(own.alias("ancestor_id"), own.alias("descendant_id"), F.lit(0).alias("depth"), own.alias("path"))
    out = materialised(itself.unionByName(paths), "closure")
    dropped(*parts)
    return out


def closure_recursive(spark: SparkSession, assets: DataFrame, max_depth: int = 12) -> DataFrame:
    """The same pairs by a recursive common table expression."""
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "-1")
    query = """
        WITH RECURSIVE walk(ancestor_id, descendant_id, depth) AS (
          SELECT asset_id, asset_id, 0 FROM {assets}
          UNION ALL
          SELECT w.ancestor_id, a.asset_id, w.depth + 1 FROM walk w JOIN {assets} a ON a.parent_asset_id = w.descendant_id
          WHERE w.depth < :depth AND a.asset_id <> w.ancestor_id
        )
        SELECT DISTINCT ancestor_id, descendant_id, depth FROM walk"""
    return spark.sql(query, args={"depth": max_depth}, assets=assets)


def hierarchy(assets: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row an asset: level, root, path from the root, children, descendants and how it is connected."""
    up = pairs.groupBy("descendant_id").agg(F.max(F.struct("depth", "ancestor_id", "path")).alias("top"))
    down = pairs.groupBy("ancestor_id").agg(F.count_distinct(F.when(F.col("depth") > 0, F.col("descendant_id"))).alias("descendant_count"), F.count_if(F.col("depth") == 1).alias("child_count"))
    rows = assets.join(up.withColumnRenamed("descendant_id", "asset_id"), "asset_id", "left").join(down.withColumnRenamed("ancestor_id", "asset_id"), "asset_id", "left")
    leaf = F.col("child_count") == 0
    alone = leaf & F.col("parent_asset_id").isNull()
    status = F.when(F.col("is_orphan"), "ORPHANED").when(F.col("building_id").isNull(), "UNASSIGNED").when(alone, "STANDALONE").otherwise("CONNECTED")
    return rows.select(
        "asset_id", "asset_name", "asset_type", "site_id", "building_id", "parent_asset_id", "is_orphan", "is_root",
        F.col("top.depth").alias("level"), F.col("top.ancestor_id").alias("root_asset_id"), F.col("top.path").alias("hierarchy_path"),
        "descendant_count", "child_count", leaf.alias("is_leaf"), alone.alias("is_disconnected"), status.alias("connectivity_status"),
    )


def under_site(rows: DataFrame, site_id: str) -> DataFrame:
    return rows.where(F.col("site_id") == site_id)


def parent_and_children(rows: DataFrame, pairs: DataFrame, asset_id: str) -> DataFrame:
    near = pairs.where("depth = 1")
    parent = near.where(F.col("descendant_id") == asset_id).select(F.lit("parent").alias("relationship"), F.col("ancestor_id").alias("asset_id"))
    child = near.where(F.col("ancestor_id") == asset_id).select(F.lit("child").alias("relationship"), F.col("descendant_id").alias("asset_id"))
    return parent.unionAll(child).join(rows.select("asset_id", "asset_name", "asset_type", "level"), "asset_id")


def downstream(rows: DataFrame, pairs: DataFrame, asset_id: str) -> DataFrame:
    """Every asset below one, with its fewest hops."""
    below = pairs.where((F.col("ancestor_id") == asset_id) & (F.col("depth") > 0)).groupBy("descendant_id").agg(F.min("depth").alias("hops"), F.min("path").alias("impact_path"))
    return below.withColumnRenamed("descendant_id", "asset_id").join(rows.select("asset_id", "asset_name", "asset_type", "building_id"), "asset_id")


def blast_radius(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    below = pairs.where("depth > 0").groupBy("ancestor_id").agg(F.count_distinct("descendant_id").alias("blast_radius"), F.max("depth").alias("max_depth"))
    return below.withColumnRenamed("ancestor_id", "asset_id").join(rows.select("asset_id", "asset_name", "asset_type", "site_id"), "asset_id")


def subtree_sum(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """A value of assets summed over each asset's subtree, itself included."""
    per_asset = values.groupBy("asset_id").agg(F.sum(value).alias("_v"))
    below = pairs.select("ancestor_id", "descendant_id").distinct().join(per_asset, F.col("descendant_id") == F.col("asset_id")).drop("asset_id")
    return below.groupBy("ancestor_id").agg(F.sum("_v").alias(f"subtree_{value}"), F.count("*").alias("assets_in_subtree")).withColumnRenamed("ancestor_id", "asset_id")


def cycles(assets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that close a cycle: the child is an ancestor of its parent, or its own parent."""
    back = pairs.select(F.col("ancestor_id").alias("child"), F.col("descendant_id").alias("parent")).distinct()
    return _edges(assets).join(back, ["parent", "child"], "left_semi")


def graph(assets: DataFrame, buildings: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes and edges: sites contain buildings, buildings contain assets without a parent, parents feed children."""
    node = lambda df, key, kind: df.select(F.col(key).alias("node_id"), F.lit(kind).alias("node_type"))
    nodes = node(sites, "site_id", "Site").unionAll(node(buildings, "building_id", "Building")).unionAll(node(assets, "asset_id", "Asset"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("edge_type"))
    fed, free = assets.where("parent_asset_id is not null"), assets.where("parent_asset_id is null and building_id is not null")
    edges = edge(buildings, "site_id", "building_id", "CONTAINS").unionAll(edge(free, "building_id", "asset_id", "CONTAINS")).unionAll(edge(fed, "parent_asset_id", "asset_id", "FEEDS"))
    return nodes, edges


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node_id, component_id``: weakly connected components by least label, with pointer jumping between rounds."""
    both = materialised(edges.select("source_id", "target_id").unionAll(edges.select("target_id", "source_id")).distinct(), "links")
    labels = materialised(nodes.select("node_id", F.col("node_id").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["target_id"] == labels["node_id"]).groupBy("source_id").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node_id"] == near["source_id"], "left").select("node_id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        up = new.select(F.col("node_id").alias("at"), F.col("label").alias("jump"))
        new = materialised(new.join(up, new["label"] == up["at"]).select("node_id", F.least("label", "jump").alias("label"), "old"), "labels")
        dropped(labels)
        labels = new
        if new.where("label <> old").isEmpty():
            dropped(both)
            return new.select("node_id", F.col("label").alias("component_id"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def topology_report(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """One row of counts: nodes, edges, roots, leaves, isolated, components, depth, parents, cycles, and whether it is a forest."""
    into = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("n_in"))
    out = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("n_out"))
    degree = nodes.join(into, "node_id", "left").join(out, "node_id", "left").fillna(0, ["n_in", "n_out"])
    counts = degree.agg(
        F.count("*").alias("nodes"),
        F.sum("n_out").alias("edges"),
        F.count_if((F.col("n_in") == 0) & (F.col("n_out") > 0)).alias("roots"),
        F.count_if((F.col("n_out") == 0) & (F.col("n_in") > 0)).alias("leaves"),
        F.count_if((F.col("n_in") == 0) & (F.col("n_out") == 0)).alias("isolated"),
        F.count_if(F.col("n_in") > 1).alias("multi_parent"),
    )
    groups = components(nodes, edges).groupBy("component_id").count().agg(F.count("*").alias("components"), F.max("count").alias("largest_component"))
    depth = pairs.agg(F.max("depth").alias("max_depth"))
    loops = cycles(assets, pairs).agg(F.count("*").alias("cycle_edges"))
    report = counts.join(F.broadcast(groups)).join(F.broadcast(depth)).join(F.broadcast(loops))  # one row each
    return report.withColumn("is_forest", (F.col("cycle_edges") == 0) & (F.col("multi_parent") == 0))
