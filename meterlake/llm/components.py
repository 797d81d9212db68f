"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node, component`` for every node of ``links(a, b)``; a component is named by its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Each
    is one minimum by node and one join, so no neighbourhood is ever gathered
    in a task.  Every round is written to the shared folder.  Links to itself,
    repeated links and nulls are ignored; an empty graph gives no rows.
    """
    graph = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "graph",
    )
    before = None
    for _ in range(max_rounds):
        state = graph.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = written(small, "graph")
        dropped(graph)
        graph = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return graph.select(F.col("u").alias("node"), F.col("v").alias("component")).union(graph.select("v", "v").distinct())
