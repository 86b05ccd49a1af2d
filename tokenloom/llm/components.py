"""Connected components of a graph given as a table of edges, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm._common import Scratch, spread_join


def component_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, root) for each node of edges (a, b long): key is xxhash64(node), root the key that stands for the component.

    xxhash64 of one long is a bijection, so keys are as good as nodes, and their order is random: each round maps a
    node to the least key next to it and contracts the edges, which about halves the nodes. The maps of the rounds
    are composed at the end. All steps are aggregations and joins; nothing is gathered on the driver.
    """
    u, v = F.xxhash64("a"), F.xxhash64("b")
    now = scratch.save(
        edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u <> v").distinct(), "edges0"
    )
    maps: list[DataFrame] = []
    while now.take(1):
        k = len(maps)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("p"), "n")
        maps.append(scratch.save(up, f"map{k}"))  # n: a node's edges, at least as many as it has on either side
        left = maps[-1].select("u", F.col("p").alias("pu"), "n")
        right = maps[-1].select(F.col("u").alias("v"), F.col("p").alias("pv"), "n")
        joined = spread_join(spread_join(now, left, ["u"], "n"), right, ["v"], "n")
        new = joined.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct()
        now = scratch.save(new, f"edges{k + 1}")
        scratch.drop(f"edges{k}")
    if not maps:
        return now.select(F.col("u").alias("key"), F.col("v").alias("root"))
    roots = maps[-1].select(F.col("u").alias("key"), F.col("p").alias("root"))
    for k, up in [*enumerate(maps[:-1])][::-1]:
        # one row for each p that nodes of this round point to, with their number
        targets = up.groupBy("p").agg(F.count("*").alias("n")).join(roots.select(F.col("key").alias("p"), "root"), "p", "left")
        later = scratch.save(targets, f"targets{k}")
        roots = spread_join(up.select("u", "p"), later, ["p"], "n").select(F.col("u").alias("key"), F.coalesce("root", "p").alias("root"))
    roots = scratch.save(roots, "roots")
    for k in range(len(maps)):
        scratch.drop(f"map{k}")
        scratch.drop(f"targets{k}")
    return roots
