"""Connected components over an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``; a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour, follows two more links, and replaces
    edges by the links between what they hooked to. A round at least halves the nodes that still
    have edges, and the smallest node of a component is never renamed. Nodes without edges, and
    edges with a null end, are left out.
    """
    live = scratch.write(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}_e0"
    )
    maps: list[DataFrame] = []
    while not live.isEmpty():
        k = len(maps)
        both = live.union(live.select("b", "a")).toDF("node", "near")
        hook = scratch.write(both.groupBy("node").agg(F.min("near").alias("to")).select("node", F.least("node", "to").alias("to")), f"{label}_h{k}")
        jump = hook
        for _ in range(2):
            step = hook.select(F.col("node").alias("mid"), F.col("to").alias("next"))
            jump = jump.join(step, jump["to"] == step["mid"]).select("node", F.col("next").alias("to"))
        maps.append(scratch.write(jump, f"{label}_m{k}"))
        at = maps[-1]
        live = scratch.write(
            live.join(at.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(at.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            f"{label}_e{k + 1}",
        )
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    scratch.drop(*(f"{label}_{kind}{k}" for k in range(len(maps)) for kind in "eh"), f"{label}_e{len(maps)}")
    found = maps[0].select("node", F.col("to").alias("component"))
    for at in maps[1:]:
        later = at.select(F.col("node").alias("mid"), F.col("to").alias("next"))
        found = found.join(later, found["component"] == later["mid"], "left").select("node", F.coalesce("next", "component").alias("component"))
    done = scratch.write(found, f"{label}_done")
    scratch.drop(*(f"{label}_m{k}" for k in range(len(maps))))
    return done
