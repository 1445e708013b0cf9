"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component), for every node that has an edge.

    In each round every node takes its smallest neighbour, if that is smaller, as its parent; parents are doubled until
    they are roots, and the edges between different roots, without repetitions, are the next round's. A round leaves
    at most half of the nodes, so rounds and doublings are logarithmic, also for long chains. What a round keeps is one
    row a node, written to the shared folder. The smallest neighbour is a partial minimum, so a hub is no hot group; in
    the end the rounds' roots are followed one after the other."""
    left = checkpoint(edges.selectExpr(f"least(`{a}`, `{b}`) as x", f"greatest(`{a}`, `{b}`) as y").where("x <> y").distinct())
    maps: list[DataFrame] = []
    while left.limit(1).count():
        if len(maps) == max_rounds:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
        both = left.select("x", "y").unionByName(left.selectExpr("y as x", "x as y"))
        parent = checkpoint(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).selectExpr("node", "least(node, y) as root"))
        for _ in range(max_rounds):
            doubled = checkpoint(parent.join(parent.selectExpr("node as root", "root as top"), "root").selectExpr("node", "root as old", "top as root"))
            parent = doubled.select("node", "root")
            if not doubled.where("root <> old").limit(1).count():
                break
        maps.append(parent)
        moved = left.join(parent.selectExpr("node as x", "root as a"), "x").join(parent.selectExpr("node as y", "root as b"), "y")
        left = checkpoint(moved.selectExpr("least(a, b) as x", "greatest(a, b) as y").where("x <> y").distinct())
    if not maps:
        return left.selectExpr("x as node", "y as root")
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.selectExpr("node as root", "root as top"), "root", "left").selectExpr("node", "coalesce(top, root) as root")
    return checkpoint(out)
