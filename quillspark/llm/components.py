"""Connected components of a graph given as a table of edges, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import written


def contracted(graph: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(node, to) for every node of the graph (a, b), and the graph between what its nodes point at.

    Each node points at the one of least hash among itself and its neighbours; the hash is another one in every round.
    """

    def placed(node: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), node).alias("hash"), node.alias("to"))

    ends = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(graph.select(F.col("b").alias("node"), F.col("a").alias("other")))
    nearest = ends.groupBy("node").agg(F.min(placed(F.col("other"))).alias("near"))
    points = written(nearest.select("node", F.least(placed(F.col("node")), "near")["to"].alias("to")), "points")
    a, b = points.toDF("a", "ta"), points.toDF("b", "tb")
    left = graph.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    return points, written(left.distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: longs), component being the least node that it reaches.

    A round leaves in expectation at most three quarters of the nodes, whatever the graph looks like (randomised
    contraction: the order in which nodes are preferred is drawn anew in each round), so the number of rounds grows with
    the logarithm of the number of nodes, on a path in the order of its ids as well. Each round is a written table. No
    edge leaves the executors, and sums are partial before they are shuffled, so a node with many edges is no hot key.
    """
    graph = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not graph.isEmpty():
        points, graph = contracted(graph, len(rounds))
        rounds.append(points)
    if not rounds:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # from the last round back: what a node points at has its own root by then
    known = rounds[-1].select("node", F.col("to").alias("root"))
    for points in reversed(rounds[:-1]):
        later = known.toDF("to", "root")
        known = points.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    known = written(known, "roots")
    # a written table, so that the join of a large component can be split
    least = written(known.groupBy("root").agg(F.min("node").alias("component")), "least")
    return known.join(least, "root").select("node", "component")
