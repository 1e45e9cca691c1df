"""Connected components by contraction, on DataFrames alone.

In each round every node joins the neighbour (or itself) that comes first in an order drawn anew by hash; edges are then
renamed and those inside a node dropped. The rest shrinks by a constant factor a round whatever the graph's shape, so long
chains and large stars end after few rounds. The rounds' renamings, applied in turn, name each node's component; its label
is the smallest id in it. Neighbour minima are aggregated before they are shuffled; the renaming joins read written tables,
so that AQE can split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.sources.shared import remove, written

MAX_ROUNDS = 60


def _known(edges: DataFrame, end: str) -> Column:
    """Not null and, if it is a string, not blank: a blank card number would join strangers."""
    there = F.col(end).isNotNull()
    return there & (F.col(end) != "") if isinstance(edges.schema[end].dataType, T.StringType) else there


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node that an edge names; component: the smallest id reachable.

    Edges with a null or blank end are left out; loops name their node. No edges give no rows. Repeated edges count once.
    """
    named = edges.where(_known(edges, src) & _known(edges, dst)).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    first = written(named.distinct(), "edges")
    now, rounds = first.where("u <> v"), []
    while not now.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("components did not contract")
        turn = F.lit(len(rounds))
        both = now.union(now.select("v", "u")).select("u", F.struct(F.xxhash64(turn, "v").alias("h"), F.col("v").alias("r")).alias("n"))
        own = F.struct(F.xxhash64(turn, "u").alias("h"), F.col("u").alias("r"))
        to = written(both.groupBy("u").agg(F.min("n").alias("n")).select("u", F.least("n", own)["r"].alias("r")), "round")
        rounds.append(to)
        # The first join's result is what the second deals out, so each join has plain inputs.
        half = now.join(to, "u").select(F.col("r").alias("a"), F.col("v"))
        whole = half.join(to.withColumnRenamed("u", "v"), "v").where("a <> r")
        left, now = now, written(whole.select(F.least("a", "r").alias("u"), F.greatest("a", "r").alias("v")).distinct(), "edges")
        if len(rounds) > 1:
            remove(left)
    if not rounds:
        nodes = first.select(F.col("u").alias("id"))
        return nodes.withColumn("component", F.col("id"))
    at = rounds[0].select(F.col("u").alias("id"), F.col("r").alias("at"))
    for to in rounds[1:]:
        at = at.join(to.withColumnRenamed("u", "at"), "at", "left").select("id", F.coalesce("r", "at").alias("at"))
    at = written(at, "roots")
    remove(now, *rounds)
    least = written(at.groupBy("at").agg(F.min("id").alias("component")), "least")
    out = at.join(least, "at").select("id", "component")
    alone = first.where("u = v").select(F.col("u").alias("id")).join(at, "id", "left_anti")
    return out.unionByName(alone.withColumn("component", F.col("id")))
