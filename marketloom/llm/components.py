"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself. Edges point to the smaller node."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them: a row a row, since the link to the least is its own."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = F.col("v") == F.col("m")
    return edges.join(least, "u").select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node that it reaches.

    Alternates the two stars until a round changes nothing; each star is written to the shared folder and the table before it
    removed, so no join is computed for two readers. A star gives a row for each row, and links that fall together are put
    into one in the first round, where most do. Self loops, repeated and mirrored edges are harmless; an empty table has no
    nodes. All joins have one row a node on one side, and a node with very many neighbours spreads over tasks because a join's
    large partitions are split. The result is a table of the shared folder, one row a node.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for turn in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        large = materialise(_large_star(now), "stars")
        discard(now)
        small = _small_star(large)
        now = materialise(small if turn else small.distinct(), "stars")
        discard(large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    both = F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.col("v").alias("component")) for c in "uv"))).alias("x")
    named = materialise(now.select(both).select("x.*").distinct(), "components")
    discard(now)
    return named
