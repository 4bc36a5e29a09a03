"""Connected components of a table of links, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.shared import written

MAX_ROUNDS = 60  # rounds needed grow with the logarithm of the longest path


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked with by any path; columns ``a`` and ``b`` of the edges.

    Alternating stars: first every greater neighbour of a node is tied to the node's least
    neighbour, then every lesser one. Links are rewritten to the shared folder each round, so
    that lost executors cost one round at most. A node with many links is a hot key of a join
    with one row on the other side, which runtime skew handling splits; minima are taken before
    the shuffle. Nodes without links do not appear; an empty table gives an empty one.
    """
    now = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    now = written(now, "links")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.selectExpr("lo AS u", "hi AS v").union(now.selectExpr("hi AS u", "lo AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("m AS lo", "v AS hi").where("lo <> hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").selectExpr("m", "lo AS v").union(down.selectExpr("m", "hi AS v"))
        now = written(small.where("v <> m").selectExpr("m AS lo", "v AS hi").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    nodes = now.selectExpr("hi AS node", "lo AS root")
    return nodes.union(now.selectExpr("lo AS node", "lo AS root").distinct())


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``node, root`` after more edges. Only links between different components are worked on."""
    if roots is None:
        return written(components(edges), "roots")
    left, right = roots.selectExpr("node AS a", "root AS _ra"), roots.selectExpr("node AS b", "root AS _rb")
    ends = edges.join(left, "a", "left").join(right, "b", "left").selectExpr("coalesce(_ra, a) AS a", "coalesce(_rb, b) AS b")
    more = written(components(ends), "merges")
    moved = more.selectExpr("node AS root", "root AS _to")
    old = roots.join(moved, "root", "left").selectExpr("node", "coalesce(_to, root) AS root")
    fresh = more.join(roots, "node", "left_anti").select("node", "root")
    return written(old.unionByName(fresh), "roots")


def _settled(links: DataFrame) -> bool:
    """Whether every node has one lesser end at most, and none that has is a lesser end itself: then all are stars."""
    ends = links.select(F.inline(F.array(*[F.struct(F.col(c).alias("u"), F.lit(c == "hi").cast("int").alias("up")) for c in ("lo", "hi")])))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.where("up > 1 OR (up = 1 AND n > 1)").isEmpty()
