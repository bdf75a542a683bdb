"""Connected components by alternating large-star and small-star steps.

Every step replaces a node's links by links to the smallest neighbour; the number of steps
grows with the logarithm of the longest path.  Neighbourhoods are never gathered: each step
takes a minimum per node and joins it back.  A hub (a node with more than one in ``HUBS`` of
all links) doesn't meet its links in one task: there are at most ``2 * HUBS`` hubs, and their
minima are broadcast.  Every round's links are published, so neither the plan nor the
recomputation after a lost executor grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import publish

MAX_STEPS = 60
HUBS = 1000


def with_least(links: DataFrame, n: int) -> DataFrame:
    """``links`` (u, v) with m, the smallest v of their u; ``n``: about how many there are."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    hub = F.col("_n") > max(1, n // HUBS)
    marked = links.join(F.broadcast(least.filter(hub).select("u", F.col("m").alias("_m"))), "u", "left")
    rest = marked.filter("_m is null").select("u", "v").join(least.filter(~hub).select("u", "m"), "u")
    return rest.unionByName(marked.filter("_m is not null").select("u", "v", F.col("_m").alias("m")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to
    another.  Self links and nulls do not count; repeated links count once."""
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    edges = publish(edges, "links")
    for _ in range(MAX_STEPS):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = edges.count()
        large = (with_least(both, n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
                 .filter("u != v").distinct())
        # small star: neighbours below a node and the node go to the smallest of them
        small = (with_least(large, n).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        edges = publish(small, "stars")
        # done when all links are stars: no node has two centres, or is a centre and has one
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("has"), F.lit(0).alias("is")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("has"), F.lit(1).alias("is")))
        open_ = (ends.groupBy("node").agg(F.sum("has").alias("has"), F.max("is").alias("is"))
                 .agg(F.max((F.col("has") + F.col("is") > 1).cast("int")).alias("more")).first()["more"])
        if not open_:
            break
    else:
        raise RuntimeError(f"links are not yet stars after {MAX_STEPS} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
