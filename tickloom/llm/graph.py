"""Connected components of a graph in shuffles: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, settle_driver, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the least node that is reachable. A written table.

    Each step replaces edges by edges to a neighbourhood's least node and never makes more of them; steps go on until
    nothing changes, about log n of them. All is joins and aggregates with map-side sums: a node of any degree is one
    aggregate and one join key. Null ends and loops are left out; no edges give an empty table.
    """
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    e = written(edges.where(F.col("a") != F.col("b")).select(*ends).distinct(), "cc")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where(F.col("b") > F.col("a")).join(least, "a")
        large = up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x: F.struct(x.alias("a"), F.col("m").alias("b"))
        small = large.join(down, "a").select(F.explode(F.array(pair(F.col("a")), pair(F.col("b")))).alias("e"))
        old, e = e, written(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), "cc")
        discard(old)
        settle_driver(e.sparkSession)
        before, state = state, _state(e)
        if before == state:
            break
    out = e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())
    out = written(out, "components")
    discard(e)
    return out
