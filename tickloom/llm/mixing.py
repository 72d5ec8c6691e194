"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import discard, free_name, written

#: Weights of sources in code-point order (null last), repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents in one slice of a source's shuffled order, on average.
SLICE_ROWS = 2_000
#: Sources up to which the table with one row a source is broadcast; more of them are joined by shuffling.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target tokens of each source by water-filling: adds weight, cap and target to (source, source_size, ...).

    The budget, `share` times all tokens, is dealt by weight; a source stops at `most` times its size and what it
    leaves is dealt anew. With sources in order of cap / weight the capped ones come first, and the level (budget
    left over weight left) at the first that is not capped holds for all after it. One row a source is sorted
    here, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    given = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = given.withColumn("free_level", F.when(level <= F.col("cap") / F.col("weight"), level))
    final = F.first("free_level", ignorenulls=True).over(everything)
    return leveled.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * final, F.col("cap")))).drop("free_level")


def mix_sources(docs: DataFrame, size: Column, source: str = "source", keys: tuple[str, ...] = ("doc_id", "text"), weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """`docs` with a struct column `mix`: size, source_size, weight, target, copies and taken (size times copies).

    Each source's documents are shuffled by an MD5 of `seed` and `keys` and queued up to `most` times, one whole
    round after the other. A copy's virtual finish time is the tokens of its source up to and with it, divided by the
    source's target. Copies are ordered by finish time over all sources and cut where their sizes reach the budget of
    `share` times all tokens. At time 1 every source has used its target at most, so all up to then is taken; past
    it copies are taken in order while they fit, so each source ends within a document of its target.

    Null sizes count 0, and a document of size 0 takes 0. A null source is a source of its own, last in order. Rows
    equal in source, keys and size tie and share one fate. An empty table gives an empty one. A column called `mix`
    is replaced. Equal input gives equal results, whatever the partitions.

    No source is one task's: its shuffled order is cut into slices of about SLICE_ROWS documents, sums are made by
    slice, and only the slices around the cut are sorted. What comes back to the documents is one row a source, the
    last copy that it takes, so documents are never shuffled.
    """
    carried = [c for c in docs.columns if c.lower() != "mix"]
    src, n, order = (free_name(docs, c) for c in ("mix_source", "mix_size", "mix_order"))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.md5(F.col(k).cast("string")), F.lit("")) for k in keys]))
    rows = docs.select(*carried, F.col(source).alias(src), F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")).alias(n), shuffled.alias(order))
    queue = written(rows.select(F.col(src).alias("source"), F.col(n).alias("n"), F.col(order).alias("o")), "mix-queue")

    totals = written(queue.groupBy("source").agg(F.sum("n").alias("source_size"), F.count("*").alias("rows"), F.max("n").alias("longest")), "mix-totals")
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / SLICE_ROWS)).cast("int")
    info = written(source_targets(totals, weights, share, float(most)).withColumn("slices", slices), "mix-sources")
    whole = info.agg(F.count("*").alias("sources"), F.sum("source_size").alias("tokens"), F.sum("longest").alias("reach")).first()
    small = whole["sources"] <= BROADCAST_SOURCES
    lookup = F.broadcast if small else (lambda x: x)
    budget, reach = float(share) * (whole["tokens"] or 0), float(whole["reach"] or 0)

    def slice_of(o: Column, count: Column) -> Column:
        return F.floor(F.conv(F.substring(o, 1, 8), 16, 10).cast("bigint") * count / F.lit(float(1 << 32))).cast("int")

    at = lookup(info.select(F.col("source").alias("s"), "slices", "target", "source_size"))
    sliced = queue.join(at, queue["source"].eqNullSafe(at["s"])).withColumn("slice", slice_of(F.col("o"), F.col("slices")))
    sums = sliced.groupBy("source", "slice").agg(F.sum("n").alias("tokens"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    rounds = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("base", F.col("base") + F.col("copy") * F.col("source_size"))
    edge = written(rounds.where((F.col("base") + F.col("tokens") > F.col("target")) & (F.col("base") <= F.col("target") + F.lit(reach))).select("source", "slice", "copy", "base"), "mix-edge")

    near = lookup(edge.select(F.col("source").alias("e"), F.col("slice").alias("e_slice"), "copy", "base"))
    inside = Window.partitionBy("source", "copy", "slice").orderBy("o", "n").rowsBetween(Window.unboundedPreceding, 0)
    queued = sliced.join(near, sliced["source"].eqNullSafe(near["e"]) & (sliced["slice"] == near["e_slice"]))
    queued = queued.select("source", "slice", "copy", "o", "n", "target", (F.col("base") + F.sum("n").over(inside)).alias("upto"))
    queued = written(queued.withColumn("finish", F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(0.0)), "mix-queued")

    first = edge.groupBy("source").agg(F.min(F.struct("copy", "slice", F.lit("").alias("o"), F.lit(-1).cast("bigint").alias("n"), "base")).alias("f"))
    upto = queued.where("upto <= target").groupBy("source").agg(F.max("upto").alias("sure"), F.max(F.struct("copy", "slice", "o", "n")).alias("last"))
    state = info.select("source", "target").join(first.withColumnRenamed("source", "fs"), F.col("source").eqNullSafe(F.col("fs")), "left")
    state = state.join(upto.withColumnRenamed("source", "us"), F.col("source").eqNullSafe(F.col("us")), "left")
    end = F.struct(F.lit(most).alias("copy"), F.lit(0).alias("slice"), F.lit("").alias("o"), F.lit(-1).cast("bigint").alias("n"))
    before = F.struct(F.col("f.copy"), F.col("f.slice"), F.col("f.o"), F.col("f.n"))
    state = state.select("source", F.coalesce("sure", F.col("f.base").cast("double"), "target").alias("sure"), F.when(F.col("f").isNull(), end).otherwise(F.coalesce("last", before)).alias("last"))
    state = written(state, "mix-state")
    used = state.agg(F.sum("sure").alias("used")).first()["used"] or 0.0

    line = Window.orderBy("finish", F.col("source").asc_nulls_last(), "o", "n").rowsBetween(Window.unboundedPreceding, 0)
    more = queued.where("upto > target").where(F.col("upto") <= F.col("target") + F.lit(max(0.0, budget - used))).withColumn("total", F.sum("n").over(line) + F.lit(used)).where(F.col("total") <= F.lit(budget))
    more = more.groupBy("source").agg(F.max(F.struct("copy", "slice", "o", "n")).alias("m")).withColumnRenamed("source", "ms")
    last = state.join(more, F.col("source").eqNullSafe(F.col("ms")), "left").select(F.col("source").alias("ls"), F.coalesce("m", "last").alias("last"))
    cuts = info.join(last, F.col("source").eqNullSafe(F.col("ls")), "left").select(F.struct("source", "source_size", "weight", "target", "slices", "last").alias("mix_at"))
    cuts = lookup(written(cuts, "mix-cuts").withColumn("mix_key", F.col("mix_at.source")))
    discard(queue, totals, info, edge, queued, state)

    info_at = free_name(docs, "mix_at")
    cuts = cuts.select(F.col("mix_at").alias(info_at), F.col("mix_key").alias(free_name(docs, "mix_key")))
    joined = rows.join(cuts, rows[src].eqNullSafe(cuts[free_name(docs, "mix_key")]), "left")
    place = [F.struct(F.lit(c).alias("copy"), slice_of(F.col(order), F.col(f"{info_at}.slices")).alias("slice"), F.col(order).alias("o"), F.col(n).alias("n")) for c in range(most)]
    copies = sum((F.when(p <= F.col(f"{info_at}.last"), 1).otherwise(0) for p in place), F.lit(0)).cast("int")
    mix = F.struct(F.col(n).alias("size"), *[F.col(f"{info_at}.{c}").alias(c) for c in ("source_size", "weight", "target")], copies.alias("copies"), (copies * F.col(n)).cast("bigint").alias("taken"))
    return joined.select(*carried, mix.alias("mix"))
