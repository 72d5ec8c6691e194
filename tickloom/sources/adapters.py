"""Deterministic market tables made from the benchmark's `events`, `lineitem` and `supplier` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = {1: 1103515245, 2: 22695477, 3: 1664525, 4: 1103527590, 5: 134775813}
KINDS = {"signup": 1, "view": 2, "error": 3, "purchase": 4, "click": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(i: int) -> Column:
    g = "(event_id div 3)"
    return F.expr(f"(({g} * {g} * {69069 + 15838 * i} + {g} * {_STEP[i]} + {12345 * i}) % 2147483648) div 65536")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order messages: symbol, day (of the epoch), seq, time_ns (of the epoch), kind, order_id, size, price, direction."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()])
    return _timed(spark, sf_dir).select(
        (F.col("user_id") % 5).cast("int").alias("symbol"), F.expr("us div 86400000000").alias("day"), F.col("event_id").alias("seq"), (F.col("us") * 1000).alias("time_ns"), kind.alias("kind"), (F.col("event_id") % 13).alias("order_id"),
        (1 + F.floor("value")).cast("bigint").alias("size"), (1000000 + 100 * F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).alias("price"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"),
    )


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: symbol (0), day (of the epoch), seq, time_ns (of the day), both best prices and sizes, number and step of levels."""
    e = _timed(spark, sf_dir).select("event_id", "us", *[mixed(i).alias(f"r{i}") for i in (1, 2, 3, 4)])
    day = F.expr("us div 86400000000")
    e = e.select(F.lit(0).alias("symbol"), day.alias("day"), F.col("event_id").alias("seq"), ((F.col("us") - day * 86400000000) * 1000).alias("time_ns"), "r1", "r2", "r3", "r4")
    e = e.withColumn("bid", 1000000 + 100 * (F.col("r1") % 11)).withColumn("ask", F.col("bid") + 100 * (1 + F.col("r2") % 5))
    sizes = [(100 * (1 + F.col(r) % 6) + F.col(r) % 7).cast("bigint").alias(n) for n, r in (("bid_size", "r3"), ("ask_size", "r4"))]
    return e.select("*", *sizes, (3 + F.col("r3") % 8).cast("int").alias("levels"), (100 * (1 + F.col("r2") % 3)).alias("step"), (F.col("seq") % 97 == 0).alias("no_bids"))


def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first levels of book(), as a table of best quotes has them: symbol, day, seq, time_ns, bid, bid_size, ask, ask_size."""
    e = _drawn(spark, sf_dir)
    return e.select("symbol", "day", "seq", "time_ns", *[F.when(~F.col("no_bids"), F.col(c)).alias(c) for c in ("bid", "bid_size")], "ask", "ask_size")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book rows, one an event: symbol (0), day (of the epoch), seq, time_ns (of the day), asks and bids, best first."""
    e = _drawn(spark, sf_dir)

    def side(best: str, sign: int) -> Column:
        price = lambda j: (F.col(best) + sign * F.col("step") * (j - 1)).cast("bigint")
        at = lambda j: F.struct(price(j).alias("price"), (F.col(f"{best}_size") + 10 * (j - 1)).cast("bigint").alias("size"))
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(10), F.col("levels"))), at)

    bids = F.when(F.col("no_bids"), F.slice(side("bid", -1), 1, 0)).otherwise(side("bid", -1))
    return e.select("symbol", "day", "seq", "time_ns", side("ask", 1).alias("asks"), bids.alias("bids"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of one name: ticker, seq, time_ns, bid, ask (dyadic dollars)."""
    bid = 100 + 0.25 * (mixed(1) % 16)
    q = _timed(spark, sf_dir).where(F.col("event_type").isin("view", "click", "error"))
    return q.select((F.col("user_id") % 4).cast("int").alias("ticker"), F.col("event_id").alias("seq"), (F.col("us") * 1000).alias("time_ns"), bid.cast("double").alias("bid"), (bid + 0.5 * (mixed(2) % 4)).cast("double").alias("ask"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: ticker, seq, time_ns, price, size."""
    t = _timed(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    price = 100 + 0.25 * (F.col("event_id") % 16) + 0.25 * (mixed(5) % 3 - 1)
    return t.select((F.col("user_id") % 4).cast("int").alias("ticker"), F.col("event_id").alias("seq"), (F.col("us") * 1000).alias("time_ns"), price.cast("double").alias("price"), (1 + F.floor("value")).cast("bigint").alias("size"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a dollar volume: suppliers and what they sold, exact to the cent."""
    volume = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("permno")).agg(volume.cast("decimal(38,2)").alias("dollar_volume"), F.count("*").alias("volume"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity records by name, as a market-wide file has them: ticker and counts of message types."""
    n = lambda k: F.count_if(F.col("event_type") == k).cast("bigint")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker")).agg(
        n("signup").alias("order_vol"), n("view").alias("cancels"), n("purchase").alias("lit_trades"), n("click").alias("hidden"), n("error").alias("odd_lots"), F.count("*").alias("trades_for_hidden"),
    )
