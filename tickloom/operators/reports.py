"""Small operators that join or grade finished statistics: close checks, market-wide comparison, verdicts, summaries of a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, ratio
from tickloom.operators.book_stats import CENT


def close_report(deltas: DataFrame) -> DataFrame:
    """The book at the close of each symbol and day from signed size changes (order_id, life_no, direction, price, delta).

    Live orders, levels, best prices, and the three invariants: not crossed, every resting size positive, and level totals
    equal to their orders' sums.
    """
    order = [*DAY, "direction", "price", "order_id", "life_no"]
    orders = deltas.groupBy(*order).agg(F.sum("delta").alias("rest")).where("rest != 0")
    summed = orders.groupBy(*DAY, "direction", "price").agg(F.sum("rest").alias("by_orders"), F.count("*").alias("orders"), F.min("rest").alias("least"))
    levels = deltas.groupBy(*DAY, "direction", "price").agg(F.sum("delta").alias("size")).where("size != 0")
    both = levels.join(summed, [*DAY, "direction", "price"], "full")
    bid, ask = F.col("direction") == 1, F.col("direction") == -1
    g = both.groupBy(*DAY).agg(
        F.sum("orders").alias("live_orders"), F.count("*").alias("levels"), F.max(F.when(bid, F.col("price"))).alias("bid"),
        F.min(F.when(ask, F.col("price"))).alias("ask"), F.min("least").alias("least_rest"),
        F.count_if(~F.col("size").eqNullSafe(F.col("by_orders"))).alias("wrong_levels"),
    )
    uncrossed = F.coalesce(F.col("bid") < F.col("ask"), F.lit(True)).alias("uncrossed")
    checks = [uncrossed, (F.col("least_rest") > 0).alias("positive"), (F.col("wrong_levels") == 0).alias("reconciled")]
    return g.select(*DAY, "live_orders", "levels", "bid", "ask", (F.col("ask") - F.col("bid")).alias("spread"), *checks)


#: Our statistic, the market-wide file's columns (a count, or a ratio of two), and how ours should stand to it.
COMPARED = {
    "cancel_to_trade": ("Cancels", "LitTrades", "ours lower"), "hidden_rate": ("Hidden", "TradesForHidden", "close"),
    "odd_lot_rate": ("OddLots", "TradesForOddLots", "close"), "trade_to_order_volume": ("LitVol('000)", "OrderVol('000)", "ours higher"),
    "lit_volume": ("LitVol('000)", None, "share"), "lit_trades": ("LitTrades", None, "share"), "cancels": ("Cancels", None, "share"),
}


def activity_comparison(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Seven statistics of ours by ticker beside the market-wide file's: ours, theirs, ratio, expected and as_expected.

    `counts` has a ticker's event counts in the file's window (columns of book_stats.COUNTS), `records` its `fields`. Lit means
    visible, all means visible and hidden. Undefined ratios are null and judged as null.
    """
    every = F.col("trades") + F.col("hidden")
    ours = {
        "cancel_to_trade": ratio("cancels", "trades"), "hidden_rate": ratio("hidden", every), "odd_lot_rate": ratio("odd_lot_trades", every),
        "trade_to_order_volume": ratio("trade_shares", "add_shares"), "lit_volume": F.col("trade_shares").cast("double"),
        "lit_trades": F.col("trades").cast("double"), "cancels": F.col("cancels").cast("double"),
    }

    def theirs(top: str, bottom: str | None) -> Column:
        value = F.col("fields")[top]
        return ratio(value, F.col("fields")[bottom]) if bottom else value

    cells = [
        F.struct(F.lit(k).alias("statistic"), ours[k].alias("ours"), theirs(a, b).alias("theirs"), F.lit(word).alias("expected"))
        for k, (a, b, word) in COMPARED.items()
    ]
    long = counts.join(records.select("ticker", "fields"), "ticker").select("ticker", F.explode(F.array(*cells)).alias("s")).select("ticker", "s.*")
    long = long.withColumn("ratio", ratio("ours", "theirs"))
    r, word = F.col("ratio"), F.col("expected")
    fits = F.when(word == "ours lower", r < 1).when(word == "ours higher", r > 1).when(word == "close", r.between(0.5, 2.0)).otherwise(r.between(0.15, 0.5))
    return long.withColumn("as_expected", fits)


def same_buckets(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """By key, the buckets of both tables and those that only one has, compared as whole rows."""
    names = sorted(set(one.columns) - set(keys))
    mark = lambda df, tag: df.select(*keys, F.struct(*names).alias("row")).groupBy(*keys, "row").agg(F.count("*").alias(tag))
    both = mark(one, "a").join(mark(other, "b"), [*keys, "row"], "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = [F.sum(n("a")).alias("buckets"), F.sum(F.greatest(n("a") - n("b"), F.lit(0))).alias("only_first"), F.sum(F.greatest(n("b") - n("a"), F.lit(0))).alias("only_second")]
    return both.groupBy(*keys).agg(*sums)


def verdict_word() -> Column:
    """Where a forecast's hit rate stands against the band around one half: above, below or inside; `no call` without calls."""
    off = F.col("hit_rate") - 0.5
    return F.when(off.isNull(), "no call").when(off > F.col("band"), "above").when(-off > F.col("band"), "below").otherwise("inside")


def best_horizon(decay: DataFrame, costs: DataFrame, keys: list[str]) -> DataFrame:
    """By key, the horizon `h` of the largest gross edge (all signals, no latency) among those whose forward forecast by flow
    clears the band; ties go to the shorter. A key without one has no row."""
    cleared = decay.where("direction = 'forward' AND predictor = 'ofi' AND clears_band").select("h", "hit_rate", "band")
    edges = costs.where("subset = 'all' AND latency = 0 AND gross IS NOT NULL")
    rows = edges.join(cleared, "h").groupBy(*keys).agg(F.max_by(F.struct("h", "gross", "half_spread", "consumed", "hit_rate", "band"), F.struct("gross", -F.col("h"))).alias("s"))
    return rows.select(*keys, "s.*")


def read_spreads(spark, path: str) -> DataFrame:
    """Effective spreads by name from a CSV with header: ticker, decile, half_bps (half the effective spread), dollar_volume.

    Names without a decile or spread are left out.
    """
    rows = spark.read.csv(path, header=True)
    half = (F.col("effective_bps").try_cast("double") / 2).alias("half_bps")
    volume = F.col("dollar_volume").try_cast("double").alias("dollar_volume")
    return rows.select("ticker", F.col("decile").try_cast("int").alias("decile"), half, volume).where("decile IS NOT NULL AND half_bps IS NOT NULL")


def decile_members(rows: DataFrame, name: str = "ticker") -> DataFrame:
    """By decile: names, inclusive quartiles and range of half_bps, median dollar volume, and the names in order.

    A decile's list of names is the result, and deciles of a day have some hundreds of names.
    """
    half = F.col("half_bps")
    q = F.percentile(half, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    g = rows.groupBy("decile").agg(
        F.count("*").alias("names"), q, F.min(half).alias("least"), F.max(half).alias("most"),
        F.percentile(F.col("dollar_volume").cast("double"), F.lit(0.5)).alias("median_dollar_volume"),
        F.array_join(F.sort_array(F.collect_list(F.col(name).cast("string"))), ", ").alias("tickers"),
    )
    return g.select("decile", "names", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "least", "most", "median_dollar_volume", "tickers")


def contemporaneous(trials: DataFrame) -> DataFrame:
    """By ticker, R2 and origin slope of the last whole-session ten-second calendar fit that the first look logged.

    The slope is read off the trial's note, `beta0=...`.
    """
    some = trials.where("script = 'ofi_first_look.py' AND clock = 'calendar' AND metric = 'r2' AND `window` = '09:30-16:00'")
    last = some.where(F.col("bucket").isin("10", "10.0")).groupBy("ticker").agg(F.max_by(F.struct("value", "note"), "trial_id").alias("t"))
    beta = F.regexp_extract("t.note", r"beta0=([-+0-9.eE]+)", 1).try_cast("double")
    return last.select("ticker", F.col("t.value").try_cast("double").alias("r2"), beta.alias("beta0"))


def summarize_names(bins: DataFrame, calendar: DataFrame, decay: DataFrame, costs: DataFrame, fits: DataFrame) -> DataFrame:
    """One row a ticker from published tables with their ticker: day ratios of the bins' sums, mean updates a bucket, the first look's fit, and
    the flow forecasts of the primary split at 1 and 5 seconds with the cost of the latter. What is missing is null."""
    named = ("two_sided_ns", "spread_x_ns", "mid2_x_ns", "one_cent_ns", "touch_x_ns")
    s = bins.groupBy("ticker").agg(*[F.sum(c).alias(c) for c in named])
    two = "two_sided_ns"
    day = s.select(
        "ticker", ratio("spread_x_ns", two, 1 / CENT).alias("spread_cents"), ratio("spread_x_ns", "mid2_x_ns", 2e4).alias("spread_bps"),
        ratio("one_cent_ns", two).alias("one_cent_share"), ratio("touch_x_ns", two).alias("touch_depth"),
    )
    updates = calendar.groupBy("ticker").agg(F.avg("n_updates").alias("updates_per_10s"))
    forward = decay.where("direction = 'primary' AND predictor = 'ofi'")
    at = lambda h, **cols: forward.where(F.col("horizon_s") == h).select("ticker", *[F.col(c).alias(n) for n, c in cols.items()])
    cost = costs.where("subset = 'all' AND latency = 0 AND horizon_s = 5").select("ticker", F.col("gross_cents").alias("gross_5s"), F.col("half_spread_cents").alias("half_spread_5s"), F.col("consumed").alias("consumed_5s"))
    first = fits.select("ticker", F.col("r2").alias("r2_contemporaneous_10s"), F.col("beta0").alias("beta_contemporaneous"))
    parts = [day, updates, first, at(1, hit_1s="hit_rate", band_1s="band"), at(5, hit_5s="hit_rate", band_5s="band", r2_oos_5s="r2_oos"), cost]
    return reduce(lambda a, b: a.join(b, "ticker", "left"), parts)
