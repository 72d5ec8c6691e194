"""Cross-sections: places and deciles in a universe, audits of assumed costs, comparisons of our book with a reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, ratio, total
from tickloom.functions.ranks import nearest_place, picks, running_total
from tickloom.operators.book_stats import CENT, best, bin_ratios, holds, level_profile, time_weighted, top_size, windows

METRICS = ("lit_trades", "lit_vol", "cancels", "cancel_to_trade", "trade_to_order_volume", "hidden_rate", "odd_lot_rate")


def derived(records: DataFrame) -> DataFrame:
    """Adds the ratios of an activity record; null where a part is missing or a denominator 0."""
    pairs = {"cancel_to_trade": ("cancels", "lit_trades"), "trade_to_order_volume": ("lit_vol", "order_vol"), "hidden_rate": ("hidden", "trades_for_hidden"), "odd_lot_rate": ("odd_lots", "trades_for_odd_lots")}
    return records.withColumns({k: ratio(a, b) for k, (a, b) in pairs.items() if a in records.columns and b in records.columns})


def percentiles(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Long (ticker, metric, value, percentile): the share of non-null values at or below each.

    Values are counted first, so that one row a distinct value is ordered.
    """
    long = rows.select("ticker", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select("ticker", "s.*")
    counts = long.where("value IS NOT NULL").groupBy("metric", "value").agg(F.count("*").alias("n"))
    upto = running_total(counts, ["value"], "n", "upto", ["metric"], "all")
    return long.join(upto.select("metric", "value", ratio("upto", "all").alias("percentile")), ["metric", "value"], "left").select("ticker", "metric", "value", "percentile")


def deciles(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """The nine nearest-rank cuts of each metric: (metric, decile, cut)."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select("s.*")
    cuts = picks(long, ["metric"], "value", {f"d{k}": nearest_place(k / 10) for k in range(1, 10)})
    cells = F.array(*[F.struct(F.lit(k).alias("decile"), F.col(f"d{k}").alias("cut")) for k in range(1, 10)])
    return cuts.select("metric", F.explode(cells).alias("s")).select("metric", "s.*")


def place(rows: DataFrame, tickers: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Each asked ticker (upper-cased) with values and percentiles, or present = false; and the universe's size."""
    names = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    size = rows.agg(F.count("*").alias("universe"))
    p = percentiles(rows, metrics)
    listed = rows.select("ticker", F.lit(True).alias("known"))
    asked = names.join(listed, "ticker", "left").select("ticker", F.coalesce("known", F.lit(False)).alias("present"))
    return asked.join(p, "ticker", "left").crossJoin(F.broadcast(size))


def audit(rows: DataFrame, medians: DataFrame, figures: DataFrame) -> DataFrame:
    """Assumed one-way costs (reading, figure) against names (half_bps) and decile medians: coverage, nearest decile and factors.

    Figures and deciles are a handful of rows; names are counted once against each figure.
    """
    base = rows.agg(F.percentile("half_bps", F.lit(0.5)).alias("median_all"), F.count("*").alias("names"))
    covered = rows.crossJoin(F.broadcast(figures)).groupBy("reading", "figure").agg(F.count_if(F.col("half_bps") >= F.col("figure")).alias("covered"))
    near = figures.crossJoin(medians.select("decile", "median")).groupBy("reading").agg(F.min_by(F.struct("decile", "median"), F.struct(F.abs(F.ln(F.col("median") / F.col("figure"))), "decile")).alias("near"), F.min_by("median", "decile").alias("bottom"))
    r = covered.join(near, "reading").crossJoin(base)
    factor = F.col("near.median") / F.col("figure")
    return r.select("reading", "figure", "covered", ratio("covered", "names").alias("share_covered"), F.col("near.decile").alias("nearest_decile"), factor.alias("nearest_factor"), factor.between(0.8, 1.25).alias("matches"), (F.col("median_all") / F.col("figure")).alias("factor_median"), (F.col("bottom") / F.col("figure")).alias("factor_bottom_decile"))


def cut_levels(book: DataFrame, k: int) -> DataFrame:
    return book.withColumn("asks", F.slice("asks", 1, k)).withColumn("bids", F.slice("bids", 1, k))


#: The sums that two files of one day must agree on.
TOUCH = ("two_sided_ns", "spread_x_ns", "mid2_x_ns", "one_cent_ns", "touch_x_ns", "trades", "trade_shares")


def levels_agree(one: DataFrame, other: DataFrame, close_ns: int) -> DataFrame:
    """The seven touch sums of two files of messages with their book rows, over one bin from the later first time to the
    close, and whether all are equal. Rows are (symbol, day, seq, time_ns, kind, size, asks, bids)."""
    first = one.groupBy(*DAY).agg(F.min_by("time_ns", "seq").alias("a")).join(other.groupBy(*DAY).agg(F.min_by("time_ns", "seq").alias("b")), [*DAY])
    start = first.select(*DAY, F.greatest("a", "b").alias("from_ns"))

    def sums(rows: DataFrame, tag: str) -> DataFrame:
        s = holds(rows, close_ns).join(start, [*DAY])
        ns = F.greatest(F.lit(0), F.least(F.col("start_ns") + F.col("hold_ns"), F.lit(close_ns)) - F.greatest("start_ns", "from_ns"))
        bid, ask = best("bids", "price"), best("asks", "price")
        two = lambda x: F.when(bid.isNotNull() & ask.isNotNull(), x).otherwise(F.lit(0))
        s = s.withColumn("ns", ns)
        trade = (F.col("kind") == 4) & (F.col("time_ns") >= F.col("from_ns")) & (F.col("time_ns") < close_ns)
        shares = F.coalesce(F.sum(F.when(trade, F.col("size"))), F.lit(0)).cast("bigint")
        size = best("bids", "size") + best("asks", "size")
        made = [total(two(F.col("ns"))), total(two(ask - bid), "ns"), total(two(ask + bid), "ns"), total(two(F.when(ask - bid == CENT, F.col("ns")).otherwise(0)))]
        made += [total(two(size), "ns"), F.count_if(trade), shares]
        return s.groupBy(*DAY).agg(*[m.alias(f"{n}_{tag}") for m, n in zip(made, TOUCH)])

    both = sums(one, "a").join(sums(other, "b"), [*DAY])
    same = reduce(lambda a, b: a & b, [F.col(f"{n}_a") == F.col(f"{n}_b") for n in TOUCH])
    return both.select(*DAY, *[F.col(f"{n}_a").alias(n) for n in TOUCH], same.alias("agree"))


def depth_decomposition(reference: DataFrame, ours: DataFrame, close_ns: int, levels: int = 10) -> DataFrame:
    """Surplus and deficit of our depth over the reference's two-sided time, for the touch and the top `levels`; not clipped to the session."""
    r = holds(reference, close_ns).where("hold_ns > 0").where((F.size("asks") > 0) & (F.size("bids") > 0))
    both = r.select(*DAY, "seq", "hold_ns", F.struct("asks", "bids").alias("r")).join(ours.select(*DAY, "seq", F.struct("asks", "bids").alias("o")), [*DAY, "seq"])
    depth = lambda x, k: top_size(f"{x}.asks", k) + top_size(f"{x}.bids", k)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), depth("r", k).alias("ref"), depth("o", k).alias("our")) for k in (1, levels)])
    rows = both.select(*DAY, "hold_ns", F.explode(cells).alias("c")).select(*DAY, "hold_ns", "c.*")
    more = F.greatest(F.col("our") - F.col("ref"), F.lit(0))
    less = F.greatest(F.col("ref") - F.col("our"), F.lit(0))
    g = rows.groupBy(*DAY, "k").agg(total("hold_ns").alias("ns"), total("ref", "hold_ns").alias("ref_x"), total(more, "hold_ns").alias("surplus_x"), total(less, "hold_ns").alias("deficit_x"))
    return g.select(*DAY, F.col("k").alias("levels"), ratio("ref_x", "ns").alias("reference"), ratio("surplus_x", "ns").alias("surplus"), ratio("deficit_x", "ns").alias("deficit"), ratio(F.col("surplus_x") - F.col("deficit_x"), "ns").alias("net"))


def error_budget(reference: DataFrame, ours: DataFrame, open_ns: int, close_ns: int, levels: int = 10) -> DataFrame:
    """Nine day statistics of our rows and the reference's, the relative error, and whether its sign is the predicted one."""
    expected = {"tw_spread_cents": "lower or equal", "one_cent_share": "none", "touch": "higher", "depth5": "higher", "depth10": "higher", "bid_level": "none", "bid_gap": "none", "ask_level": "none", "ask_gap": "none"}

    def stats(rows: DataFrame) -> DataFrame:
        s, width = holds(rows, close_ns), close_ns - open_ns
        day = bin_ratios(windows(time_weighted(s, width, open_ns, close_ns), {"day": (open_ns, close_ns)}, width, open_ns))
        long = day.select(*DAY, F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in list(expected)[:5]])).alias("s")).select(*DAY, "s.*")
        p = level_profile(s, levels)
        last = p.where(F.col("level") == levels).select(*DAY, F.concat("side", F.lit("_level")).alias("statistic"), F.col("tw_gap_cents").alias("value"))
        gaps = p.where("level > 1").groupBy(*DAY, "side").agg(F.sum(F.col("adjacent_gap_cents") * F.col("exists_ns").cast("double")).alias("x"), F.sum(F.col("exists_ns").cast("double")).alias("n"))
        return long.unionByName(last).unionByName(gaps.select(*DAY, F.concat("side", F.lit("_gap")).alias("statistic"), ratio("x", "n").alias("value")))

    both = stats(reference).withColumnRenamed("value", "reference").join(stats(ours).withColumnRenamed("value", "ours"), [*DAY, "statistic"], "full")
    word = F.coalesce(*[F.when(F.col("statistic") == k, F.lit(v)) for k, v in expected.items()])
    sign = F.when(word == "higher", F.col("ours") > F.col("reference")).when(word == "lower or equal", F.col("ours") <= F.col("reference")).otherwise(F.lit(True))
    return both.select(*DAY, "statistic", "reference", "ours", ratio(F.col("ours") - F.col("reference"), "reference").alias("relative"), word.alias("predicted"), sign.alias("sign_ok"))
