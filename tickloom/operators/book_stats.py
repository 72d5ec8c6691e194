"""Time-weighted statistics of book states: bins, day windows, level and cent profiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, by_seq, hms, millionths, ratio, total

SECOND = 1_000_000_000
OPEN, CLOSE, BIN = 34_200 * SECOND, 57_600 * SECOND, 300 * SECOND
CENT = 100
#: The accumulators' names are columns of published tables.
SUMS = (
    "hold_ns", "two_sided_ns", "one_sided_ns", "empty_ns", "spread_x_ns", "mid2_x_ns", "one_cent_ns", "touch_x_ns",
    "depth5_x_ns", "depth10_x_ns",
)
COUNTS = (
    "messages", "adds", "add_shares", "cancels", "cancel_shares", "trades", "trade_shares", "hidden", "hidden_shares",
    "odd_lot_trades",
)


def top_size(levels: str, k: int) -> Column:
    return F.aggregate(F.slice(levels, 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x["size"])


def best(levels: str, field: str) -> Column:
    return F.get(levels, F.lit(0))[field]


def aligned(messages: DataFrame, book: DataFrame) -> DataFrame:
    """Messages with the book row of the same number; a message or row without its partner fails the query."""
    both = messages.withColumn("_m", F.lit(True)).join(book.select(*DAY, "seq", "asks", "bids", F.lit(True).alias("_b")), [*DAY, "seq"], "full")
    checked = F.when(F.col("_m").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("messages and book rows do not align at seq "), F.col("seq").cast("string")))).otherwise(F.lit(True))
    return both.where(checked).drop("_m", "_b")


def holds(rows: DataFrame, close: int = CLOSE) -> DataFrame:
    """Adds start_ns and hold_ns, the time until the next row of the day (at least 0); the last holds to the close."""
    after = F.coalesce(F.lead("time_ns").over(by_seq()), F.lit(close))
    return rows.withColumn("start_ns", F.col("time_ns")).withColumn("hold_ns", F.greatest(F.lit(0), after - F.col("time_ns")))


def _bins(open_ns: int, close_ns: int, width: int) -> int:
    return -(-(close_ns - open_ns) // width)


def spine(days: DataFrame, open_ns: int, close_ns: int, width: int) -> DataFrame:
    """All bins of each day, empty ones too."""
    return days.select(*DAY).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_bins(open_ns, close_ns, width) - 1).cast("bigint"))))


def time_weighted(states: DataFrame, width: int = BIN, open_ns: int = OPEN, close_ns: int = CLOSE) -> DataFrame:
    """Integer sums by (symbol, day, bin): states are clipped to the session and split at bin edges; bins keep their full width."""
    made = _bin_sums(states, width, open_ns, close_ns)
    return _filled(spine(states, open_ns, close_ns, width), made, [*DAY, "bin"])


def time_weighted_many(states: DataFrame, widths: tuple[int, ...], open_ns: int = OPEN, close_ns: int = CLOSE) -> DataFrame:
    """time_weighted() of several widths, with the width as `width`: states are split once, at the edges of the widths' common
    divisor, and these bins are summed up to each width."""
    fine = math.gcd(*widths)
    made = rolled_up(_bin_sums(states, fine, open_ns, close_ns), "bin", fine, widths)
    sums = made.groupBy("width", *DAY, "bin").agg(*[F.sum(n).cast("decimal(38,0)").alias(n) for n in SUMS])
    grid = [spine(states, open_ns, close_ns, w).withColumn("width", F.lit(w)) for w in widths]
    return _filled(reduce(DataFrame.unionByName, grid), sums, ["width", *DAY, "bin"])


def rolled_up(rows: DataFrame, bin_: str, fine: int, widths: tuple[int, ...]) -> DataFrame:
    """Rows of bins of width `fine` once for each of the widths, which are multiples of it, with `width` and the number of the wider bin.
    Numbers below 0 stay."""
    each = F.explode(F.array(*[F.lit(w).cast("bigint") for w in widths]))
    return rows.withColumn("width", each).withColumn(bin_, F.expr(f"CASE WHEN {bin_} < 0 THEN {bin_} ELSE {bin_} div (width div {fine}) END"))


def _filled(grid: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,0)")
    return grid.join(sums, keys, "left").select(*keys, *[F.coalesce(F.col(n), zero).alias(n) for n in SUMS])


def _bin_sums(states: DataFrame, width: int, open_ns: int, close_ns: int) -> DataFrame:
    lo, hi = F.greatest("start_ns", F.lit(open_ns)), F.least(F.col("start_ns") + F.col("hold_ns"), F.lit(close_ns))
    cut = states.select(*DAY, best("bids", "price").alias("bid"), best("asks", "price").alias("ask"), best("bids", "size").alias("bid_size"), best("asks", "size").alias("ask_size"),
                        *[(top_size("bids", k) + top_size("asks", k)).alias(f"depth{k}") for k in (5, 10)], (lo - open_ns).alias("lo"), (hi - open_ns).alias("hi")).where("lo < hi")
    cut = cut.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    cut = cut.withColumn("ns", F.least("hi", (F.col("bin") + 1) * width) - F.greatest("lo", F.col("bin") * width))
    two, none = F.col("bid").isNotNull() & F.col("ask").isNotNull(), F.col("bid").isNull() & F.col("ask").isNull()
    on = lambda x: F.when(two, x)
    sums = [total("ns"), total(on(F.col("ns"))), total(F.when(~two & ~none, F.col("ns"))), total(F.when(none, F.col("ns"))), total(on(F.col("ask") - F.col("bid")), "ns"), total(on(F.col("ask") + F.col("bid")), "ns"),
            total(F.when(two & (F.col("ask") - F.col("bid") == CENT), F.col("ns"))), total(on(F.col("bid_size") + F.col("ask_size")), "ns"), total(on(F.col("depth5")), "ns"), total(on(F.col("depth10")), "ns")]
    return cut.groupBy(*DAY, "bin").agg(*[s.alias(n) for s, n in zip(sums, SUMS)])


def event_counts(messages: DataFrame, width: int = BIN, open_ns: int = OPEN, close_ns: int = CLOSE) -> DataFrame:
    """Message counts and shares by (symbol, day, bin); messages out of the session are dropped."""
    k, size = F.col("kind"), F.col("size")
    n = lambda p: F.count_if(p).cast("bigint")
    shares = lambda p: F.coalesce(F.sum(F.when(p, size)), F.lit(0)).cast("bigint")
    add, cancel, trade, hidden = k == 1, k.isin(2, 3), k == 4, k == 5
    made = [F.count("*").cast("bigint"), n(add), shares(add), n(cancel), shares(cancel), n(trade), shares(trade), n(hidden), shares(hidden), n(k.isin(4, 5) & (size < 100))]
    inside = messages.where((F.col("time_ns") >= open_ns) & (F.col("time_ns") < close_ns))
    return inside.groupBy(*DAY, F.expr(f"(time_ns - {open_ns}) div {width}").alias("bin")).agg(*[x.alias(c) for x, c in zip(made, COUNTS)])


def bin_ratios(bins: DataFrame, exact: bool = False) -> DataFrame:
    """The nine derived ratios of summed bins; null where their time is 0. With `exact` they are rounded half up to six places
    by integer division, so that any engine gives the same.

    One-sided time is that in which a side is missing, or both are, of all time.
    """
    two, lacking = "two_sided_ns", F.col("one_sided_ns") + F.col("empty_ns")
    made = {
        "tw_spread_ticks": ("spread_x_ns", two, 1, 1), "tw_spread_cents": ("spread_x_ns", two, 1, CENT),
        "tw_spread_bps": ("spread_x_ns", "mid2_x_ns", 20_000, 1), "tw_mid": ("mid2_x_ns", two, 1, 2),
        "one_cent_share": ("one_cent_ns", two, 1, 1), "touch": ("touch_x_ns", two, 1, 1), "depth5": ("depth5_x_ns", two, 1, 1),
        "depth10": ("depth10_x_ns", two, 1, 1), "one_sided_share": (lacking, "hold_ns", 1, 1),
    }
    of = millionths if exact else lambda a, b, times, over: ratio(a, b, times / over)
    return bins.select("*", *[of(*v).alias(k) for k, v in made.items()])


def named_bins(bins: DataFrame, width: int = BIN, open_ns: int = OPEN) -> DataFrame:
    start = F.lit(open_ns) + F.col("bin") * width
    return bins.withColumn("start_s", (start / SECOND).cast("bigint")).withColumn("start_hms", hms(start))


def windows(bins: DataFrame, parts: dict[str, tuple[int, int]], width: int = BIN, open_ns: int = OPEN) -> DataFrame:
    """Sums of the bins that lie wholly inside each named window: a second, small aggregate over the bins."""
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(a).alias("a"), F.lit(z).alias("z")) for k, (a, z) in parts.items()])
    rows = bins.withColumn("w", F.explode(named)).where((F.col("bin") * width + open_ns >= F.col("w.a")) & ((F.col("bin") + 1) * width + open_ns <= F.col("w.z")))
    return rows.groupBy(*DAY, F.col("w.name").alias("window")).agg(*[F.sum(n).cast("decimal(38,0)").alias(n) for n in SUMS if n in bins.columns])


def day_windows(open_ns: int = OPEN, close_ns: int = CLOSE, midday: tuple[int, int] = (39_600 * SECOND, 50_400 * SECOND)) -> dict[str, tuple[int, int]]:
    return {"day": (open_ns, close_ns), "open5": (open_ns, open_ns + BIN), "midday": midday, "close5": (close_ns - BIN, close_ns)}


def _two_sided(states: DataFrame) -> DataFrame:
    return states.where((F.size("asks") > 0) & (F.size("bids") > 0) & (F.col("hold_ns") > 0))


def _sides(states: DataFrame, levels: int) -> DataFrame:
    """One row a two-sided state and side, with its levels `l`, best first."""
    side = lambda name: F.struct(F.lit(name).alias("side"), F.slice(f"{name}s", 1, levels).alias("l"))
    rows = _two_sided(states).select(*DAY, "hold_ns", F.explode(F.array(side("ask"), side("bid"))).alias("s"))
    return rows.select(*DAY, "hold_ns", "s.side", "s.l")


def _long(states: DataFrame, levels: int) -> DataFrame:
    """One row a state, side and rank, with the gap to the best price and the step from the level before."""
    rows = _sides(states, levels).select(*DAY, "hold_ns", "side", "l", F.posexplode("l").alias("rank", "x"))
    gap = F.abs(F.col("x.price") - F.col("l")[0]["price"]).alias("gap")
    step = F.when(F.col("rank") > 0, F.abs(F.col("x.price") - F.get("l", F.col("rank") - 1)["price"])).alias("step")
    return rows.select(*DAY, "hold_ns", "side", "rank", F.col("x.size").alias("size"), gap, step)


def level_profile(states: DataFrame, levels: int = 10) -> DataFrame:
    """By side and rank over two-sided time, not clipped to the session: exists, size, gap and adjacent-gap sums and ratios.

    `side_gap_cents` and `side_one_cent_share` are over all adjacent gaps of the side. Levels without a gap before them, the
    first, have null for their own.
    """
    whole = _two_sided(states).groupBy(*DAY).agg(total("hold_ns").alias("two_sided_ns"))
    one_cent = F.when(F.col("step") == CENT, F.col("hold_ns")).otherwise(F.lit(0))
    sums = _long(states, levels).groupBy(*DAY, "side", (F.col("rank") + 1).cast("bigint").alias("level")).agg(
        total("hold_ns").alias("exists_ns"), total("size", "hold_ns").alias("size_x_ns"), total("gap", "hold_ns").alias("gap_x_ns"),
        total("step", "hold_ns").alias("step_x_ns"), total(one_cent).alias("one_cent_ns"),
    )
    sums = sums.withColumn("gaps_ns", F.when(F.col("level") > 1, F.col("exists_ns")))
    side = Window.partitionBy(*DAY, "side")
    gaps = F.sum("gaps_ns").over(side)
    r = sums.join(whole, [*DAY])
    return r.select(
        *DAY, "side", "level", "exists_ns", "size_x_ns", ratio("size_x_ns", "exists_ns").alias("tw_size"),
        ratio("gap_x_ns", "exists_ns", 1 / CENT).alias("tw_gap_cents"), ratio("exists_ns", "two_sided_ns").alias("exists_share"),
        ratio("step_x_ns", "gaps_ns", 1 / CENT).alias("adjacent_gap_cents"), ratio("one_cent_ns", "gaps_ns").alias("one_cent_gap_share"),
        ratio(F.sum("step_x_ns").over(side), gaps, 1 / CENT).alias("side_gap_cents"),
        ratio(F.sum("one_cent_ns").over(side), gaps).alias("side_one_cent_share"),
    )


def cent_profile(states: DataFrame, levels: int = 10, max_cents: int = 20) -> DataFrame:
    """By side and cents behind the best: shares times time, their mean over the time in which the book reaches so far
    (beyond it depth is unknown, not zero), and coverage, that time's share."""
    rows = _long(states, levels).withColumn("cent", F.expr(f"gap div {CENT}"))
    sizes = rows.groupBy(*DAY, "side", "cent").agg(total("size", "hold_ns").alias("size_x_ns"))
    last = F.least(F.expr(f"abs(element_at(l, -1).price - l[0].price) div {CENT}"), F.lit(max_cents).cast("bigint"))
    reach = _sides(states, levels).groupBy(*DAY, "side", last.alias("cent")).agg(total("hold_ns").alias("reach_ns"))
    cents = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_cents).cast("bigint")))
    grid = reach.select(*DAY, "side").distinct().withColumn("cent", cents)
    down = Window.partitionBy(*DAY, "side").orderBy(F.col("cent").desc())
    zero = F.lit(0).cast("decimal(38,0)")
    g = grid.join(sizes, [*DAY, "side", "cent"], "left").join(reach, [*DAY, "side", "cent"], "left")
    g = g.withColumn("covered_ns", F.coalesce(F.sum("reach_ns").over(down), zero).cast("decimal(38,0)"))
    whole = _two_sided(states).groupBy(*DAY).agg(total("hold_ns").alias("two_sided_ns"))
    size = F.coalesce("size_x_ns", zero)
    means = [ratio(size, "covered_ns").alias("tw_size"), ratio("covered_ns", "two_sided_ns").alias("coverage")]
    return g.join(whole, [*DAY]).select(*DAY, "side", "cent", size.alias("size_x_ns"), "covered_ns", *means)
