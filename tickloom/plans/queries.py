"""Registered queries over the benchmark's tables, each an operator on a market table made by the adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY
from tickloom.functions.ranks import floor_place, picks
from tickloom.operators import book_scan as scan
from tickloom.operators import book_stats as bs
from tickloom.operators import cross_section as cs
from tickloom.operators import forecast as fc
from tickloom.operators import lifecycle as lc
from tickloom.operators import order_flow as of
from tickloom.operators import replay as rp
from tickloom.operators import reports as rr
from tickloom.operators import tape as tp
from tickloom.sources import adapters as ad
from tickloom.sources import itch
from tickloom.sources.shared import kept, shared_path
from tickloom.streaming import stateful

SECOND = 1_000_000_000
WHOLE_DAY = 86_400 * SECOND
BIN = 300 * SECOND
#: Session of the trade tables: whole days of the event month.
TAPE_OPEN, TAPE_CLOSE, HORIZON = 1_704_153_600 * SECOND, 1_706_572_800 * SECOND, 3_600 * SECOND
HORIZONS = (300, 600, 1_800)


def _book(spark, d):
    """The book's rows as a table: reading its levels is cheap, making them anew for each price, size and test is not."""
    return kept(ad.book(spark, d), "book")


def _states(spark, d):
    return bs.holds(_book(spark, d), WHOLE_DAY)


def _long(df: DataFrame, names, exact: bool = False) -> DataFrame:
    """Wide decimals as text; doubles to six places, unless they are `exact` already."""
    kinds = dict(df.dtypes)

    def shown(c: str):
        if kinds[c].startswith("decimal(38"):
            return F.col(c).cast("string").alias(c)
        return F.round(c, 6).alias(c) if kinds[c] == "double" and not exact else F.col(c)

    return df.select(*map(shown, names or df.columns))


def tw_spread_bins(spark, d):
    return _long(bs.bin_ratios(bs.time_weighted(_states(spark, d), BIN, 0, WHOLE_DAY), True), None, True)


def tw_session_bins(spark, d):
    bins = bs.time_weighted(bs.holds(ad.book(spark, d), bs.CLOSE))
    names = (*DAY, "bin", "start_s", "start_hms", "hold_ns", "spread_x_ns", "tw_spread_bps")
    return _long(bs.named_bins(bs.bin_ratios(bins, True)), names, True)


def tw_event_counts(spark, d):
    return bs.event_counts(ad.tape(spark, d), BIN, 0, 2**62)


def tw_day_windows(spark, d):
    bins = bs.time_weighted(_states(spark, d), BIN, 0, WHOLE_DAY)
    w = bs.windows(bins, bs.day_windows(0, WHOLE_DAY), BIN, 0)
    sums, ratios = ("spread_x_ns", "mid2_x_ns", "touch_x_ns"), ("tw_spread_cents", "tw_spread_bps", "depth10", "one_sided_share")
    return _long(bs.bin_ratios(w, True), (*DAY, "window", *sums, *ratios), True)


def level_profile(spark, d):
    return _long(bs.level_profile(_states(spark, d)), None)


def cent_profile(spark, d):
    return _long(bs.cent_profile(_states(spark, d)), None)


def _events(spark, d):
    return of.events(ad.touch(spark, d))


def ofi_events(spark, d):
    return _events(spark, d)


def ofi_day(spark, d):
    return _long(of.day_summary(_events(spark, d)), None)


def ofi_calendar(spark, d):
    return _long(of.calendar(_events(spark, d), 600 * SECOND, 0, WHOLE_DAY), None)


def ofi_event_clock(spark, d):
    return _long(of.event_clock(_events(spark, d), 10), None)


def ofi_ols(spark, d):
    b = of.calendar(_events(spark, d), 600 * SECOND, 0, WHOLE_DAY)
    return _long(of.ols(b, ["day"], "ofi", "dmid_cents"), None)


def ofi_depth_scaling(spark, d):
    hour = 7_200 * SECOND
    depth = bs.bin_ratios(bs.time_weighted(_states(spark, d), hour, 0, WHOLE_DAY)).select(*DAY, "bin", (F.col("touch") / 2).alias("depth"))
    return _long(of.depth_scaling(of.calendar(_events(spark, d), 600 * SECOND, 0, WHOLE_DAY), depth, hour, 0), None)


def ofi_first_look(spark, d):
    ev = _events(spark, d)
    clocks = [of.calendar(ev, w * SECOND, 0, WHOLE_DAY).withColumn("clock", F.lit(f"{w} s")) for w in (600, 3_600)] + [of.event_clock(ev, n).withColumn("clock", F.lit(f"{n} updates")) for n in (5, 20)]
    rows = reduce(DataFrame.unionByName, [c.select("clock", "ofi", "dmid_cents") for c in clocks])
    return _long(of.ols(rows, ["clock"], "ofi", "dmid_cents"), None)


def lifecycle_orders(spark, d):
    return lc.lives(ad.tape(spark, d)).drop("distance")


def lifecycle_ends(spark, d):
    return lc.ends(lc.lives(ad.tape(spark, d)))


def _tape_book(spark, d):
    book = ad.book(spark, d).select("seq", "asks", "bids")
    return ad.tape(spark, d).select(*DAY, "seq").join(book, "seq")


def fill_by_distance(spark, d):
    return _long(lc.fill_by_distance(lc.lives(ad.tape(spark, d), _tape_book(spark, d))), None)


def size_lots(spark, d):
    return _long(lc.size_lots(lc.lives(ad.tape(spark, d))), None)


def _curve(spark, d):
    return lc.kaplan_meier(lc.durations(lc.lives(ad.tape(spark, d))))


def km_curve(spark, d):
    return _long(_curve(spark, d), None)


def km_median(spark, d):
    return lc.km_median(_curve(spark, d))


def survival_grid(spark, d):
    return _long(lc.survival_grid(lc.lives(ad.tape(spark, d)), 9, 5, 7, WHOLE_DAY), None)


def lifetime_quantiles(spark, d):
    died = lc.lives(ad.tape(spark, d)).where("outcome = 'cancelled'")
    return picks(died, [*DAY], "lifetime_ns", {"q25": floor_place(0.25), "q50": floor_place(0.5), "q90": floor_place(0.9)})


def cancel_to_trade(spark, d):
    return _long(lc.cancel_to_trade(ad.tape(spark, d), TAPE_OPEN, TAPE_CLOSE), None)


def lifecycle_summary(spark, d):
    return _long(lc.summarize(ad.tape(spark, d), _tape_book(spark, d)).drop("definition"), None)


def _pairs(spark, d):
    """Forecast pairs of all horizons, pair columns with the horizon h: flow and states are binned once, and wider bins are sums."""
    widths = tuple(h * SECOND for h in HORIZONS)
    spreads = bs.bin_ratios(bs.time_weighted_many(_states(spark, d), widths, 0, WHOLE_DAY))
    h = F.expr(f"cast(width div {SECOND} as int)").alias("h")
    spreads = spreads.select(h, *DAY, F.col("bin").alias("bucket"), F.col("tw_spread_cents").alias("spread"))
    buckets = of.calendars(_events(spark, d), widths, 0, WHOLE_DAY).select("*", h)
    return kept(fc.pairs(buckets, spreads, keys=(*DAY, "h")), "pairs")


def forecast_pairs(spark, d):
    return _rounded(_pairs(spark, d))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def decay(spark, d):
    return _rounded(fc.decay(_pairs(spark, d), ["h"]))


def regimes(spark, d):
    return _rounded(fc.regimes(_pairs(spark, d), ["h"]).drop("label"))


def cost_verdict(spark, d):
    return _rounded(fc.costs(_pairs(spark, d), [*DAY, "h"]))


def asof_quote(spark, d):
    q = tp.prevailing(ad.trades(spark, d), ad.quotes(spark, d), ["ticker"])
    return q.select("ticker", "seq", "price", "quote.bid", "quote.ask", tp.mid().alias("mid"))


def _inside(spark, d):
    return ad.trades(spark, d).where((F.col("time_ns") >= TAPE_OPEN) & (F.col("time_ns") < TAPE_CLOSE))


def lee_ready(spark, d):
    return tp.sign_trades(_inside(spark, d), ad.quotes(spark, d), ["ticker"]).select("ticker", "seq", "price", "mid", "sign")


def trade_spreads(spark, d):
    q = ad.quotes(spark, d)
    s = tp.trade_spreads(tp.sign_trades(_inside(spark, d), q, ["ticker"]), q, ["ticker"], HORIZON, TAPE_CLOSE)
    return _long(s, ("ticker", "seq", "sign", "mid", "effective_bps", "realized_bps", "impact_bps"))


def quoted_spread(spark, d):
    return _rounded(tp.quoted_spread(ad.quotes(spark, d), ["ticker"], TAPE_OPEN, TAPE_CLOSE))


def taq_summary(spark, d):
    return _rounded(tp.summarize_names(ad.trades(spark, d), ad.quotes(spark, d), ["ticker"], TAPE_OPEN, TAPE_CLOSE, HORIZON))


def universe_members(spark, d):
    """Members on the first of every month in which there are orders. A customer is a member for some time from each order on, is named
    after the last order whose name still holds, and is priced on days with orders."""
    o = ad.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    later = lambda n: F.date_add("day", n.cast("int")).alias
    constituents = o.select(F.col("o_custkey").alias("permno"), F.col("day").alias("start"), later(F.col("o_orderkey") % 300)("ending"))
    names = o.select(F.col("o_custkey").alias("permno"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("ticker"), F.col("day").alias("namedt"), later(200 + F.col("o_orderkey") % 200)("nameendt"))
    daily = o.groupBy(F.col("o_custkey").alias("permno"), F.col("day").alias("date")).agg(F.max(-F.col("o_totalprice")).alias("prc"), F.sum(F.col("o_orderkey") % 1_000).alias("vol"))
    return _rounded(tp.members_over(constituents, names, daily, o.select(F.trunc("day", "month").alias("date"))))


def decile_choose(spark, d):
    return tp.choose(ad.universe(spark, d), 3).select("permno", F.col("dollar_volume").cast("string").alias("dollar_volume"), "decile")


def _costs(spark, d):
    """Names with a decile and a made-up half-spread, lower for higher deciles."""
    r = tp.volume_deciles(ad.universe(spark, d))
    return r.select("permno", "decile", ((11 - F.col("decile")) / 2 + (F.col("permno") % 7) / 8).alias("half_bps"))


def decile_medians(spark, d):
    return _long(tp.decile_medians(_costs(spark, d), "half_bps"), None)


def spread_audit(spark, d):
    figures = spark.createDataFrame([("low", 0.5), ("stated", 1.0), ("high", 5.0)], "reading string, figure double")
    rows = _costs(spark, d)
    return _long(cs.audit(rows, tp.decile_medians(rows, "half_bps"), figures), None)


_ACTIVITY = ("lit_trades", "cancels", "cancel_to_trade", "hidden_rate")


def universe_place(spark, d):
    rows = cs.derived(ad.activity(spark, d)).withColumn("ticker", F.col("ticker").cast("string"))
    asked = spark.createDataFrame([("1",), ("7",), ("11",), ("none",)], "ticker string")
    return _long(cs.place(rows, asked, _ACTIVITY), None)


def universe_deciles(spark, d):
    return _long(cs.deciles(cs.derived(ad.activity(spark, d)), _ACTIVITY), None)


def level_identity(spark, d):
    """The tape's day from a file of ten levels and from one of a single level that begins three messages later; symbol 3 has
    rows without bids in the second."""
    ten = ad.tape(spark, d).join(ad.book(spark, d).select("seq", "asks", "bids"), "seq")
    one = cs.cut_levels(ten, 1).withColumn("k", F.row_number().over(bs.by_seq())).where("k > 3").drop("k")
    wrong = (F.col("symbol") == 3) & (F.col("seq") % 50 == 0)
    one = one.withColumn("bids", F.when(wrong, F.slice("bids", 1, 0)).otherwise(F.col("bids")))
    return _long(cs.levels_agree(one, ten, TAPE_CLOSE), None)


def _disturbed(book: DataFrame) -> DataFrame:
    """Our book in place of a replay's: wrong sizes and missing levels at fixed rows."""
    bids = F.when(F.col("seq") % 13 < 3, F.transform("bids", lambda x, i: F.struct(x["price"].alias("price"), F.when(i == 1, x["size"] + 50).otherwise(x["size"]).alias("size")))).when(F.col("seq") % 17 == 0, F.slice("bids", 1, 2)).otherwise(F.col("bids"))
    return book.withColumn("bids", bids)


def depth_decomposition(spark, d):
    book = ad.book(spark, d)
    return _long(cs.depth_decomposition(book, _disturbed(book), WHOLE_DAY), None)


def error_budget(spark, d):
    book = ad.book(spark, d)
    return _rounded(cs.error_budget(book, _disturbed(book), 0, WHOLE_DAY))


def validation_streaks(spark, d):
    book = ad.book(spark, d)
    return _long(rp.validation(rp.graded_rows(_disturbed(book), book, 10)), None)


def validation_hourly(spark, d):
    book = ad.book(spark, d)
    return rp.hourly(rp.graded_rows(_disturbed(book), book, 10))


def clean_replay_levels(spark, d):
    return rp.level_sizes(rp.level_deltas(lc.operations(ad.tape(spark, d)))).select(*DAY, "seq", "direction", "price", "delta", "level_size")


def front_of_queue(spark, d):
    return rp.front_of_queue(rp.level_deltas(lc.operations(ad.tape(spark, d))))


def clean_feed(spark, d) -> DataFrame:
    """Live operations of the tape as a complete feed: bids below and asks above one price, so that nothing crosses."""
    ops = rp.level_deltas(lc.operations(ad.tape(spark, d)).where("kind = 1 OR take > 0"))
    times = ad.tape(spark, d).select(*DAY, "seq", "time_ns")
    left = F.sum("delta").over(bs.Window.partitionBy(*DAY, "order_id", "life_no").orderBy("seq"))
    ops = ops.withColumn("left", left).join(times, [*DAY, "seq"])
    kind = F.when(F.col("delta") > 0, "A").when(F.col("left") == 0, "D").otherwise("X")
    away = 100 * (1 + (F.col("price") / 100).cast("bigint") % 20)
    return ops.select("symbol", F.col("day").cast("bigint").alias("day"), "seq", "time_ns", kind.alias("kind"), F.col("add_seq").alias("order_ref"), F.lit(None).cast("bigint").alias("new_order_ref"), F.when(F.col("direction") == 1, "B").otherwise("S").alias("side"), F.abs("delta").alias("shares"), F.when(F.col("direction") == 1, 1000000 - away).otherwise(1000000 + away).alias("price"))


def clean_replay_stats(spark, d):
    s = rp.replay_stats(scan.replay_feed(clean_feed(spark, d)))
    return s.select(*DAY, "messages", "applied", "anomaly", "crossing", "unknown_ref", "max_live", "clean")


def refused_feed(spark, d) -> DataFrame:
    """The clean feed with executions and replacements in it, and with messages that a book must refuse: unknown, repeated and crossing
    orders, and removals of too much. Two orders far from all others rest on each day, so that what crosses does so always."""
    base = kept(clean_feed(spark, d), "clean").withColumn("n", F.col("seq")).withColumn("seq", 10 * F.col("seq"))
    n, kind = F.col("n"), F.col("kind")
    new = F.lit(None).cast("bigint")
    changed = F.when((kind == "X") & (n % 3 == 0), "E").when((kind == "X") & (n % 3 == 1), "C").when((kind == "D") & (n % 4 == 0), "E").when((kind == "D") & (n % 4 == 1), "U").otherwise(kind)
    replaced = (kind == "D") & (n % 4 == 1)
    shown = lambda df, k, at, ref, to, side, shares, price: df.select(*DAY, (F.col("seq") + at).alias("seq"), "time_ns", k.alias("kind"), ref.alias("order_ref"), to.alias("new_order_ref"), side.alias("side"), shares.cast("bigint").alias("shares"), price.cast("bigint").alias("price"))
    ref, side, shares, price = (F.col(c) for c in ("order_ref", "side", "shares", "price"))
    parts = [shown(base, changed, 0, ref, F.when(replaced, 5 * 10**12 + n), side, F.when(replaced, shares + 5).otherwise(shares), price)]
    some = lambda k: base.where(n % k == 0)
    added = lambda k: base.where((n % k == 0) & (kind == "A"))
    over = F.when(side == "B", 2_000_000).otherwise(1)
    parts += [
        shown(some(11), F.lit("X"), 1, 9 * 10**12 + n, new, side, F.lit(1), price), shown(some(13), F.lit("A"), 2, 8 * 10**12 + n, new, F.lit("B"), F.lit(5), F.lit(2_000_000)),
        shown(added(17), F.lit("A"), 3, ref, new, side, shares, price), shown(added(19), F.lit("X"), 4, ref, new, side, shares, price),
        shown(added(7), F.lit("C"), 5, ref, new, side, shares + 1, price), shown(added(5), F.lit("U"), 6, ref, 7 * 10**12 + n, side, F.lit(3), over),
    ]
    days = base.groupBy(*DAY).agg(F.min("time_ns").alias("time_ns"))
    for k, (s, p) in enumerate((("B", 1_000), ("S", 1_900_000)), 1):
        parts.append(shown(days.withColumn("seq", F.lit(-k).cast("bigint")), F.lit("A"), 0, F.lit(6 * 10**12 + k), new, F.lit(s), F.lit(1), F.lit(p)))
    return reduce(DataFrame.unionByName, parts)


def refused_replay_stats(spark, d):
    """Counters of a feed with refusals. Chunks are small here, so that the tape's days are cut."""
    s = rp.replay_stats(scan.replay_feed(refused_feed(spark, d), 0, 2_000))
    return s.select(*DAY, "messages", "applied", "crossing", "front_violation", "full_fill", "unknown_ref", "anomaly", "max_live", "clean")


def fifo_allocation(spark, d):
    t = ad.tape(spark, d)
    side = lambda k: t.where(F.col("kind") == k).select("symbol", "direction", "seq", "size")
    return rp.fifo_allocation(side(1), side(4), ["symbol", "direction"])


def lobster_repair_replay(spark, d):
    return rp.replay_stats(rp.replay_filtered(ad.tape(spark, d), _tape_book(spark, d), 10))


def filter_view(spark, d):
    return rp.filter_report(rp.filter_feed(clean_feed(spark, d), 3))


def filter_checks(spark, d):
    return rp.filter_checks(kept(rp.filter_feed(clean_feed(spark, d), 3), "filtered"), 3)


def close_report(spark, d):
    return rr.close_report(rp.level_deltas(lc.operations(ad.tape(spark, d))))


def activity_comparison(spark, d):
    """Our messages by symbol inside the tape's session beside the activity of all names that share the symbol's number."""
    inside = bs.event_counts(ad.tape(spark, d), TAPE_CLOSE - TAPE_OPEN, TAPE_OPEN, TAPE_CLOSE)
    counts = inside.groupBy(F.col("symbol").cast("string").alias("ticker")).agg(*[F.sum(c).alias(c) for c in bs.COUNTS])
    a = ad.activity(spark, d).groupBy((F.col("ticker") % 5).cast("string").alias("ticker"))
    named = {"Cancels": "cancels", "LitTrades": "lit_trades", "Hidden": "hidden", "TradesForHidden": "trades_for_hidden", "OddLots": "odd_lots", "TradesForOddLots": "lit_trades", "LitVol('000)": "lit_trades", "OrderVol('000)": "order_vol"}
    cells = [F.lit(k) if i == 0 else F.sum(v).cast("double") for k, v in named.items() for i in (0, 1)]
    return _long(rr.activity_comparison(counts, a.agg(F.create_map(*cells).alias("fields"))), None)


def bucket_identity(spark, d):
    """Flow buckets of the file of ten levels and of the same file cut to one, which are equal, by day."""
    book = ad.book(spark, d)
    made = [of.calendar(of.events(of.touches(b)), 600 * SECOND, 0, WHOLE_DAY) for b in (book, cs.cut_levels(book, 1))]
    return rr.same_buckets(*made, [*DAY])


def verdict_words(spark, d):
    return fc.decay(_pairs(spark, d), ["h"]).select("h", "direction", "predictor", "graded", rr.verdict_word().alias("verdict"))


def best_horizon(spark, d):
    pairs = _pairs(spark, d)
    return _long(rr.best_horizon(fc.decay(pairs, ["h"]), fc.costs(pairs, [*DAY, "h"]), [*DAY]), None)


def decile_members(spark, d):
    volume = ad.universe(spark, d).select("permno", "dollar_volume")
    return _long(rr.decile_members(_costs(spark, d).join(volume, "permno"), "permno"), None)


def itch_decode(spark, d):
    """The clean feed of all symbols written as binary files by a Spark job's tasks and decoded from them: counts, spans and sums by locate, day and type."""
    path = shared_path(spark, "feed")
    ns = F.col("time_ns")
    feed = clean_feed(spark, d).withColumn("stock_locate", (F.col("symbol") + 1).cast("int")).withColumn("stock", F.concat(F.lit("SYM"), F.col("symbol").cast("string")))
    # A feed's times count from midnight and have 48 bits: a file is a day.
    feed = feed.select("stock_locate", F.expr(f"time_ns div {WHOLE_DAY}").alias("day"), "seq", (ns % WHOLE_DAY).alias("time_ns"), "kind", "order_ref", "side", "shares", "price", "stock")
    itch.write_itch(feed, path).agg(F.sum("messages")).collect()
    back = itch.read_itch(spark, path)
    sums = back.groupBy("file", "kind", "stock_locate").agg(F.min("stock").alias("stock"), F.count_if(F.col("side") == "B").alias("bids"), *[F.sum(c).alias(c) for c in ("order_ref", "shares", "price")])
    both = itch.describe_itch(back).join(sums, ["file", "kind"])
    size = F.create_map(*[F.lit(x) for k, n in itch.LENGTHS.items() for x in (k, n + 2)])
    both = both.withColumn("day", F.split("file", "-")[1].cast("bigint")).withColumn("bytes", F.col("messages") * size[F.col("kind")])
    total = [F.sum(c).alias(c) for c in ("messages", "bytes", "not_decoded", "bids", "order_ref", "shares", "price")]
    return both.groupBy("stock_locate", "day", "kind").agg(F.min("stock").alias("stock"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), *total)


def stream_ofi_calendar(spark, d):
    ev = stateful.run_through(spark, ad.book(spark, d).select(*DAY, "seq", "time_ns", "asks", "bids"), stateful.flow_events)
    return _long(of.calendar(ev.where("NOT late").drop("late"), 600 * SECOND, 0, WHOLE_DAY), None)


def stream_book(spark, d):
    rows = stateful.run_through(spark, ad.tape(spark, d), stateful.book_states).where("NOT closed")
    return rows.groupBy("symbol").agg(F.count("*").alias("messages"), F.sum("applied").alias("applied"), F.sum("dark").alias("dark"), F.sum("evicted").alias("evicted"), F.count_if("late").alias("late"))


_ALL = (
    tw_spread_bins, tw_session_bins, tw_event_counts, tw_day_windows, level_profile, cent_profile, ofi_events, ofi_day, ofi_calendar, ofi_event_clock, ofi_ols, ofi_depth_scaling, ofi_first_look,
    lifecycle_orders, lifecycle_ends, fill_by_distance, size_lots, km_curve, km_median, survival_grid, lifetime_quantiles, cancel_to_trade,
    lifecycle_summary, forecast_pairs, decay, regimes, cost_verdict,
    asof_quote, lee_ready, trade_spreads, quoted_spread, taq_summary, universe_members, decile_choose, decile_medians, spread_audit, universe_place, universe_deciles, level_identity, depth_decomposition, error_budget,
    validation_streaks, validation_hourly, clean_replay_levels, front_of_queue, clean_replay_stats, refused_replay_stats, fifo_allocation, lobster_repair_replay, filter_view, filter_checks, itch_decode, stream_ofi_calendar, stream_book,
    close_report, activity_comparison, bucket_identity, verdict_words, best_horizon, decile_members,
)
QUERIES = {f.__name__: f for f in _ALL}
