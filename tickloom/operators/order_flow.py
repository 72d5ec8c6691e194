"""Order-flow imbalance: events, calendar and event clocks, regressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, by_seq, hms, ratio
from tickloom.operators.book_stats import BIN, CLOSE, OPEN, best, rolled_up, spine


def touches(rows: DataFrame) -> DataFrame:
    """First level of each side; null where a side is empty."""
    sides = [best(s, f).alias(n) for s, f, n in (("bids", "price", "bid"), ("bids", "size", "bid_size"), ("asks", "price", "ask"), ("asks", "size", "ask_size"))]
    return rows.select(*DAY, "seq", "time_ns", *sides)


def imbalance(prev: Column, bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """Signed change of shares at the touch between two two-sided states."""
    on = lambda p, x: F.when(p, x).otherwise(0)
    return on(bid >= prev["bid"], bid_size) - on(bid <= prev["bid"], prev["bid_size"]) - on(ask <= prev["ask"], ask_size) + on(ask >= prev["ask"], prev["ask_size"])


def events(touch: DataFrame) -> DataFrame:
    """OFI events between consecutive two-sided rows of a day: time_prev, time_ns, e, mid2_prev, mid2. One-sided rows are skipped."""
    two = touch.where("bid IS NOT NULL AND ask IS NOT NULL")
    two = two.withColumn("p", F.lag(F.struct("time_ns", "bid", "bid_size", "ask", "ask_size")).over(by_seq())).where("p IS NOT NULL")
    e = imbalance(F.col("p"), *[F.col(c) for c in ("bid", "bid_size", "ask", "ask_size")])
    return two.select(*DAY, "seq", F.col("p.time_ns").alias("time_prev"), "time_ns", e.cast("bigint").alias("e"), (F.col("p.bid") + F.col("p.ask")).alias("mid2_prev"), (F.col("bid") + F.col("ask")).alias("mid2"))


def day_summary(ev: DataFrame) -> DataFrame:
    """Counts, bought, sold, net and gross flow, largest event (first of ties) with its time, and mid change of each day."""
    e = F.col("e")
    shares = lambda p: F.coalesce(F.sum(F.when(p, F.abs(e))), F.lit(0))
    largest = F.max_by(F.struct("e", "time_ns"), F.struct(F.abs("e"), -F.col("seq")))
    s = ev.groupBy(*DAY).agg(
        F.count("*").alias("n_events"), F.count_if(e == 0).alias("zero"), F.count_if(e > 0).alias("positive"), F.count_if(e < 0).alias("negative"),
        F.sum("e").alias("net"), F.sum(F.abs("e")).alias("gross"), shares(e > 0).alias("buy_shares"), shares(e < 0).alias("sell_shares"),
        largest.alias("top"), F.min_by("mid2_prev", "seq").alias("mid2_open"), F.max_by("mid2", "seq").alias("mid2_close"),
    )
    change = F.col("mid2_close") - F.col("mid2_open")
    return s.select(
        "*", F.col("top.e").alias("largest"), F.col("top.time_ns").alias("largest_ns"), ratio("zero", "n_events").alias("zero_share"),
        ratio(F.abs("net"), "gross").alias("net_share"), (change / 200.0).alias("dmid_cents"), ratio(change, "mid2_open", 1e4).alias("dmid_bps"),
    ).drop("top")


def _flow_sums(ev: DataFrame, width: int, open_ns: int, close_ns: int) -> DataFrame:
    """Sums of a day's events by bucket, -1 before the open and -2 from the close on; events that go back in time fail the query."""
    back = F.col("time_ns") < F.col("time_prev")
    rows = ev.where(F.when(back, F.raise_error(F.lit("events out of order"))).otherwise(F.lit(True)))
    early, late, at = F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"), F.expr(f"(time_ns - {open_ns}) div {width}")
    rows = rows.withColumn("bucket", F.when(F.col("time_ns") < open_ns, early).when(F.col("time_ns") >= close_ns, late).otherwise(at))
    return rows.groupBy(*DAY, "bucket").agg(
        F.count("*").alias("n"), F.count_if(F.col("e") != 0).alias("u"), F.sum("e").alias("s"), F.sum(F.abs("e")).alias("a"),
        F.max_by("mid2", "seq").alias("last"), F.min_by("mid2_prev", "seq").alias("first"),
    )


def calendar(ev: DataFrame, width: int, open_ns: int = OPEN, close_ns: int = CLOSE) -> DataFrame:
    """Buckets of a fixed width, empty ones too; the last ends at the close. Events before the open only move the mid, later than the close none.

    A day whose events go back in time fails the query. One aggregate over the events; all else is one row a bucket.
    """
    sums = _flow_sums(ev, width, open_ns, close_ns).withColumn("width", F.lit(width).cast("bigint"))
    return _buckets(sums, (width,), open_ns, close_ns).drop("width")


def calendars(ev: DataFrame, widths: tuple[int, ...], open_ns: int = OPEN, close_ns: int = CLOSE) -> DataFrame:
    """calendar() of several widths, with the width as `width`: one aggregate over the events, at the widths' common divisor, whose
    buckets add up to each width (the first and last mids are those of the first and last bucket)."""
    fine = math.gcd(*widths)
    sums = rolled_up(_flow_sums(ev, fine, open_ns, close_ns).withColumn("order", F.col("bucket")), "bucket", fine, widths)
    sums = sums.groupBy("width", *DAY, "bucket").agg(*[F.sum(c).alias(c) for c in "nusa"], F.max_by("last", "order").alias("last"), F.min_by("first", "order").alias("first"))
    return _buckets(sums, widths, open_ns, close_ns)


def _buckets(sums: DataFrame, widths: tuple[int, ...], open_ns: int, close_ns: int) -> DataFrame:
    """Measured buckets, empty ones too, of sums with their `width`."""
    keys = ("width", *DAY)
    days = sums.select(*DAY).distinct()
    grids = [spine(days, open_ns, close_ns, w).withColumn("width", F.lit(w).cast("bigint")) for w in widths]
    grid = reduce(DataFrame.unionByName, grids).withColumnRenamed("bin", "bucket")
    each = F.explode(F.array(*[F.lit(w).cast("bigint") for w in widths]))
    grid = grid.unionByName(days.withColumn("bucket", F.lit(-1).cast("bigint")).withColumn("width", each))
    g = grid.join(sums, [*keys, "bucket"], "left")
    order = Window.partitionBy(*keys).orderBy("bucket")
    upto = lambda end: F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, end))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("fallback", F.first("first", ignorenulls=True).over(whole))
    g = g.withColumn("mid2_open", F.coalesce(upto(-1), "fallback")).withColumn("mid2_close", F.coalesce(upto(0), "fallback"))
    begin = F.lit(open_ns) + F.col("bucket") * F.col("width")
    counts = [F.coalesce(c, F.lit(0)).alias(n) for c, n in (("n", "n_events"), ("u", "n_updates"), ("s", "ofi"), ("a", "abs_flow"))]
    edges = [begin.alias("start_ns"), F.least(begin + F.col("width"), F.lit(close_ns)).alias("end_ns")]
    return measured(g.where("bucket >= 0").select(*keys, "bucket", *edges, *counts, "mid2_open", "mid2_close"))


def event_clock(ev: DataFrame, n: int) -> DataFrame:
    """Buckets of n non-zero events. Zero events belong to the open bucket; a last bucket that is not full is dropped."""
    hit = (F.col("e") != 0).cast("bigint")
    upto = F.sum(hit).over(by_seq().rowsBetween(Window.unboundedPreceding, 0))
    rows = ev.withColumn("bucket", F.floor((upto - hit) / n))
    b = rows.groupBy(*DAY, "bucket").agg(F.min("time_prev").alias("start_ns"), F.max("time_ns").alias("end_ns"), F.count("*").alias("n_events"), F.sum(hit).alias("n_updates"), F.sum("e").alias("ofi"), F.sum(F.abs("e")).alias("abs_flow"), F.min_by("mid2_prev", "seq").alias("mid2_open"), F.max_by("mid2", "seq").alias("mid2_close"))
    return measured(b.where(F.col("n_updates") == n))


def measured(buckets: DataFrame) -> DataFrame:
    change = F.col("mid2_close") - F.col("mid2_open")
    return buckets.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns")).withColumn("dmid_cents", change / 200.0).withColumn("dmid_bps", ratio(change, "mid2_open", 1e4)).withColumn("start_hms", hms("start_ns"))


def ols(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Fits of y on x through the origin and with an intercept; both R2 against the centred sum of squares, and the hit rate.

    Slopes are null where x does not vary (through the origin: is 0 throughout), R2 where y does not. One aggregate, of
    central moments that are merged pairwise, so nothing is lost in differences of large sums.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = (a != 0) & (b != 0)
    s = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.sum(a * b).alias("sxy"), F.sum(a * a).alias("sxx"),
        F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("cxy"), F.min(a).alias("x0"), F.max(a).alias("x1"),
        F.min(b).alias("y0"), F.max(b).alias("y1"), F.count_if(both).alias("graded"),
        F.count_if(both & (F.signum(a) == F.signum(b))).alias("hits"),
    )
    x_on = lambda v: F.when(F.col("x0") < F.col("x1"), v)
    y_on = lambda v: F.when(F.col("y0") < F.col("y1"), v)
    beta0, beta = F.when(F.col("sxx") != 0, F.col("sxy") / F.col("sxx")), F.col("cxy") / F.col("vx")
    off = F.col("my") - beta0 * F.col("mx")
    rss0 = F.col("vy") - 2 * beta0 * F.col("cxy") + beta0 * beta0 * F.col("vx") + off * off
    return s.select(
        *keys, "n", beta0.alias("beta0"), y_on(1 - rss0 / F.col("vy")).alias("r2_origin"), x_on(beta).alias("beta"),
        x_on(F.col("my") - beta * F.col("mx")).alias("alpha"), x_on(y_on(F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy")))).alias("r2"),
        ratio("hits", "graded").alias("hit_rate"), (F.col("n") - F.col("graded")).alias("excluded"),
    )


def depth_scaling(buckets: DataFrame, depth: DataFrame, window: int = BIN, open_ns: int = OPEN) -> DataFrame:
    """Origin slope by window of bucket starts, then the log-log fit of slopes on depth: (symbol, day, depth, bin of `window`)."""
    parts = ols(buckets.withColumn("bin", F.expr(f"(start_ns - {open_ns}) div {window}")), [*DAY, "bin"], "ofi", "dmid_cents").join(depth, [*DAY, "bin"], "right")
    good = (F.col("beta0") > 0) & (F.col("depth") > 0)
    logs = parts.select(*DAY, F.when(good, F.ln("depth")).alias("lx"), F.when(good, F.ln("beta0")).alias("ly"), good.alias("good"))
    fit = ols(logs, [*DAY], "lx", "ly")
    seen = logs.groupBy(*DAY).agg(F.count_if("good").alias("used"), F.count_if(~F.coalesce("good", F.lit(False))).alias("skipped"))
    on = lambda c: F.when(F.col("used") >= 3, F.col(c))
    return seen.join(fit, [*DAY], "left").select(*DAY, "used", "skipped", on("beta").alias("slope"), on("alpha").alias("intercept"), on("r2").alias("r2"))
