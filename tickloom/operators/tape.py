"""Quotes and trades: strict as-of joins, trade signs, quoted, effective and realized spreads, liquidity deciles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import ratio
from tickloom.functions.ranks import numbered

SECOND = 1_000_000_000
FIVE_MINUTES = 300 * SECOND
BPS = 1e4
#: Fixed value: sale conditions whose trades are not used.
CONDITIONS = "[OZBTLGWJK]"


def usable_trades(raw: DataFrame, open_ns: int, close_ns: int) -> DataFrame:
    """Uncorrected regular trades of the session: columns time_ns, correction, condition."""
    return raw.where((F.col("time_ns") >= open_ns) & (F.col("time_ns") < close_ns) & (F.col("correction") == "00") & ~F.coalesce(F.col("condition"), F.lit("")).rlike(CONDITIONS))


def members(constituents: DataFrame, names: DataFrame, daily: DataFrame, date: str) -> DataFrame:
    """Index members of a day with the ticker that was valid then and, where there is one, the day's price and volume.

    constituents (permno, start, ending), names (permno, ticker, namedt, nameendt), daily (permno, date, prc, vol); dates are ISO text or dates.
    """
    day = constituents.sparkSession.createDataFrame([(date,)], "date string")
    return members_over(constituents, names, daily, day).drop("date")


def members_over(constituents: DataFrame, names: DataFrame, daily: DataFrame, days: DataFrame) -> DataFrame:
    """members() of many days (date), a row a date and member. Of names valid at once the one that began last counts, then the greater ticker.

    Intervals meet days by year: an interval, cut to the span of the days, is a row for each year that it touches, joined on the year and
    then tested. A null end is open; days and intervals that are null or empty match nothing, and repeated ones count once.
    """
    asked = days.select(F.col("date").cast("date").alias("date")).where("date IS NOT NULL").distinct()
    span = asked.agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
    asked = asked.withColumn("year", F.year("date"))

    def valid(rows: DataFrame, start: str, end: str, *columns: str) -> DataFrame:
        begin, stop = F.col(start).cast("date"), F.coalesce(F.col(end).cast("date"), F.lit(span["z"]))
        cut = rows.select("permno", *columns, begin.alias("begin"), stop.alias("stop")).where((F.col("begin") <= F.lit(span["z"])) & (F.col("stop") >= F.lit(span["a"])) & (F.col("begin") <= F.col("stop")))
        years = F.sequence(F.year(F.greatest("begin", F.lit(span["a"]))), F.year(F.least("stop", F.lit(span["z"]))))
        return cut.withColumn("year", F.explode(years)).join(asked, "year").where("date BETWEEN begin AND stop").drop("year", "stop")

    inside = valid(constituents, "start", "ending").select("date", "permno").distinct()
    named = valid(names, "namedt", "nameendt", "ticker").groupBy("date", "permno").agg(F.max(F.struct("begin", "ticker"))["ticker"].alias("ticker"))
    traded = daily.select("permno", F.col("date").cast("date").alias("date"), F.abs("prc").alias("close"), F.col("vol").alias("volume"))
    found = inside.join(named, ["date", "permno"]).join(traded, ["date", "permno"], "left")
    return found.withColumn("dollar_volume", F.col("close") * F.col("volume"))


def two_sided(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid > 0) & (ask > 0) & (ask > bid), F.lit(False))


def prevailing(asks: DataFrame, quotes: DataFrame, keys: list[str], at: str = "time_ns") -> DataFrame:
    """`asks` with `quote` (bid, ask), the last quote strictly before `at`; of equal times the last in file order; null before the first.

    A union and one running window by key, so one shuffle and sort serve any number of rows on both sides.
    """
    null_row = F.lit(None).cast(asks.select(F.struct(*asks.columns)).schema[0].dataType)
    left = asks.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_seq"), F.struct(*asks.columns).alias("_row"), F.lit(None).cast("struct<bid:double,ask:double>").alias("_q"))
    right = quotes.select(*keys, F.col("time_ns").alias("_t"), F.lit(1).alias("_kind"), F.col("seq").alias("_seq"), null_row.alias("_row"), F.struct(F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask")).alias("_q"))
    run = Window.partitionBy(*keys).orderBy("_t", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("quote", F.last("_q", ignorenulls=True).over(run)).where("_kind = 0").select("_row.*", "quote")


def mid(quote: str = "quote") -> Column:
    """Mid of the prevailing quote; null if it is not two-sided."""
    b, a = F.col(f"{quote}.bid"), F.col(f"{quote}.ask")
    return F.when(two_sided(b, a), (b + a) / 2)


def quoted_spread(quotes: DataFrame, keys: list[str], open_ns: int, close_ns: int) -> DataFrame:
    """Time-weighted quoted spread over the session: the ratio of two integrals, with the time two-sided and excluded."""
    order = Window.partitionBy(*keys).orderBy("time_ns", "seq")
    end = F.least(F.coalesce(F.lead("time_ns").over(order), F.lit(close_ns)), F.lit(close_ns))
    q = quotes.withColumn("hold", end - F.greatest("time_ns", F.lit(open_ns))).where("hold > 0").withColumn("two", two_sided(F.col("bid"), F.col("ask")))
    on = lambda x: F.sum(F.when(F.col("two"), x))
    g = q.groupBy(*keys).agg(on((F.col("ask") - F.col("bid")) * F.col("hold")).alias("spread_x"), on((F.col("ask") + F.col("bid")) / 2 * F.col("hold")).alias("mid_x"), F.coalesce(on(F.col("hold")), F.lit(0)).alias("two_sided_ns"), F.coalesce(F.sum(F.when(~F.col("two"), F.col("hold"))), F.lit(0)).alias("excluded_ns"))
    return g.select(*keys, ratio("spread_x", "mid_x", BPS).alias("quoted_bps"), ratio("spread_x", "two_sided_ns", 100).alias("quoted_cents"), "two_sided_ns", "excluded_ns", ratio("mid_x", "two_sided_ns").alias("mid"), ratio("two_sided_ns", F.col("two_sided_ns") + F.col("excluded_ns")).alias("two_sided_share"))


def sign_trades(trades: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Trades with mid and sign: the quote test, at the mid the tick test, at no tick the last tick; 0 without a mid or a tick."""
    t = prevailing(trades, quotes, keys).withColumn("mid", mid())
    order = Window.partitionBy(*keys).orderBy("time_ns", "seq")
    tick = F.signum(F.col("price") - F.lag("price").over(order))
    t = t.withColumn("tick", tick).withColumn("last_tick", F.last(F.when(F.col("tick") != 0, F.col("tick")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.signum(F.col("price") - F.col("mid"))
    sign = F.when(F.col("mid").isNull(), 0).when(gap != 0, gap).otherwise(F.coalesce("last_tick", F.lit(0)))
    return t.withColumn("sign", sign.cast("int")).drop("tick", "last_tick")


def trade_spreads(signed: DataFrame, quotes: DataFrame, keys: list[str], horizon_ns: int = FIVE_MINUTES, close_ns: int | None = None) -> DataFrame:
    """Effective, realized and impact in basis points of each signed trade; unsigned ones are dropped.

    Realized and impact need a two-sided mid strictly before time + horizon, inside the session.
    """
    s = signed.where("sign != 0").drop("quote").withColumn("later_ns", F.col("time_ns") + horizon_ns)
    s = prevailing(s, quotes, keys, "later_ns").withColumn("mid_later", mid() if close_ns is None else F.when(F.col("later_ns") < close_ns, mid()))
    bps = lambda a, b: 2 * F.col("sign") * (F.col(a) - F.col(b)) / F.col("mid") * BPS
    return s.drop("quote").withColumn("effective_bps", bps("price", "mid")).withColumn("realized_bps", bps("price", "mid_later")).withColumn("impact_bps", bps("mid_later", "mid"))


def summarize_names(trades: DataFrame, quotes: DataFrame, keys: list[str], open_ns: int, close_ns: int, horizon_ns: int = FIVE_MINUTES) -> DataFrame:
    """One row a name: quoted spread, simple and dollar-weighted mean spreads, shares unsigned and without realized spread, volumes."""
    inside = trades.where((F.col("time_ns") >= open_ns) & (F.col("time_ns") < close_ns))
    spreads = trade_spreads(sign_trades(inside, quotes, keys), quotes, keys, horizon_ns, close_ns).withColumn("dollars", F.col("price") * F.col("size"))
    real = F.col("realized_bps").isNotNull()
    weighted = lambda c: (F.sum(F.col(c) * F.col("dollars")) / F.sum(F.when(F.col(c).isNotNull(), F.col("dollars")))).alias(f"{c}_dw")
    means = spreads.groupBy(*keys).agg(F.count("*").alias("signed"), F.count_if(real).alias("with_real"), F.count_if(F.col("sign") > 0).alias("buys"), *[F.avg(c).alias(c) for c in ("effective_bps", "realized_bps", "impact_bps")], *[weighted(c) for c in ("effective_bps", "realized_bps", "impact_bps")])
    base = inside.groupBy(*keys).agg(F.count("*").alias("trades"), F.sum("size").alias("shares"), F.sum(F.col("price") * F.col("size")).alias("dollar_volume"))
    r = base.join(means, keys, "left").join(quoted_spread(quotes, keys, open_ns, close_ns), keys, "left")
    r = r.withColumn("signed", F.coalesce("signed", F.lit(0)))
    return r.withColumn("unsigned_share", ratio(F.col("trades") - F.col("signed"), "trades")).withColumn("no_realized_share", ratio(F.col("signed") - F.col("with_real"), "signed")).withColumn("buy_share", ratio("buys", "signed")).drop("with_real", "buys")


def volume_deciles(universe: DataFrame) -> DataFrame:
    """Names with a dollar volume, ranked ascending, with decile min(10, 1 + 10 i // n)."""
    ranked = numbered(universe.where("dollar_volume > 0"), ["dollar_volume", "permno"], "i", total="n").withColumn("i", F.col("i") - 1)
    return ranked.withColumn("decile", F.least(F.lit(10), 1 + F.expr("(10 * i) div n")).cast("int"))


def choose(universe: DataFrame, per_decile: int) -> DataFrame:
    """`per_decile` names of each decile, evenly spaced by rank inside it."""
    d = volume_deciles(universe).withColumn("place", F.row_number().over(Window.partitionBy("decile").orderBy("i")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("decile")))
    picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(per_decile), F.col("size")).cast("int") - 1), lambda j: F.floor(j * F.col("size") / F.least(F.lit(per_decile), F.col("size"))) + F.floor(F.col("size") / (2 * F.least(F.lit(per_decile), F.col("size")))))
    return d.where(F.array_contains(picks, F.col("place").cast("bigint"))).drop("i", "n", "place", "size")


def decile_medians(rows: DataFrame, value: str) -> DataFrame:
    """Names, quartiles, least and most of `value` by decile; the median is the mean of the middle two."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("decile").agg(F.count("*").alias("names"), q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most")).select("decile", "names", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "least", "most")
