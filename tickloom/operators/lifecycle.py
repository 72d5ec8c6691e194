"""Order lives from add to end, and product-limit survival curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, by_seq, ratio
from tickloom.functions.ranks import floor_place, picks
from tickloom.operators.book_stats import CENT, best
from tickloom.sources.shared import kept

ADD, REDUCE, DELETE, EXECUTE, HIDDEN = 1, 2, 3, 4, 5


def operations(messages: DataFrame) -> DataFrame:
    """Messages of kinds 1 to 4 with the order's life number, what rests before each and what it takes; dark ones have no live order."""
    order = by_seq(*DAY, "order_id")
    ops = messages.where(F.col("kind").between(1, 4)).withColumn("life_no", F.count_if(F.col("kind") == ADD).over(order))
    inside = Window.partitionBy(*DAY, "order_id", "life_no").orderBy("seq")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ops = ops.withColumn("added", F.when(F.col("life_no") > 0, F.first("size").over(inside)))
    ops = ops.withColumn("cum", F.coalesce(F.sum(F.when(F.col("kind") != ADD, F.col("size"))).over(before), F.lit(0))).withColumn("deleted", F.coalesce(F.max(F.col("kind") == DELETE).over(before), F.lit(False)))
    ops = ops.withColumn("dark", (F.col("kind") != ADD) & ((F.col("life_no") == 0) | F.col("deleted") | ((F.col("cum") > 0) & (F.col("cum") >= F.col("added")))))
    ops = ops.withColumn("rest", F.greatest(F.col("added") - F.col("cum"), F.lit(0)))
    acts = (F.col("kind") != ADD) & ~F.col("dark")
    ops = ops.withColumn("take", F.when(acts, F.when(F.col("kind") == DELETE, F.col("rest")).otherwise(F.least("size", "rest"))))
    return ops.withColumn("ends", acts & ((F.col("kind") == DELETE) | (F.col("size") >= F.col("rest")))).withColumn("disagrees", acts & ((F.col("size") > F.col("rest")) | ((F.col("kind") == DELETE) & (F.col("size") != F.col("rest")))))


def lives(messages: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """One row a life: added, executed and cancelled shares, fills, end; live orders at the end are censored.

    With book rows, `distance` is whole cents behind the best of the side in the row before the add, toward zero.
    """
    ops = operations(messages).where("life_no > 0 AND NOT dark")
    if book is not None:
        prior = book.select(*DAY, "seq", *[F.lag(best(s, "price")).over(by_seq()).alias(n) for s, n in (("bids", "prior_bid"), ("asks", "prior_ask"))])
        ops = ops.join(prior, [*DAY, "seq"], "left")
    else:
        ops = ops.withColumn("prior_bid", F.lit(None).cast("bigint")).withColumn("prior_ask", F.lit(None).cast("bigint"))
    k = F.col("kind")
    on = lambda p, c: F.coalesce(F.sum(F.when(p, F.col(c))), F.lit(0))
    first = lambda c: F.min_by(c, "seq")
    out = ops.groupBy(*DAY, "order_id", "life_no").agg(
        first("time_ns").alias("added_ns"), first("direction").alias("direction"), first("price").alias("price"), first("size").alias("added"), on(k == EXECUTE, "take").alias("executed"), on(k.isin(REDUCE, DELETE), "take").alias("cancelled"),
        F.count_if(k == EXECUTE).alias("fills"), F.min(F.when(k == EXECUTE, F.col("time_ns"))).alias("first_fill_ns"), F.max("time_ns").alias("last_seen_ns"), F.max(F.when(F.col("ends"), F.col("time_ns"))).alias("end_ns"), F.max(F.when(F.col("ends"), k)).alias("end_kind"),
        F.count_if("disagrees").alias("disagreements"), F.min_by(F.when(F.col("direction") == 1, F.col("prior_bid") - F.col("price")).otherwise(F.col("price") - F.col("prior_ask")), "seq").alias("behind"),
    )
    out = out.withColumn("outcome", F.when(F.col("end_ns").isNull(), "censored").when(F.col("end_kind") == EXECUTE, "executed").otherwise("cancelled"))
    return out.withColumn("remaining", F.col("added") - F.col("executed") - F.col("cancelled")).withColumn("lifetime_ns", F.col("end_ns") - F.col("added_ns")).withColumn("censor_ns", F.when(F.col("end_ns").isNull(), F.col("last_seen_ns") - F.col("added_ns"))).withColumn("distance", F.expr(f"behind div {CENT}")).drop("behind")


#: Buckets of cents behind the best, and times at which the summary reads survival, with their names.
DISTANCE_BUCKETS = ("improve", "at_best", "1", "2_to_5", "6_to_10", "over_10", "unknown")
SURVIVAL_TIMES = {
    "1ms": 10**6, "10ms": 10**7, "100ms": 10**8, "1s": 10**9, "10s": 10**10,
    "1min": 60 * 10**9, "10min": 600 * 10**9, "1h": 3_600 * 10**9,
}


def distance_bucket(d: Column) -> Column:
    return F.when(d.isNull(), "unknown").when(d < 0, "improve").when(d == 0, "at_best").when(d == 1, "1").when(d <= 5, "2_to_5").when(d <= 10, "6_to_10").otherwise("over_10")


def lot(size: Column) -> Column:
    return F.when(size < 100, "odd").when(size % 100 == 0, "round").otherwise("mixed")


def ends(life: DataFrame) -> DataFrame:
    return life.groupBy(*DAY, "outcome").agg(F.count("*").alias("orders"), F.sum("added").alias("added"), F.sum("executed").alias("executed"), F.sum("cancelled").alias("cancelled"), F.sum("remaining").alias("remaining"))


def fill_by_distance(life: DataFrame) -> DataFrame:
    filled = F.count_if(F.col("executed") > 0)
    g = life.groupBy(*DAY, distance_bucket(F.col("distance")).alias("bucket")).agg(F.count("*").alias("orders"), filled.alias("filled"), F.sum("added").alias("shares"), F.sum("executed").alias("filled_shares"))
    return g.withColumn("fill_rate", ratio("filled", "orders")).withColumn("share_fill_rate", ratio("filled_shares", "shares"))


def size_lots(life: DataFrame) -> DataFrame:
    g = life.groupBy(*DAY, lot(F.col("added")).alias("lot")).agg(F.count("*").alias("orders"), F.sum("added").alias("shares"))
    return g.withColumn("order_share", ratio("orders", F.sum("orders").over(Window.partitionBy(*DAY))))


def durations(life: DataFrame) -> DataFrame:
    """(symbol, day, t, died): lifetimes of orders whose end is seen, executed or cancelled; all others are censored at their bound."""
    seen = F.col("outcome") != "censored"
    return life.select(*DAY, F.when(seen, F.col("lifetime_ns")).otherwise(F.col("censor_ns")).alias("t"), seen.alias("died"))


def kaplan_meier(times: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Product-limit curve: rows at event times with at_risk, deaths and survival. Deaths come before censorings at ties.

    Times are counted first; windows see one row a distinct time.
    """
    keys = list(DAY) if keys is None else keys
    n = times.groupBy(*keys, "t").agg(F.count_if("died").alias("deaths"), F.count("*").alias("leaving"))
    n = n.withColumn("at_risk", F.sum("leaving").over(Window.partitionBy(*keys).orderBy(F.col("t").desc())))
    n = n.where("deaths > 0").withColumn("survival", F.product(1 - F.col("deaths").cast("double") / F.col("at_risk")).over(Window.partitionBy(*keys).orderBy("t")))
    return n.select(*keys, "t", "at_risk", "deaths", "survival")


def km_median(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least time with survival of one half or less; null where the curve stays above."""
    keys = list(DAY) if keys is None else keys
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def survival_at(curve: DataFrame, grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Survival at the times of `grid` (keys, t): the last step at or before, 1 before the first. One union and window."""
    keys = list(DAY) if keys is None else keys
    both = curve.select(*keys, "t", "survival", F.lit(False).alias("asked")).unionByName(grid.select(*keys, "t", F.lit(None).cast("double").alias("survival"), F.lit(True).alias("asked")))
    w = Window.partitionBy(*keys).orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("survival", F.coalesce(F.last("survival", ignorenulls=True).over(w), F.lit(1.0))).where("asked").drop("asked")


#: Length of a session, and its survival grid: whole nanoseconds from 10**5, 20 a decade, up to 10**11.
SESSION_NS = 23_400 * 10**9


def survival_grid(life: DataFrame, first_power: int = 5, per_decade: int = 20, decades: int = 6, session_ns: int = SESSION_NS) -> DataFrame:
    """Survival at log-spaced times up to the session's length, which is the last point: the product-limit curve, the plain share
    of observed lifetimes that are longer, and the orders behind both. A day without observed ends has no plain share."""
    times = durations(life)
    spaced = [int(10 ** (first_power + k / per_decade)) for k in range(per_decade * decades + 1)]
    points = F.array(*[F.lit(t).cast("bigint") for t in [*[t for t in spaced if t <= session_ns], session_ns]])
    whole = times.groupBy(*DAY).agg(F.count_if("died").alias("n_observed"), F.count_if(~F.col("died")).alias("n_censored"))
    grid = whole.withColumn("t", F.explode(points))
    km = survival_at(kaplan_meier(times), grid).withColumnRenamed("survival", "s_km").distinct()
    died = times.where("died").groupBy(*DAY, "t").agg(F.count("*").alias("n"))
    asked = grid.select(*DAY, "t", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked")).distinct()
    both = died.select(*DAY, "t", "n", F.lit(False).alias("asked")).unionByName(asked)
    upto = F.sum("n").over(Window.partitionBy(*DAY).orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0))
    plain = both.withColumn("gone", upto).where("asked").join(whole, [*DAY])
    return km.join(plain.select(*DAY, "t", (1 - ratio("gone", "n_observed")).alias("s_naive"), "n_observed", "n_censored"), [*DAY, "t"])


#: The window of the market-wide activity file.
ACTIVITY_OPEN, ACTIVITY_CLOSE = 34_500 * 10**9, 57_600 * 10**9
_KINDS = {"adds": ADD, "reduces": REDUCE, "deletes": DELETE, "executes": EXECUTE, "hiddens": HIDDEN}


def cancel_to_trade(messages: DataFrame, open_ns: int = ACTIVITY_OPEN, close_ns: int = ACTIVITY_CLOSE) -> DataFrame:
    """Cancels to trades by messages (all day, and from open_ns to close_ns), by orders and by shares.

    By orders are orders that end cancelled to orders that end executed. Executions, hidden ones and those of unknown
    orders too, are counted by lot.
    """
    inside = (F.col("time_ns") >= open_ns) & (F.col("time_ns") < close_ns)
    n = lambda p: F.count_if(p)
    kinds = [n(F.col("kind") == k).alias(c) for c, k in _KINDS.items()]
    kinds += [n(inside & (F.col("kind") == k)).alias(f"{c}_inside") for c, k in _KINDS.items()]
    executed = F.col("kind").isin(EXECUTE, HIDDEN)
    lots = [n(executed & (lot(F.col("size")) == k)).alias(f"{k}_lots") for k in ("round", "odd", "mixed")]
    raw = messages.groupBy(*DAY).agg(*kinds, *lots)
    shares = F.coalesce(F.sum(F.when(F.col("dark"), F.col("size"))), F.lit(0)).alias("dark_shares")
    dark = operations(messages).groupBy(*DAY).agg(n(F.col("dark")).alias("dark_ops"), shares)
    ended = [n(F.col("outcome") == k).alias(f"{k}_orders") for k in ("cancelled", "executed")]
    sums = [F.sum(k).alias(f"{k}_shares") for k in ("cancelled", "executed")]
    life = lives(messages).groupBy(*DAY).agg(*ended, *sums)
    r = raw.join(dark, [*DAY], "left").join(life, [*DAY], "left")
    trades = lambda tail: F.col(f"executes{tail}") + F.col(f"hiddens{tail}")
    cancels = lambda tail: F.col(f"reduces{tail}") + F.col(f"deletes{tail}")
    return r.select(
        "*", ratio(cancels(""), trades("")).alias("by_messages"), ratio(cancels("_inside"), trades("_inside")).alias("by_messages_inside"),
        ratio("cancelled_orders", "executed_orders").alias("by_orders"), ratio("cancelled_shares", "executed_shares").alias("by_shares"),
        ratio("hiddens", trades("")).alias("hidden_share"), ratio("odd_lots", trades("")).alias("odd_lot_share"),
    )


#: What each statistic of the summary is; {x} stands for what its name adds.
DEFINITIONS = {
    "orders_added": "orders whose add is in the file",
    "orders_executed": "orders whose last shares left by execution",
    "orders_cancelled": "orders whose last shares left by cancel or delete",
    "orders_censored": "orders without an observed end",
    "share_executed": "orders_executed over orders_added",
    "share_cancelled": "orders_cancelled over orders_added",
    "share_censored": "orders_censored over orders_added",
    "shares_added": "shares of adds",
    "shares_executed": "shares executed against orders of the file",
    "shares_cancelled": "shares cancelled or deleted of orders of the file",
    "shares_unresolved": "added shares whose removal is not observed",
    "_p": "quantile of observed lifetimes of that end, ms",
    "share_under": "share of observed lifetimes below the time",
    "share_over": "share of observed lifetimes of the time or more",
    "censored_share": "orders without an observed end over orders_added",
    "median_ms": "least time with product-limit survival of one half or less, ms",
    "S_at": "share of orders alive after the time: product-limit, or of observed lifetimes alone",
    "_orders": "adds at this distance from the side's best just before",
    "_share_of_adds": "orders of this distance over orders_added",
    "_fill_rate_shares": "shares executed over shares added, this distance",
    "_fill_rate_orders": "orders with an execution over orders, this distance",
    "adds_": "adds of this kind of lot over orders_added",
    "add_size_p50": "median size of adds",
    "add_size_mean": "mean size of adds",
    "by_messages_full_day": "cancels and deletes over executions and hidden executions, messages of the whole day",
    "by_messages_midas_window": "the same from the start of the activity file's window",
    "by_orders": "orders that end cancelled over orders that end executed",
    "by_shares": "shares cancelled over shares executed",
    "hidden_share_of_executions": "hidden executions over all executions",
    "odd_lot_share_of_executions": "executions below 100 shares over all executions",
    "dark_ops": "operations on orders that the file never added",
    "dark_shares": "shares of these operations",
    "hidden_execs": "hidden executions",
    "size_disagreements": "removals of more than rested, and deletes of another size",
    "readded_ids": "adds of an id that is alive",
}


def _definition(section: str, statistic: str) -> str:
    """A statistic's definition: by its whole name, else by how it begins or ends."""
    if section == "fill_by_distance":
        return DEFINITIONS[next(k for k in ("_share_of_adds", "_fill_rate_shares", "_fill_rate_orders", "_orders") if statistic.endswith(k))]
    found = [k for k in DEFINITIONS if k == statistic] or [k for k in ("share_under", "share_over", "S_at", "adds_") if statistic.startswith(k)]
    return DEFINITIONS[(found or ["_p"])[0]]


def summarize(messages: DataFrame, book: DataFrame) -> DataFrame:
    """Long (symbol, day, section, statistic, value, definition): ends, observed and product-limit lifetimes, fills by distance,
    sizes, cancel-to-trade and accounting. Every day has every statistic: counts of nothing are 0, ratios, quantiles and plain
    survival of nothing null."""
    before = F.lag("outcome").over(Window.partitionBy(*DAY, "order_id").orderBy("life_no"))
    life = kept(lives(messages, book).withColumn("readds", F.coalesce(before == "censored", F.lit(False))), "lives")
    out = []

    def add(section: str, rows: DataFrame, names: dict[str, Column]) -> None:
        shown = lambda k, v: F.struct(F.lit(k).alias("statistic"), v.cast("double").alias("value"), F.lit(_definition(section, k)).alias("definition"))
        cells = F.array(*[shown(k, v) for k, v in names.items()])
        out.append(rows.select(*DAY, F.lit(section).alias("section"), F.explode(cells).alias("s")).select(*DAY, "section", "s.*"))

    ended = ("executed", "cancelled", "censored")
    seen = F.col("outcome") != "censored"
    ns = F.when(seen, F.col("lifetime_ns"))
    lots = [F.count_if(lot(F.col("added")) == k).alias(f"lot_{k}") for k in ("round", "odd", "mixed")]
    caps = {"under_100ms": ns < 10**8, "under_1s": ns < 10**9, "over_1min": ns >= 60 * 10**9}
    longer = {f"S_at_{k}": ns > t for k, t in SURVIVAL_TIMES.items()}
    bucket = distance_bucket(F.col("distance"))
    parts = []
    for k in DISTANCE_BUCKETS:
        of = lambda c, here=(bucket == k): F.sum(F.when(here, F.col(c)))
        parts += [F.count_if(bucket == k).alias(f"orders_at_{k}"), of("added").alias(f"added_at_{k}"), of("executed").alias(f"executed_at_{k}"), F.count_if((bucket == k) & (F.col("fills") > 0)).alias(f"filled_at_{k}")]
    g = life.groupBy(*DAY).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in ended], *lots,
        *[F.sum(c).alias(f"sh_{c}") for c in ("added", "executed", "cancelled")], F.count_if(seen).alias("observed"),
        *[F.count_if(v).alias(k) for k, v in (caps | longer).items()], F.count_if("readds").alias("readded"),
        F.sum("disagreements").alias("disagreements"), *parts,
    )
    left = F.col("sh_added") - F.col("sh_executed") - F.col("sh_cancelled")
    names = {"orders_added": F.col("n")} | {f"orders_{k}": F.col(f"n_{k}") for k in ended} | {f"share_{k}": ratio(f"n_{k}", "n") for k in ended}
    names |= {f"shares_{c}": F.col(f"sh_{c}") for c in ("added", "executed", "cancelled")} | {"shares_unresolved": left}
    add("ends", g, names)
    add("lifetime_naive", g, {f"share_{k}": ratio(k, "observed") for k in caps} | {k: ratio(k, "observed") for k in longer})
    add("lifetime_km", g, {"censored_share": ratio("n_censored", "n")})
    days = g.select(*DAY)
    for kind, some in (*((k, life.where(F.col("outcome") == k)) for k in ended[:2]), ("observed", life.where(seen))):
        named = {f"{kind}_p{round(q * 100)}_ms": floor_place(q) for q in ((0.1, 0.5, 0.9) if kind != "observed" else (0.5,))}
        picked = days.join(picks(some, [*DAY], "lifetime_ns", named), [*DAY], "left")
        add("lifetime_naive", picked, {k: F.col(k) / 1e6 for k in named})
    curve = kaplan_meier(durations(life))
    add("lifetime_km", days.join(km_median(curve), [*DAY], "left"), {"median_ms": F.col("median") / 1e6})
    times = F.explode(F.array(*[F.lit(t).cast("bigint") for t in SURVIVAL_TIMES.values()])).alias("t")
    at = survival_at(curve, days.select(*DAY, times)).groupBy(*DAY).agg(*[F.max(F.when(F.col("t") == t, F.col("survival"))).alias(k) for k, t in SURVIVAL_TIMES.items()])
    add("lifetime_km", at, {f"S_at_{k}": F.col(k) for k in SURVIVAL_TIMES})
    for k in DISTANCE_BUCKETS:
        rates = {"orders": F.col(f"orders_at_{k}"), "share_of_adds": ratio(f"orders_at_{k}", "n"), "fill_rate_shares": ratio(f"executed_at_{k}", f"added_at_{k}"), "fill_rate_orders": ratio(f"filled_at_{k}", f"orders_at_{k}")}
        add("fill_by_distance", g, {f"{k}_{c}": v for c, v in rates.items()})
    add("sizes", g, {f"adds_{k}_lot_share": ratio(f"lot_{k}", "n") for k in ("round", "odd", "mixed")} | {"add_size_mean": ratio("sh_added", "n")})
    add("sizes", picks(life, [*DAY], "added", {"v": floor_place(0.5)}), {"add_size_p50": F.col("v")})
    c = cancel_to_trade(messages)
    share = {"by_messages_full_day": "by_messages", "by_messages_midas_window": "by_messages_inside", "by_orders": "by_orders", "by_shares": "by_shares",
             "hidden_share_of_executions": "hidden_share", "odd_lot_share_of_executions": "odd_lot_share"}
    add("cancel_to_trade", c, {k: F.col(v) for k, v in share.items()})
    add("accounting", c, {"dark_ops": F.col("dark_ops"), "dark_shares": F.col("dark_shares"), "hidden_execs": F.col("hiddens")})
    add("accounting", g, {"size_disagreements": F.col("disagreements"), "readded_ids": F.col("readded")})
    return reduce(DataFrame.unionByName, out)
