"""One-regressor forecasts of the next bucket's mid change, out of sample, and what trading them would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, ratio
from tickloom.functions.ranks import nearest_place, nearest_rank, picks

SECOND = 1_000_000_000
SPLIT_NS = 45_900 * SECOND
VAR_WINDOW = 6
DECILE = 0.1
#: Name, start and end in seconds of the day.
WINDOWS = (("open", 34_200, 36_000), ("midday", 39_600, 50_400), ("close", 55_800, 57_600))


def pairs(buckets: DataFrame, spreads: DataFrame | None = None, var_window: int = VAR_WINDOW, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Each bucket with the next: time_ns, target_end_ns, x (flow), last, y (changes in cents), half_spread, var.

    `spreads` has (keys, bucket, spread in cents, null where never two-sided). A bucket or next bucket without a mid makes no pair;
    buckets that share no edge fail the query; `var` is null until `var_window` buckets with mids are there.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    trail = order.rowsBetween(1 - var_window, 0)
    b = buckets.select(*keys, "bucket", "start_ns", "end_ns", "ofi", "dmid_cents")
    b = b.join(spreads.select(*keys, "bucket", (F.col("spread") / 2).alias("half_spread")), [*keys, "bucket"], "left") if spreads is not None else b.withColumn("half_spread", F.lit(None).cast("double"))
    b = b.withColumn("next", F.lead(F.struct("start_ns", "end_ns", "dmid_cents")).over(order)).withColumn("var", F.when(F.count("dmid_cents").over(trail) == var_window, F.sum(F.col("dmid_cents") * F.col("dmid_cents")).over(trail)))
    edge = F.when(F.col("next.start_ns") != F.col("end_ns"), F.raise_error(F.lit("buckets do not share an edge"))).otherwise(F.lit(True))
    return b.where("next IS NOT NULL").where(edge).where("dmid_cents IS NOT NULL AND next.dmid_cents IS NOT NULL").select(
        *keys, F.col("end_ns").alias("time_ns"), F.col("next.end_ns").alias("target_end_ns"), F.col("ofi").cast("double").alias("x"), F.col("dmid_cents").alias("last"), F.col("next.dmid_cents").alias("y"), "half_spread", "var")


def first_half(split_ns: int = SPLIT_NS) -> Column:
    return F.col("target_end_ns") <= split_ns


def second_half(split_ns: int = SPLIT_NS) -> Column:
    return F.col("time_ns") >= split_ns


def split(p: DataFrame, split_ns: int = SPLIT_NS, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(fit, test); pairs that straddle the split are in neither."""
    a, b = p.where(first_half(split_ns)), p.where(second_half(split_ns))
    return (b, a) if reverse else (a, b)


def stacked(p: DataFrame) -> DataFrame:
    """One row a pair and predictor: `predictor` and its value `r`."""
    return p.withColumn("s", F.explode(F.array(F.struct(F.lit("ofi").alias("predictor"), F.col("x").alias("r")), F.struct(F.lit("last").alias("predictor"), F.col("last").alias("r"))))).select("*", "s.predictor", "s.r").drop("s")


def fit_origin(rows: DataFrame, keys: list[str], x: str = "r", y: str = "y") -> DataFrame:
    """Slope through the origin and its t value by group: n_fit, beta, t. Null with fewer than two rows or x all zero."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n_fit"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    beta = F.when((F.col("n_fit") >= 2) & (F.col("sxx") > 0), F.col("sxy") / F.when(F.col("sxx") > 0, F.col("sxx")))
    s = s.withColumn("beta", beta).withColumn("se2", (F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("n_fit") - 1) / F.when(F.col("sxx") > 0, F.col("sxx")))
    return s.select(*keys, "n_fit", "beta", F.when(F.col("se2") > 0, F.col("beta") / F.sqrt("se2")).alias("t"))


def evaluate(fit: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Stacked fit and test rows to one forecast a group: fit, R2 against a zero forecast, hits, edge and the hit rate's band.

    The fits, one row a group, are joined back by key.
    """
    f = fit_origin(fit, keys)
    beta, r, y = F.col("beta"), F.col("r"), F.col("y")
    way = F.signum(beta * r)
    signal, both = (r != 0) & (beta != 0), (r != 0) & (beta != 0) & (y != 0)
    joined = test.join(f, keys, "right")
    here = y.isNotNull()
    g = joined.groupBy(*keys, "n_fit", "beta", "t").agg(
        F.count_if(here).alias("n_test"), F.sum((y - beta * r) * (y - beta * r)).alias("sse"), F.sum(y * y).alias("sst"), F.count_if(here & both).alias("graded"), F.count_if(here & both & (way == F.signum(y))).alias("hits"), F.count_if(here & signal).alias("signals"), F.sum(F.when(signal, way * y)).alias("edge_sum"),
    )
    known = lambda c: F.when(beta.isNotNull(), c)
    hit = ratio("hits", "graded")
    half = F.sqrt(F.lit(0.25) / F.when(F.col("graded") > 0, F.col("graded")))
    return g.select(*keys, "n_fit", "n_test", "beta", "t", known(1 - ratio("sse", "sst")).alias("r2"), F.when(beta.isNull(), 0).otherwise(F.col("hits")).alias("hits"), F.when(beta.isNull(), 0).otherwise(F.col("graded")).alias("graded"), (F.col("n_test") - F.when(beta.isNull(), 0).otherwise(F.col("graded"))).alias("excluded"),
                    known(ratio("edge_sum", "signals")).alias("edge"), F.when(beta.isNull(), 0).otherwise(F.col("signals")).alias("signals"), hit.alias("hit_rate"), ((hit - 0.5) / half).alias("z"), (half * 1.96).alias("band"), (hit - 0.5 > half * 1.96).alias("clears_band"))


def decay(p: DataFrame, keys: list[str], split_ns: int = SPLIT_NS) -> DataFrame:
    """Forecasts of every group, both directions of the split and both predictors."""
    s = stacked(p).withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("reverse"))))
    forward = F.col("direction") == "forward"
    fit = s.where((forward & first_half(split_ns)) | (~forward & second_half(split_ns)))
    test = s.where((forward & second_half(split_ns)) | (~forward & first_half(split_ns)))
    return evaluate(fit, test, [*keys, "direction", "predictor"])


def short(x: Column) -> Column:
    """A number with four significant digits, without trailing zeros; with an exponent where that is below -4 or above 3."""
    shown = F.format_string("%.3e", x)
    power = F.substring_index(shown, "e", -1).cast("int")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = bare(shown.cast("decimal(30,12)").cast("string"))
    return F.when(power.between(-4, 3), plain).otherwise(F.concat(bare(F.substring_index(shown, "e", 1)), F.lit("e"), F.substring_index(shown, "e", -1)))


def regime_members(p: DataFrame, keys: list[str], split_ns: int = SPLIT_NS, windows=WINDOWS, decile: float = DECILE) -> DataFrame:
    """Pairs with a row for each regime, its label and whether the pair is in it: three windows of the day, and the top and bottom decile of trailing variance.

    The deciles' cuts are nearest ranks among first-half pairs; a group without such pairs has no decile regimes.
    """
    width = F.col("target_end_ns") - F.col("time_ns")
    clock = lambda t: f"{t // 3600:02d}:{t % 3600 // 60:02d}"
    regime = lambda name, label, member: F.struct(name.alias("regime"), label.alias("label"), member.alias("member"))
    within = lambda a, z: (F.col("time_ns") - width >= a * SECOND) & (F.col("time_ns") <= z * SECOND)
    inside = [regime(F.lit(n), F.lit(f"{clock(a)}-{clock(z)}"), within(a, z)) for n, a, z in windows]
    first = p.where(first_half(split_ns))
    cuts = picks(first, keys, "var", {"hi": nearest_place(1 - decile), "lo": nearest_place(decile)})
    rows = p.join(cuts, keys, "left")
    member = lambda c: F.coalesce(c, F.lit(False))
    words = lambda sign, c, end: F.concat(F.lit(f"trailing variance {sign} "), short(F.col(c)), F.lit(f" ({end} decile, first-half cut)"))
    by_var = [
        regime(F.when(F.col("hi").isNotNull(), F.lit("high-vol")), words(">=", "hi", "top"), member(F.col("var") >= F.col("hi"))),
        regime(F.when(F.col("hi").isNotNull(), F.lit("quiet")), words("<=", "lo", "bottom"), member(F.col("var") <= F.col("lo"))),
    ]
    return rows.withColumn("g", F.explode(F.array(*inside, *by_var))).select("*", "g.regime", "g.label", "g.member").drop("g", "hi", "lo").where("regime IS NOT NULL")


def regimes(p: DataFrame, keys: list[str], split_ns: int = SPLIT_NS, windows=WINDOWS) -> DataFrame:
    """Fit outside each regime, test inside it."""
    s = stacked(regime_members(p, keys, split_ns, windows))
    return evaluate(s.where(~F.col("member")), s.where("member"), [*keys, "regime", "label", "predictor"])


def cost_verdict(fit: DataFrame, test: DataFrame, betas: DataFrame, keys: list[str], subset: str = "all", latency: int = 0, decile: float = DECILE) -> DataFrame:
    """Trade each test signal in the fitted direction for a bucket, entering `latency` buckets later, against the half-spread.

    `betas` has (keys, beta). For 'top-decile' the cut on the signal's size is a nearest rank among non-zero fit signals; a
    signal whose entry bucket is missing among the test pairs is skipped. A group whose slope is known and not 0 has a row, with n = 0 where
    nothing signals.
    """
    order = Window.partitionBy(*keys).orderBy("time_ns")
    entry = F.struct("time_ns", "y", "half_spread")
    rows = test.withColumn("q", F.lead(entry, latency).over(order) if latency else entry)
    rows = rows.withColumn("_width", F.first(F.col("target_end_ns") - F.col("time_ns")).over(order)).join(betas.select(*keys, "beta"), keys)
    cut = betas.where("beta != 0").select(*keys)
    if subset == "top-decile":
        large = fit.where("x != 0").withColumn("size", F.abs("x"))
        cut = cut.join(nearest_rank(large, keys, "size", 1 - decile, "threshold"), keys, "left")
        rows = rows.join(cut, keys).where(F.abs("x") >= F.col("threshold")).drop("threshold")
    else:
        cut = cut.withColumn("threshold", F.lit(None).cast("double"))
    rows = rows.where("x != 0 AND beta != 0").where(F.col("q.time_ns") == F.col("time_ns") + latency * F.col("_width"))
    move, hs = F.signum(F.col("beta") * F.col("x")) * F.col("q.y"), F.col("q.half_spread")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if((F.col("q.y") != 0) & (move > 0)).alias("hits"), F.count_if(F.col("q.y") != 0).alias("graded"), F.avg(move).alias("gross"), F.avg(hs).alias("half_spread"), F.avg(move - hs).alias("net1"), F.avg(move - 2 * hs).alias("net2"), F.avg(F.when(hs.isNotNull(), (move > hs).cast("double"))).alias("beat"))
    g = cut.join(g, keys, "left").fillna(0, ["n", "hits", "graded"]).withColumn("consumed", F.when(F.col("gross") > 0, F.col("half_spread") / F.col("gross")))
    return g.withColumn("subset", F.lit(subset)).withColumn("latency", F.lit(latency))


def costs(p: DataFrame, keys: list[str], split_ns: int = SPLIT_NS) -> DataFrame:
    """Verdicts for both subsets and latencies, with slopes of flow fitted on the first half."""
    fit, test = split(p, split_ns)
    betas = fit_origin(fit, keys, "x")
    out = [cost_verdict(fit, test, betas, keys, s, latency) for s in ("all", "top-decile") for latency in (0, 1)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
