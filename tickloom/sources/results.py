"""Result tables with their published columns, the universe file, and which tickers have results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exact import ratio
from tickloom.operators.book_stats import COUNTS, SUMS
from tickloom.operators.reports import verdict_word

#: Published columns of the result tables, in order.
RESULTS = {
    "bins": (
        "bin", "start_s", "start_hms", *SUMS, *COUNTS, "tw_spread_ticks", "tw_spread_cents", "tw_spread_bps", "tw_mid_ticks",
        "one_cent_share", "tw_touch_depth", "tw_depth5", "tw_depth10", "one_sided_share",
    ),
    "events": ("time_prev_ns", "time_ns", "e", "mid2_prev", "mid2"),
    "buckets": (
        "bucket", "start_ns", "start_hms", "end_ns", "duration_ns", "n_events", "n_updates", "ofi", "abs_flow", "mid2_open",
        "mid2_close", "dmid_cents", "dmid_bps",
    ),
    "lifecycle": ("section", "statistic", "value", "definition"),
    "survival": ("t_ns", "t_s", "S_km", "S_naive", "n_observed", "n_censored"),
    "decay": (
        "horizon_s", "direction", "split", "predictor", "n_fit", "n_test", "beta", "t_stat", "r2_oos", "hits", "both_nonzero",
        "excluded", "hit_rate", "z", "band", "clears_band", "edge_cents", "n_signals", "trial_id",
    ),
    "regimes": (
        "regime", "kind", "label", "horizon_s", "predictor", "n_fit", "n_test", "beta", "t_stat", "r2_oos", "hits",
        "both_nonzero", "excluded", "hit_rate", "z", "band", "verdict", "edge_cents", "n_signals", "trial_id",
    ),
    "cost": (
        "horizon_s", "subset", "latency", "threshold", "n_signals", "hits", "both_nonzero", "hit_rate", "gross_cents",
        "half_spread_cents", "net_one_leg", "net_two_legs", "beat_half_spread", "consumed", "beta_trial_id", "trial_id",
    ),
    "spectrum": (
        "ticker", "spread_cents", "spread_bps", "one_cent_share", "touch_depth", "updates_per_10s", "r2_contemporaneous_10s",
        "beta_contemporaneous", "hit_1s", "band_1s", "hit_5s", "band_5s", "r2_oos_5s", "gross_5s", "half_spread_5s", "consumed_5s",
    ),
    "taq": (
        "ticker", "permno", "decile", "price", "dollar_volume", "shares", "trades", "signed", "unsigned_share", "no_realized_share",
        "buy_share", "quoted_bps", "quoted_cents", "two_sided_share", "effective_bps", "effective_bps_dw", "realized_bps",
        "realized_bps_dw", "impact_bps", "impact_bps_dw",
    ),
    "universe": ("permno", "ticker", "close", "volume", "dollar_volume", "decile", "chosen"),
}

#: Published names of columns that the operators call otherwise.
_NAMES = {
    "bins": {"tw_mid_ticks": "tw_mid", "tw_touch_depth": "touch", "tw_depth5": "depth5", "tw_depth10": "depth10"},
    "events": {"time_prev_ns": "time_prev"},
    "survival": {"t_ns": "t", "S_km": "s_km", "S_naive": "s_naive"},
    "decay": {"horizon_s": "h", "t_stat": "t", "r2_oos": "r2", "both_nonzero": "graded", "edge_cents": "edge", "n_signals": "signals"},
    "regimes": {"horizon_s": "h", "t_stat": "t", "r2_oos": "r2", "both_nonzero": "graded", "edge_cents": "edge", "n_signals": "signals"},
    "cost": {
        "horizon_s": "h", "n_signals": "n", "both_nonzero": "graded", "gross_cents": "gross", "half_spread_cents": "half_spread",
        "net_one_leg": "net1", "net_two_legs": "net2", "beat_half_spread": "beat",
    },
}


#: Published words of a split's directions, and what they fit and test.
DIRECTIONS = {"forward": ("primary", "first-half/second-half"), "reverse": ("reversed", "second-half/first-half")}
#: Flow slopes are published a thousand shares.
KSH = 1_000


def _made(df: DataFrame, **made: tuple[Column, tuple[str, ...]]) -> DataFrame:
    """Columns made of others, where these are there."""
    return df.withColumns({name: value for name, (value, needed) in made.items() if set(needed) <= set(df.columns)})


def _word(i: int) -> Column:
    return F.coalesce(*[F.when(F.col("direction") == k, v[i]) for k, v in DIRECTIONS.items()])


_SLOPE = ("predictor", "beta")


def _slope() -> Column:
    return F.when(F.col("predictor") == "ofi", F.col("beta") * KSH).otherwise(F.col("beta"))


def _decay(df: DataFrame) -> DataFrame:
    return _made(df, split=(_word(1), ("direction",)), direction=(_word(0), ("direction",)), beta=(_slope(), _SLOPE))


def _regimes(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("regime").isin("high-vol", "quiet"), "decile").otherwise("window")
    return _made(df, kind=(kind, ("regime",)), verdict=(verdict_word(), ("hit_rate", "band")), beta=(_slope(), _SLOPE))


def _cost(df: DataFrame) -> DataFrame:
    return _made(df, hit_rate=(ratio("hits", "graded"), ("hits", "graded")))


def _survival(df: DataFrame) -> DataFrame:
    return _made(df, t_s=(F.format_string("%.6f", F.col("t") / 1e9), ("t",)))


#: Values that a table has otherwise than the operator's rows, by kind, and the operator's column by which such rows are known.
_VALUES = {"decay": (_decay, "h"), "regimes": (_regimes, "h"), "cost": (_cost, "h"), "survival": (_survival, "t")}


def published(df: DataFrame, kind: str) -> DataFrame:
    """The rows with the columns of a result table, in order, by their published names and with their published values.

    Rows come from the operators (decay, regimes, costs, survival_grid and so on) or have published names and values already. Columns that they lack
    are null: ids of trials are there when rows were logged (registry.logged).
    """
    if kind in _VALUES and _VALUES[kind][1] in df.columns:
        df = _VALUES[kind][0](df)
    own, there = _NAMES.get(kind, {}), set(df.columns)

    def column(c: str):
        name = c if c in there else own.get(c, c)
        return F.col(f"`{name}`").alias(c) if name in there else F.lit(None).cast("string").alias(c)

    return df.select(*map(column, RESULTS[kind]))


#: Types of published columns that are not numbers of type double.
_WHOLE = (
    "bin", "start_s", *SUMS, *COUNTS, "time_prev_ns", "time_ns", "e", "mid2_prev", "mid2", "bucket", "start_ns", "end_ns", "duration_ns", "n_events",
    "n_updates", "ofi", "abs_flow", "mid2_open", "mid2_close", "t_ns", "n_observed", "n_censored", "n_fit", "n_test", "hits", "both_nonzero", "excluded",
    "n_signals", "trial_id", "beta_trial_id", "latency", "permno", "decile", "shares", "trades", "signed",
)
_TEXTS = ("start_hms", "section", "statistic", "definition", "direction", "split", "predictor", "regime", "kind", "label", "verdict", "subset", "ticker")


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A result table with typed columns: whole numbers as decimal(38,0) where they are sums and as bigint elsewhere, truth values as boolean.

    Empty cells are null, and cells that are no number of their type are too. Files of a ticker each (`.._TICKER..csv`) are read one at a time.
    """
    rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in RESULTS[kind]), enforceSchema=False)

    def typed(c: str) -> Column:
        if c in _TEXTS:
            return F.col(c)
        if c in ("clears_band", "chosen"):
            return F.lower(c).try_cast("boolean").alias(c)
        return F.col(c).try_cast("decimal(38,0)" if c in SUMS else "bigint" if c in _WHOLE else "double").alias(c)

    return rows.select(*map(typed, RESULTS[kind]))


def write_result(df: DataFrame, kind: str, path: str) -> None:
    """A result table as CSV files with header, absent values empty; an earlier one of that path is replaced."""
    published(df, kind).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The universe file: empty cells are null, `chosen` is true for True alone."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in RESULTS["universe"]))
    number = lambda c, kind: F.col(c).try_cast(kind).alias(c)
    sizes = [number(c, "double") for c in ("close", "volume", "dollar_volume")]
    chosen = F.coalesce(F.lower("chosen") == "true", F.lit(False)).alias("chosen")
    return rows.select(number("permno", "bigint"), "ticker", *sizes, number("decile", "int"), chosen)


def tickers_with(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(ticker) of the files below `path` whose names match a regular expression with one group, in order; file names alone are read.

    Names of files or of folders: Spark writes a table as a folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = F.regexp_extract("path", rf"/{pattern}(?:/|$)", 1).alias("ticker")
    return files.select(found).where("ticker != ''").distinct().orderBy("ticker")
