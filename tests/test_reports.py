"""Hand-computed cases of the report operators and of small sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import forecast as fc
from tickloom.operators import replay as rp
from tickloom.operators import reports as rr
from tickloom.operators.book_stats import COUNTS
from tickloom.sources import itch, results, text_feeds
from tests.test_goldens import LEVELS, S


def test_close_checks(spark):
    names = "symbol int, day bigint, order_id bigint, life_no bigint, direction int, price bigint, delta bigint"
    clean = [(0, 0, 1, 1, 1, 100, 10), (0, 0, 1, 1, 1, 100, -4), (0, 0, 2, 1, 1, 100, 5), (0, 0, 3, 1, -1, 103, 7), (0, 0, 4, 1, -1, 101, 7), (0, 0, 4, 1, -1, 101, -7)]
    r = rr.close_report(spark.createDataFrame(clean, names)).first()
    assert (r["live_orders"], r["levels"], r["bid"], r["ask"], r["spread"], r["uncrossed"], r["positive"], r["reconciled"]) == (3, 2, 100, 103, 3, True, True, True)
    bad = [(0, 0, 1, 1, 1, 100, 10), (0, 0, 2, 1, -1, 99, -3), (0, 0, 3, 1, -1, 98, 5), (0, 0, 4, 1, -1, 98, -5)]
    r = rr.close_report(spark.createDataFrame(bad, names)).first()
    assert (r["uncrossed"], r["positive"], r["reconciled"]) == (False, False, False)


def test_market_wide_comparison(spark):
    counts = dict.fromkeys(COUNTS, 0) | {"ticker": "A", "cancels": 30, "trades": 10, "hidden": 10, "odd_lot_trades": 5, "trade_shares": 300, "add_shares": 1000}
    fields = {"Cancels": 60.0, "LitTrades": 12.0, "Hidden": 4.0, "TradesForHidden": 100.0, "OddLots": 50.0, "TradesForOddLots": 100.0, "LitVol('000)": 1000.0, "OrderVol('000)": None}
    records = spark.createDataFrame([("A", fields)], "ticker string, fields map<string,double>")
    out = {r["statistic"]: r for r in rr.activity_comparison(spark.createDataFrame([counts]), records).collect()}
    assert (out["cancel_to_trade"]["ours"], out["cancel_to_trade"]["theirs"], out["cancel_to_trade"]["as_expected"]) == (3, 5, True)
    assert out["hidden_rate"]["as_expected"] is False and out["odd_lot_rate"]["ratio"] == 0.5 and out["odd_lot_rate"]["as_expected"]
    assert out["trade_to_order_volume"]["theirs"] is None and out["trade_to_order_volume"]["as_expected"] is None
    assert out["lit_volume"]["as_expected"] and out["lit_trades"]["as_expected"] is False and out["cancels"]["as_expected"]


def test_buckets_verdicts_and_horizons(spark):
    one = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 2, 6), (0, 0, 2, 6)], "symbol int, day int, bucket int, ofi int")
    r = rr.same_buckets(one, one.where("bucket = 2").unionByName(one.where("bucket = 1").withColumn("ofi", F.lit(9))), ["symbol", "day"]).first()
    assert (r["buckets"], r["only_first"], r["only_second"]) == (3, 1, 1)
    words = spark.createDataFrame([(0.7, 0.1), (0.3, 0.1), (0.55, 0.1), (None, None)], "hit_rate double, band double").select(rr.verdict_word())
    assert [r[0] for r in words.collect()] == ["above", "below", "inside", "no call"]
    decay = spark.createDataFrame([(h, d, "ofi", 0.7, 0.1, ok) for h, d, ok in ((1, "forward", True), (5, "forward", True), (10, "forward", False), (10, "reverse", True))], "h int, direction string, predictor string, hit_rate double, band double, clears_band boolean")
    costs = spark.createDataFrame([(0, 0, h, s, lat, g, 0.5, 1.0) for h, s, lat, g in ((1, "all", 0, 0.2), (5, "all", 0, 0.3), (10, "all", 0, 0.9), (1, "top-decile", 0, 2.0), (5, "all", 1, 3.0))], "symbol int, day int, h int, subset string, latency int, gross double, half_spread double, consumed double")
    best = rr.best_horizon(decay, costs, ["symbol", "day"]).first()
    assert (best["h"], best["gross"]) == (5, 0.3)


def test_spread_table_by_decile(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ticker,decile,effective_bps,dollar_volume\nB,1,8,100\nA,1,4,300\nC,1,2,\nD,,5,1\nE,2,,1\n")
    r = rr.decile_members(rr.read_spreads(spark, f"file://{tmp_path}/s.csv")).collect()
    assert [(x["decile"], x["names"], x["q1"], x["median"], x["q3"], x["least"], x["most"], x["median_dollar_volume"], x["tickers"]) for x in r] == [(1, 3, 1.5, 2, 3, 1, 4, 200, "A, B, C")]


def test_summary_of_a_name(spark, tmp_path):
    kind = "trial_id bigint, script string, ticker string, clock string, bucket string, metric string, `window` string, value string, note string"
    row = lambda i, value, note, **other: tuple(({"trial_id": i, "script": "ofi_first_look.py", "ticker": "A", "clock": "calendar", "bucket": "10", "metric": "r2", "window": "09:30-16:00", "value": value, "note": note} | other).values())
    fits = rr.contemporaneous(spark.createDataFrame([row(1, "0.1", "beta0=9"), row(2, "0.25", "n=4 beta0=-1.5e-3 x"), row(3, "0.9", "beta0=7", bucket="60")], kind))
    assert tuple(fits.first()) == ("A", 0.25, -0.0015)
    bins = spark.createDataFrame([("A", 10, 1000, 400_000, 5, 50), ("A", 10, 3000, 400_000, 0, 150), ("B", 0, 0, 0, 0, 0)], "ticker string, two_sided_ns bigint, spread_x_ns bigint, mid2_x_ns bigint, one_cent_ns bigint, touch_x_ns bigint")
    calendar = spark.createDataFrame([("A", 4), ("A", 8)], "ticker string, n_updates bigint")
    row = lambda h, direction, hit, band, r2: (h, direction, "", "ofi", 9, 9, 1.0, 1.0, r2, 1, 1, 0, hit, 0.1, band, True, 0.1, 3, 7)
    published = lambda rows, kind: spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(results.RESULTS[kind], kinds[kind])))
    kinds = {"decay": "double string string string int int double double double int int int double double double boolean double int int".split(), "cost": "double string int double int int int double double double double double double double int int".split()}
    decay = published([row(1.0, "primary", 0.6, 0.1, 0.2), row(5.0, "primary", 0.7, 0.2, 0.3), row(5.0, "reversed", 0.1, 0.1, 0.1)], "decay")
    cell = lambda latency, gross, half, consumed: (5.0, "all", latency, None, 3, 1, 2, 0.5, gross, half, 0.1, 0.1, 0.1, consumed, 1, 2)
    costs = published([cell(0, 0.4, 0.8, 2.0), cell(1, 9.0, 9.0, 9.0)], "cost")
    of = lambda df: df.withColumn("ticker", F.lit("A"))
    results.write_result(decay, "decay", f"file://{tmp_path}/d")
    results.write_result(costs, "cost", f"file://{tmp_path}/c")
    read = [results.read_result(spark, f"file://{tmp_path}/{k[0]}", k) for k in ("decay", "cost")]
    for a, b in ((decay, costs), read):
        out = {r["ticker"]: r.asDict() for r in rr.summarize_names(bins, calendar, of(a), of(b), fits).collect()}
        assert out["A"] == {"ticker": "A", "spread_cents": 2.0, "spread_bps": 100.0, "one_cent_share": 0.25, "touch_depth": 10.0, "updates_per_10s": 6.0, "r2_contemporaneous_10s": 0.25, "beta_contemporaneous": -0.0015, "hit_1s": 0.6, "band_1s": 0.1, "hit_5s": 0.7, "band_5s": 0.2, "r2_oos_5s": 0.3, "gross_5s": 0.4, "half_spread_5s": 0.8, "consumed_5s": 2.0}
    assert set(results.RESULTS["spectrum"]) == set(out["A"])
    assert out["B"]["spread_cents"] is None and out["B"]["updates_per_10s"] is None


def test_caches_clocks_and_missing_values(spark, tmp_path):
    (tmp_path / "q.csv").write_text("time_ns,bid,ask\n1,10.5,10.75\n2,,11\n3,1,2\n")
    (tmp_path / "t.csv").write_text("time_ns,price,size\n1,10.5,100.0\n2,3,\n")
    assert [tuple(r) for r in text_feeds.read_quotes(spark, f"file://{tmp_path}/q.csv").collect()] == [(1, 10.5, 10.75), (3, 1, 2)]
    assert [tuple(r) for r in text_feeds.read_trades(spark, f"file://{tmp_path}/t.csv").collect()] == [(1, 10.5, 100)]
    values = spark.createDataFrame([("09:30:00.000001",), ("16:00:00",), ("NaN",), (None,), (" na ",)], "t string")
    ns = [r[0] for r in values.where("t LIKE '%:%'").select(text_feeds.clock_to_ns(F.col("t"))).collect()]
    assert ns == [34_200_000_001_000, 57_600_000_000_000]
    assert [r[0] for r in values.select(text_feeds.missing(F.col("t"))).collect()] == [False, False, True, True, True]


def test_feed_description_and_mismatch_text(spark, tmp_path):
    day = [{"kind": "S", "time_ns": 1, "event_code": "O", "stock_locate": 0}, {"kind": "A", "time_ns": 3, "order_ref": 7, "side": "B", "shares": 100, "price": 10000, "stock": "ABC"}, {"kind": "D", "time_ns": 9, "order_ref": 7}, {"kind": "Z", "time_ns": 6, "stock_locate": 9}]
    (tmp_path / "feed").write_bytes(itch.encode(day))
    d = {r["kind"]: r for r in itch.describe_itch(itch.read_itch(spark, str(tmp_path / "feed"))).collect()}
    assert d["S"]["first_ns"] is None and (d["A"]["messages"], d["A"]["first_ns"], d["D"]["last_ns"], d["Z"]["not_decoded"]) == (1, 3, 9, 1)
    rows = lambda size: spark.createDataFrame([(0, 0, i, i, [(101, 5)], [(100, s)]) for i, s in enumerate((7, size))], f"symbol int, day bigint, seq bigint, time_ns bigint, asks {LEVELS}, bids {LEVELS}")
    ours, reference = rows(8), rows(7)
    shown = rp.mismatches(rp.graded_rows(ours, reference, 5), ours, reference).collect()
    assert [(r["seq"], r["ours"], r["reference"]) for r in shown] == [(1, "100 x 8 | 101 x 5", "100 x 7 | 101 x 5")]


def test_published_values(spark, tmp_path):
    forecast = "h int, direction string, predictor string, n_fit bigint, n_test bigint, beta double, t double, r2 double, hits bigint, graded bigint, excluded bigint, edge double, signals bigint, hit_rate double, z double, band double, clears_band boolean"
    tail = (0.25, 6, 10, 2, 0.5, 11, 0.6, 1.5, 0.05, True)
    rows = [(1, "forward", "ofi", 20, 12, 0.004, 2.5, *tail), (1, "reverse", "last", 20, 12, -0.5, 2.5, *tail)]
    results.write_result(spark.createDataFrame(rows, forecast), "decay", f"file://{tmp_path}/decay")
    back = sorted(map(tuple, results.read_result(spark, f"file://{tmp_path}/decay", "decay").collect()), key=repr)
    assert back == [(1.0, "primary", "first-half/second-half", "ofi", 20, 12, 4.0, 2.5, 0.25, 6, 10, 2, 0.6, 1.5, 0.05, True, 0.5, 11, None), (1.0, "reversed", "second-half/first-half", "last", 20, 12, -0.5, 2.5, 0.25, 6, 10, 2, 0.6, 1.5, 0.05, True, 0.5, 11, None)]
    pairs = [(0, 0, t * S, (t + 1) * S, float(x), 1.0, float(x), 0.5, v) for t, x, v in ((36_000, 3, 0.00123456), (36_001, -2, 12.5), (45_900, 4, 99_999.6), (45_901, 0, None), (45_902, -1, 7.0))]
    p = spark.createDataFrame(pairs, "symbol int, day bigint, time_ns bigint, target_end_ns bigint, x double, last double, y double, half_spread double, var double").withColumn("h", F.lit(1))
    r = {(x["regime"], x["predictor"]): x for x in results.published(fc.regimes(p, ["h"]), "regimes").collect()}
    assert r["open", "ofi"]["label"] == "09:30-10:00" and {x["kind"] for x in r.values()} == {"window", "decile"}
    assert r["high-vol", "ofi"]["label"] == "trailing variance >= 12.5 (top decile, first-half cut)" and r["quiet", "ofi"]["label"] == "trailing variance <= 0.001235 (bottom decile, first-half cut)"
    assert r["quiet", "ofi"]["beta"] > 900 and r["quiet", "last"]["beta"] < 10 and {x["verdict"] for x in r.values()} <= {"above", "below", "inside", "no call"}
    values = spark.createDataFrame([(x,) for x in (0.0, 1.0, 12.5, 123456.0, 0.00001234567, 99_999.6, 9999.4, 0.0001, 250.0)], "x double")
    assert [y[0] for y in values.select(fc.short(F.col("x"))).collect()] == [f"{x:.4g}" for (x,) in values.collect()]
    c = {(x["subset"], x["latency"]): x for x in results.published(fc.costs(p, ["symbol", "day", "h"]), "cost").collect()}
    assert (c["all", 0]["n_signals"], c["all", 0]["hit_rate"], c["all", 0]["threshold"]) == (2, 1.0, None) and c["top-decile", 0]["threshold"] == 3
    still = fc.costs(p.withColumn("x", F.when(F.col("time_ns") < 45_900 * S, F.col("x")).otherwise(0.0)), ["symbol", "day", "h"]).collect()
    assert len(still) == 4 and {(x["n"], x["hits"], x["gross"]) for x in still} == {(0, 0, None)}


def test_result_tables_and_discovery(spark, tmp_path):
    decay = spark.createDataFrame([(1, "forward", "ofi", 0.5, 3)], "h int, direction string, predictor string, r2 double, graded int")
    results.write_result(decay, "decay", f"file://{tmp_path}/ofi_decay_AAA.csv")
    results.write_result(decay, "decay", f"file://{tmp_path}/ofi_decay_B.csv")
    back = spark.read.csv(f"file://{tmp_path}/ofi_decay_B.csv", header=True)
    assert tuple(back.columns) == results.RESULTS["decay"]
    assert [back.first()[c] for c in ("horizon_s", "r2_oos", "both_nonzero", "trial_id")] == ["1", "0.5", "3", None]
    assert [r[0] for r in results.tickers_with(spark, f"file://{tmp_path}", "ofi_decay_([^/]+)[.]csv").collect()] == ["AAA", "B"]
    universe = spark.createDataFrame([(7, "X", 1.5, None, 3.0, 2, True), (8, "Y", None, 1.0, None, None, False)], "permno bigint, ticker string, close double, volume double, dollar_volume double, decile int, chosen boolean")
    results.write_result(universe, "universe", f"file://{tmp_path}/universe")
    assert sorted(map(tuple, results.read_universe(spark, f"file://{tmp_path}/universe").collect())) == sorted(map(tuple, universe.collect()))
