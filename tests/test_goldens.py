"""Hand-computed cases of the operators."""

from __future__ import annotations

import gzip
import threading

import pytest
from pyspark.sql import functions as F

from tickloom.functions.exact import millionths
from tickloom.functions.ranks import floor_pick, nearest_rank
from tickloom.operators import book_scan as scan
from tickloom.operators import book_stats as bs
from tickloom.operators import cross_section as cs
from tickloom.operators import forecast as fc
from tickloom.operators import lifecycle as lc
from tickloom.operators import order_flow as of
from tickloom.operators import replay as rp
from tickloom.operators import tape as tp
from tickloom.operators.registry import count_trials, decay_trial, log_trials, logged, read_trials
from tickloom.plans.queries import QUERIES
from tickloom.sources import itch, results, text_feeds
from tickloom.sources.shared import delete, shared_path
from tickloom.streaming import stateful

S = 1_000_000_000
LEVELS = "array<struct<price:bigint,size:bigint>>"


def book(spark, rows):
    return spark.createDataFrame([(0, 0, i, int(t * S), a, b) for i, (t, a, b) in enumerate(rows)], f"symbol int, day bigint, seq bigint, time_ns bigint, asks {LEVELS}, bids {LEVELS}")


def test_text_feed(spark, tmp_path):
    (tmp_path / "X_2012-06-21_34200000_57600000_message_1.csv").write_text("34200.004241176,1,11885113,21,2238100,1\n34200.025552,3,11885113,21,2238100,1\n")
    (tmp_path / "X_2012-06-21_34200000_57600000_orderbook_2.csv").write_text("2239500,100,2238100,21,9999999999,0,-9999999999,0\n2239500,100,2238100,21,2239600,5,2238000,7\n")
    m = text_feeds.read_messages(spark, f"{tmp_path}/*message*").orderBy("seq").collect()
    assert [r["time_ns"] for r in m] == [34200004241176, 34200025552000] and m[0]["symbol"] == "X" and m[0]["day"] == "2012-06-21"
    b = text_feeds.read_book(spark, f"{tmp_path}/*orderbook*", 2).orderBy("seq")
    rows = b.collect()
    assert [tuple(x) for x in rows[0]["asks"]] == [(2239500, 100)] and [tuple(x) for x in rows[1]["bids"]] == [(2238100, 21), (2238000, 7)]
    assert text_feeds.padded_rows(b, 2).orderBy("seq").first()["value"] == "2239500,100,2238100,21,9999999999,0,-9999999999,0"
    d = text_feeds.describe(text_feeds.read_messages(spark, f"{tmp_path}/*message*"), b).first()
    assert d["aligned"] and d["type_1"] == 1 and d["orders"] == 1
    (tmp_path / "bad_message.csv").write_text("1,9,1,1,1,1\n")
    with pytest.raises(Exception, match="not a message"):
        text_feeds.read_messages(spark, f"{tmp_path}/bad_message.csv").collect()


def test_activity_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date|Ticker|LitVol('000)|Cancels\n20120621|aapl|6,539.038|933448\n21 June 2012|msft|1|2\n")
    (tmp_path / "b.txt").write_text("Date,Ticker,LitVol('000),Cancels\n6/21/2012,MSFT,NA,7\n")
    (tmp_path / "c.csv").write_text("no,header\n1,2\n")
    (tmp_path / "d.csv").write_text('\ufeffDATE,"ticker",Cancels,Hidden\n2012-06-21 00:00,IBM,"1,234",5,extra\n2012-06-21,ge\n')
    out = {r["ticker"]: r["fields"] for r in text_feeds.read_activity(spark, str(tmp_path), "2012-06-21").collect()}
    assert round(out["AAPL"]["LitVol('000)"]) == 6539038 and out["AAPL"]["Cancels"] == 933448 and out["MSFT"]["LitVol('000)"] is None
    assert (out["IBM"]["Cancels"], out["IBM"]["Hidden"]) == (1234, 5) and out["GE"]["Cancels"] is None and len(out) == 4
    assert text_feeds.read_activity(spark, str(tmp_path / "c.csv"), "2012-06-21").count() == 0
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "a.csv").write_text("Ticker,Date,Cancels,Hidden,Cancels,,\nx,20120621,1,2,3,4,5\ny,20120621,1,2\nz\nw,20120621,1,2,3,4,5,6,7\n")
    (odd / "b.csv").write_text("\nTicker,Date\n")
    (odd / "d.csv").write_text("Ticker|Date|Other('000)|LitVol('000)|Other('000)\nv|20120621|7|7|8\n")
    out = {r["ticker"]: r["fields"] for r in text_feeds.read_activity(spark, str(odd), "2012-06-21").collect()}
    assert {k: (v["Cancels"], v["Hidden"]) for k, v in out.items() if k != "V"} == {"X": (3, 2), "Y": (None, 2), "W": (3, 2)}
    assert (out["V"]["LitVol('000)"], out["V"]["Other('000)"]) == (7000, 8) and "" not in out["X"]
    dates = ["20120621", "2012-06-21", "6/1/2012", "21 June 2012", ""]
    shown = spark.createDataFrame([(d,) for d in dates], "t string").select(text_feeds.iso_date(F.col("t")).alias("d"))
    assert [r["d"] for r in shown.collect()] == ["2012-06-21", "2012-06-21", "2012-06-01", None, None]


def test_binary_feed(spark, tmp_path):
    day = [{"kind": "R", "time_ns": 1, "stock": "ABC"}, {"kind": "S", "time_ns": 2, "event_code": "O", "stock_locate": 0}, {"kind": "A", "time_ns": 3, "order_ref": 7, "side": "B", "shares": 100, "price": 10000, "stock": "ABC"}, {"kind": "U", "time_ns": 4, "order_ref": 7, "new_order_ref": 8, "shares": 50, "price": 10010}, {"kind": "E", "time_ns": 5, "order_ref": 8, "shares": 50}, {"kind": "Z", "time_ns": 6, "stock_locate": 9}]
    (tmp_path / "day.gz").write_bytes(gzip.compress(itch.encode(day)))
    feed = itch.read_itch(spark, str(tmp_path / "day.gz"))
    rows = feed.orderBy("seq").collect()
    assert [r["kind"] for r in rows] == list("RSAUEZ") and rows[2]["side"] == "B" and rows[3]["new_order_ref"] == 8 and not rows[5]["decoded"]
    assert itch.for_symbols(feed, ["ABC"]).count() == 5 and itch.read_itch(spark, str(tmp_path / "day.gz"), 2).count() == 2
    stats = rp.replay_stats(scan.replay_feed(itch.as_feed(itch.for_symbols(feed, ["ABC"])))).where("symbol = 1").first()
    assert stats["clean"] and stats["applied"] == 3 and stats["full_fill"] == 1 and stats["day"] == "day.gz"
    (tmp_path / "next.gz").write_bytes((tmp_path / "day.gz").read_bytes())
    two = rp.replay_stats(scan.replay_feed(itch.as_feed(feed.union(itch.read_itch(spark, str(tmp_path / "next.gz")))))).where("symbol = 1").collect()
    assert sorted((r["day"], r["applied"]) for r in two) == [("day.gz", 3), ("next.gz", 3)]
    (tmp_path / "cut").write_bytes(itch.encode(day)[:-3])
    with pytest.raises(Exception, match="cut off"):
        itch.read_itch(spark, str(tmp_path / "cut")).collect()


def test_binary_feed_of_all_symbols(spark, tmp_path):
    rows = [(s, day, 10 * i + s, "X" if i % 3 else "A", 86_399_999_999_990 + i, i, None if i % 3 else "S", 1 + i, None if i % 3 else 10_000 + i, None if i % 3 else "AB") for s in (1, 2, 300) for day in (0, 19_700) for i in range(7)]
    feed = spark.createDataFrame(rows, "stock_locate int, day bigint, seq bigint, kind string, time_ns bigint, order_ref bigint, side string, shares bigint, price bigint, stock string")
    files = itch.write_itch(feed, f"file://{tmp_path}/feed", 3).collect()
    assert sum(f["messages"] for f in files) == len(rows) and max(f["messages"] for f in files) == 3
    assert {f["file"]: f["bytes"] for f in files} == {x.name: x.stat().st_size for x in (tmp_path / "feed").iterdir() if not x.name.startswith(".")}
    back = itch.read_itch(spark, f"file://{tmp_path}/feed").orderBy("file", "seq").collect()
    assert [(r["stock_locate"], int(r["file"].split("-")[1]), *(r[c] for c in ("kind", "time_ns", "order_ref", "side", "shares", "price", "stock"))) for r in back] == [(s, d, k, *rest) for s, d, _, k, *rest in rows]
    with pytest.raises(OverflowError):
        itch.encode([{"kind": "D", "time_ns": 1 << 48, "order_ref": 1}])


def test_itch_decode_has_all_symbols(spark):
    out = QUERIES["itch_decode"](spark, "/root/testdata/sf0.001").groupBy("stock_locate").agg({"messages": "sum"}).collect()
    plain = QUERIES["clean_replay_stats"](spark, "/root/testdata/sf0.001").groupBy("symbol").agg({"messages": "sum"}).collect()
    assert sorted(tuple(r) for r in out) == sorted((r[0] + 1, r[1]) for r in plain)


def test_time_weighting_and_edges(spark):
    rows = book(spark, [(0, [(10000, 1)], [(9998, 1)]), (1, [(10000, 1)], [(9996, 1)]), (4, [(10000, 1)], [(9999, 1)])])
    one = bs.bin_ratios(bs.time_weighted(bs.holds(rows, 10 * S), 10 * S, 0, 10 * S)).first()
    assert one["spread_x_ns"] == 20 * S and one["tw_spread_ticks"] == 2.0
    two = bs.time_weighted(bs.holds(book(spark, [(2, [(10000, 1)], [(9998, 1)]), (10, [(10000, 1)], [(9998, 1)])]), 12 * S), 4 * S, 0, 12 * S)
    assert [int(r["two_sided_ns"]) // S for r in two.orderBy("bin").collect()] == [2, 4, 4]


def test_flow_terms(spark):
    prev = (10000, 300, 10100, 150)
    cases = [((10000, 400, 10100, 150), 100), ((10000, 240, 10100, 150), -60), ((10050, 250, 10100, 150), 250), ((9900, 1000, 10100, 150), -300), ((10000, 300, 10100, 250), -100), ((10000, 300, 10100, 90), 60), ((10000, 300, 10050, 250), -250), ((10000, 300, 10200, 7), 150), ((10000, 350, 10100, 130), 70), (prev, 0)]
    rows = [(0, d, i, i, *t) for d, (cur, _) in enumerate(cases) for i, t in enumerate((prev, cur))]
    out = of.events(spark.createDataFrame(rows, "symbol int, day int, seq bigint, time_ns bigint, bid bigint, bid_size bigint, ask bigint, ask_size bigint")).orderBy("day").collect()
    assert [r["e"] for r in out] == [e for _, e in cases]


EVENTS = [(0.5, 2, 100, 20000, 20000), (2, 7, -30, 20000, 19900), (7, 12, 0, 19900, 19900), (12, 15, 50, 19900, 20100), (15, 31, -80, 20100, 20000), (31, 33, 10, 20000, 20000), (33, 48, -5, 20000, 19950), (48, 59, 200, 19950, 20200), (59, 61, 1000, 20200, 20300)]


def test_clocks(spark):
    ev = spark.createDataFrame([(0, 0, i, int(a * S), int(b * S), *r) for i, (a, b, *r) in enumerate(EVENTS)], "symbol int, day int, seq bigint, time_prev bigint, time_ns bigint, e bigint, mid2_prev bigint, mid2 bigint")
    cal = of.calendar(ev, 10 * S, 0, 60 * S).orderBy("bucket").collect()
    assert [(r["n_events"], r["n_updates"], r["ofi"], r["abs_flow"], r["mid2_open"], r["mid2_close"]) for r in cal] == [(2, 2, 70, 130, 20000, 19900), (2, 1, 50, 50, 19900, 20100), (0, 0, 0, 0, 20100, 20100), (2, 2, -70, 90, 20100, 20000), (1, 1, -5, 5, 20000, 19950), (1, 1, 200, 200, 19950, 20200)]
    clock = of.event_clock(ev.where("seq < 8"), 3).orderBy("bucket").collect()
    assert [(r["n_events"], r["n_updates"], r["ofi"], r["abs_flow"], r["mid2_open"], r["mid2_close"]) for r in clock] == [(4, 3, 120, 180, 20000, 20100), (3, 3, -75, 95, 20100, 19950)]


def test_lifecycle_day(spark):
    day = [(0.0, 1, 1, 100, 10000, 1), (0.1, 1, 2, 200, 10100, -1), (0.2, 1, 3, 300, 10000, 1), (0.3, 1, 4, 50, 10050, 1), (0.4, 1, 5, 100, 9800, 1), (1.0, 2, 3, 100, 10000, 1), (2.0, 4, 1, 40, 10000, 1), (2.5, 4, 1, 60, 10000, 1), (3.0, 3, 3, 150, 10000, 1), (3.5, 3, 99, 10, 9900, 1), (4.0, 5, 0, 30, 10050, -1), (5.0, 3, 2, 200, 10100, -1)]
    m = spark.createDataFrame([(0, 0, i, int(r[0] * S), *r[1:]) for i, r in enumerate(day)], "symbol int, day int, seq bigint, time_ns bigint, kind int, order_id bigint, size bigint, price bigint, direction int")
    life = {r["order_id"]: r for r in lc.lives(m).collect()}
    assert (life[1]["executed"], life[1]["fills"], life[1]["lifetime_ns"]) == (100, 2, 2.5 * S) and (life[3]["cancelled"], life[3]["lifetime_ns"]) == (300, 2.8 * S)
    assert life[2]["outcome"] == "cancelled" and {life[4]["outcome"], life[5]["outcome"]} == {"censored"} and sum(r["disagreements"] for r in life.values()) == 1
    c = lc.cancel_to_trade(m).first()
    assert (c["dark_ops"], c["dark_shares"]) == (1, 10) and (round(c["by_messages"], 9), c["by_orders"], c["by_shares"]) == (round(4 / 3, 9), 2.0, 5.0)
    assert (c["executed_orders"], c["odd_lots"], c["round_lots"], c["hidden_share"], c["odd_lot_share"]) == (1, 3, 0, 1 / 3, 1.0)
    book_rows = m.select("symbol", "day", "seq", "time_ns", F.array(F.struct(F.lit(10100).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size"))).alias("asks"), F.array(F.struct(F.lit(10000).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size"))).alias("bids"))
    rows = lc.summarize(m, book_rows).collect()
    long = {(r["section"], r["statistic"]): r["value"] for r in rows}
    assert len(rows) == len(long) == 83 and all(r["definition"] for r in rows)
    assert [long["lifetime_naive", f"S_at_{k}"] for k in ("1ms", "1s", "10s")] == [1, 1, 0]
    assert [round(long["lifetime_km", f"S_at_{k}"], 9) for k in ("1s", "10s", "1h")] == [1, 0, 0]
    assert [long["fill_by_distance", f"over_10_{k}"] for k in ("orders", "share_of_adds", "fill_rate_shares")] == [0, 0, None]
    grid = lc.survival_grid(lc.lives(m)).orderBy("t").collect()
    assert len(grid) == 122 and (grid[0]["t"], grid[1]["t"], grid[-1]["t"]) == (100_000, int(10**5.05), 23_400 * S)
    assert {(r["n_observed"], r["n_censored"]) for r in grid} == {(3, 2)} and grid[-1]["s_naive"] == 0
    assert long["ends", "orders_added"] == 5 and long["ends", "share_censored"] == 0.4 and long["ends", "shares_unresolved"] == 150
    assert long["lifetime_naive", "observed_p50_ms"] == 2800 and long["lifetime_naive", "executed_p50_ms"] == 2500 and long["lifetime_km", "censored_share"] == 0.4
    # Two orders are last seen when they are added; of three at risk the first to end, after 2.5 s, is the executed one.
    curve = lc.kaplan_meier(lc.durations(lc.lives(m))).orderBy("t").collect()
    assert [(r["t"] / S, r["at_risk"], round(r["survival"], 9)) for r in curve] == [(2.5, 3, round(2 / 3, 9)), (2.8, 2, round(1 / 3, 9)), (4.9, 1, 0)]
    assert long["lifetime_km", "median_ms"] == 2800 and long["accounting", "readded_ids"] == 0 and long["sizes", "add_size_p50"] == 100


def test_book_shape_of_sparse_and_empty_books(spark):
    ask, one = [(10100, 10), (10300, 20)], [(10200, 5)]
    rows = [(0, ask, [(10000, 30), (9900, 40)]), (1, one, [(10000, 30)]), (4, [], []), (6, ask, [])]
    s = bs.holds(book(spark, rows), 10 * S)
    bins = bs.bin_ratios(bs.time_weighted(s, 10 * S, 0, 10 * S)).first()
    assert (bins["two_sided_ns"], bins["empty_ns"], bins["one_sided_ns"], bins["one_sided_share"]) == (4 * S, 2 * S, 4 * S, 0.6)
    levels = {(r["side"], r["level"]): r for r in bs.level_profile(s).collect()}
    assert levels["ask", 2]["one_cent_gap_share"] == 0 and levels["bid", 2]["one_cent_gap_share"] == 1 and levels["ask", 1]["one_cent_gap_share"] is None
    assert (levels["ask", 1]["side_gap_cents"], levels["bid", 1]["side_gap_cents"], levels["ask", 2]["side_one_cent_share"]) == (2, 1, 0)
    cents = {(r["side"], r["cent"]): r for r in bs.cent_profile(s, max_cents=3).collect()}
    # The ask band reaches cent 2 for one of four seconds, so the 20 shares there are a mean of 20, and cent 1 is a known 0.
    assert (cents["ask", 2]["tw_size"], cents["ask", 1]["tw_size"], cents["ask", 3]["tw_size"], cents["ask", 2]["coverage"]) == (20, 0, None, 0.25)


def test_exact_ratios_round_half_up(spark):
    rows = spark.createDataFrame([(1, 2_000_000), (3, 2_000_000), (5, 0)], "a bigint, b bigint")
    assert [r[0] for r in rows.select(millionths("a", "b")).collect()] == [1e-6, 2e-6, None]


def test_flow_of_a_day_and_fits_without_variation(spark):
    ev = spark.createDataFrame([(0, 0, i, 0, i * S, e, 20000, 20000 + 2 * e) for i, e in enumerate((5, -50, 0, 50, -5))], "symbol int, day int, seq bigint, time_prev bigint, time_ns bigint, e bigint, mid2_prev bigint, mid2 bigint")
    d = of.day_summary(ev).first()
    assert (d["buy_shares"], d["sell_shares"], d["net"], d["net_share"], d["largest"], d["largest_ns"], d["zero"]) == (55, 55, 0, 0, -50, S, 1)
    rows = spark.createDataFrame([("flat y", float(x), 2.0) for x in (1, 2, 3)] + [("flat x", 2.0, float(y)) for y in (1, 2, 6)] + [("far", 1e9 + x, 2e9 + 2 * x) for x in (0, 1, 2)], "k string, x double, y double")
    fit = {r["k"]: r for r in of.ols(rows, ["k"], "x", "y").collect()}
    assert (round(fit["flat y"]["beta0"], 12), fit["flat y"]["r2_origin"], fit["flat y"]["beta"], fit["flat y"]["alpha"], fit["flat y"]["r2"]) == (round(12 / 14, 12), None, 0, 2, None)
    assert fit["flat x"]["beta0"] == 1.5 and fit["flat x"]["beta"] is None and fit["flat x"]["r2"] is None and fit["flat x"]["r2_origin"] == 1 - 14 / 14
    assert (round(fit["far"]["beta"], 9), round(fit["far"]["r2"], 9)) == (2, 1)


def test_files_of_two_depths_agree_on_the_touch(spark):
    level = lambda p, n: [(p, n)]
    ten = book(spark, [(0, level(10100, 5), []), (1, level(10100, 5), level(10000, 7)), (3, level(10200, 5), level(10000, 7)), (6, [], level(10000, 7))])
    ten = ten.withColumn("kind", F.lit(4)).withColumn("size", F.lit(10))
    same = cs.levels_agree(ten.where("seq > 0"), ten, 10 * S).first()
    assert same["agree"] and (same["two_sided_ns"], same["spread_x_ns"], same["one_cent_ns"], same["trades"], same["trade_shares"]) == (5 * S, 800 * S, 2 * S, 3, 30)
    assert not cs.levels_agree(ten.where("seq > 0"), ten.withColumn("size", F.lit(11)), 10 * S).first()["agree"]


def test_survival(spark):
    t = spark.createDataFrame([(1, True), (2, True), (2, True), (4, True), (3, False), (5, False)], "t bigint, died boolean").withColumn("k", F.lit(0))
    curve = lc.kaplan_meier(t, ["k"])
    assert [(r["t"], round(r["survival"], 12)) for r in curve.orderBy("t").collect()] == [(1, round(5 / 6, 12)), (2, 0.5), (4, 0.25)]
    assert lc.km_median(curve, ["k"]).first()["median"] == 2
    assert floor_pick(t, ["k"], "t", 0.5, "q").first()["q"] == 3 and nearest_rank(t, ["k"], "t", 0.5, "q").first()["q"] == 3


def test_forecast(spark):
    f = spark.createDataFrame([(100.0, 1.0), (-200.0, -2.0), (50.0, 0.5)], "r double, y double").withColumn("k", F.lit(0))
    t = spark.createDataFrame([(100.0, 2.0), (-100.0, -0.5), (200.0, -1.0), (0.0, 3.0), (50.0, 0.0)], "r double, y double").withColumn("k", F.lit(0))
    r = fc.evaluate(f, t, ["k"]).first()
    always_wrong = spark.createDataFrame([(1.0, -1.0)] * 50, "r double, y double").withColumn("k", F.lit(0))
    assert fc.evaluate(f, always_wrong, ["k"]).first()["clears_band"] is False
    assert r["beta"] == 0.01 and round(r["r2"], 12) == round(1 - 19.5 / 14.25, 12) and (r["hits"], r["graded"], r["excluded"], r["signals"], r["edge"]) == (2, 3, 2, 4, 0.375)


def test_signs_and_spreads(spark):
    q = spark.createDataFrame([("A", 0, 0, 100.0, 100.1)], "ticker string, seq bigint, time_ns bigint, bid double, ask double")
    prices = [100.05, 100.05, 100.10, 100.00, 100.05, 100.05, 100.09, 100.05, 100.05]
    times = [-1, *range(1, 9)]
    t = spark.createDataFrame([("A", i, times[i] * S, p, 1) for i, p in enumerate(prices)], "ticker string, seq bigint, time_ns bigint, price double, size bigint")
    assert [r["sign"] for r in tp.sign_trades(t, q, ["ticker"]).orderBy("seq").collect()] == [0, 0, 1, -1, 1, 1, 1, -1, -1]
    w = spark.createDataFrame([("A", i, int(a * S), b, c) for i, (a, b, c) in enumerate([(-100, 99.0, 101.0), (10, 100.0, 100.1), (30, 100.2, 100.1), (40, 100.0, 100.2)])], "ticker string, seq bigint, time_ns bigint, bid double, ask double")
    r = tp.quoted_spread(w, ["ticker"], 0, 100 * S).first()
    assert (r["two_sided_ns"], r["excluded_ns"]) == (90 * S, 10 * S) and round(r["quoted_cents"], 9) == round(100 * 34 / 90, 9)


def test_book_operations():
    b = rp.Book()
    b.add(1, rp.BID, 100, 10)
    b.add(2, rp.BID, 100, 5)
    b.add(3, rp.ASK, 110, 7)
    for bad in (lambda: b.add(1, rp.BID, 99, 1), lambda: b.add(4, rp.BID, 110, 1), lambda: b.add(4, rp.ASK, 120, 0), lambda: b.reduce(1, 10), lambda: b.cancel(9), lambda: b.replace(1, 110, 5), lambda: b.execute(rp.BID, 16)):
        with pytest.raises(rp.Refused):
            bad()
    b.reduce(1, 4)
    assert b.execute(rp.BID, 8) == [(1, 100, 6), (2, 100, 2)] and b.top(rp.BID, 2) == [{"price": 100, "size": 3}]
    b.replace(2, 101, 4)
    assert b.best(rp.BID) == 101 and len(b.orders) == 2


def repaired(*steps, seed=True):
    r, flags = rp.Repaired(2), []
    if seed:
        r.seed([{"price": 10010, "size": 100}, {"price": 10020, "size": 200}], [{"price": 9990, "size": 150}, {"price": 9980, "size": 50}])
    for kind, oid, size, price, side in steps:
        out = dict.fromkeys(rp.FLAGS, 0)
        r.step({"kind": kind, "order_id": oid, "size": size, "price": price, "direction": side}, out)
        flags.append(out)
    return r, flags


def test_repairs():
    r, f = repaired((3, 777, 60, 9990, 1), (3, 778, 40, 9955, 1))
    assert f[0]["dark"] == 1 and f[0]["unresolved"] == 0 and (f[1]["unresolved"], f[1]["unresolved_shares"]) == (1, 40)
    r, f = repaired((3, 777, 60, 9990, 1))
    assert r.book.top(1, 1) == [{"price": 9990, "size": 90}]
    r, f = repaired((1, 500, 30, 10015, 1))
    assert f[0]["evicted"] == 1 and (r.book.best(1), r.book.best(-1)) == (10015, 10020)
    r = rp.Repaired(2)
    for i, p in enumerate((10000, 9990, 9980, 9970)):
        r.book.add(100 + i, 1, p, 10)
    out = dict.fromkeys(rp.FLAGS, 0)
    r.step({"kind": 3, "order_id": 103, "size": 10, "price": 9970, "direction": 1}, out)
    assert out["evicted"] == 2 and r.book.prices(1) == [10000]


def feed_day():
    a = lambda oid, side, price, shares: ("A", oid, None, side, shares, price)
    return [a(1, "B", 10000, 100), a(2, "S", 10010, 70), a(3, "B", 9990, 50), ("D", 1, None, None, None, None), ("X", 3, None, None, 10, None), a(4, "B", 10000, 80), a(5, "B", 10001, 60), ("X", 4, None, None, 20, None), ("D", 5, None, None, None, None), ("D", 4, None, None, None, None)]


def test_filter_and_its_replay(spark):
    rows = [(0, 0, i, i, *r) for i, r in enumerate(feed_day())]
    feed = spark.createDataFrame(rows, "symbol int, day bigint, seq bigint, time_ns bigint, kind string, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint")
    out = rp.filter_feed(feed, 1)
    shown = out.where("emitted")
    played = rp.replay_filtered(shown, shown, 1)
    r = rp.filter_report(out, played).first()
    assert (r["emitted"], r["silent_adds"], r["drift_shares"], r["predicted_dark"], r["predicted_disagree"], r["phantoms"]) == (8, 1, 20, 2, 1, 0) and r["as_predicted"]
    c = rp.filter_checks(out, 1).first()
    assert c["ok"] and (c["unexplained"], c["phantoms"], c["survivors"]) == (0, 0, 0)
    classes = {x["class"] for x in rp.graded_rows(played, shown, 1).collect()}
    assert {"BACKFILL", "STALE_SIZE"} <= classes
    assert rp.trace_silent(out).where("cause IS NOT NULL").count() > 0


def test_census_of_phantoms(spark):
    # Order 1 is shown, sinks below a better one and dies unseen; the replay cannot know. On the second day a worse price shows that its level is gone.
    a = lambda oid, side, price, shares: ("A", oid, None, side, shares, price)
    d = lambda oid: ("D", oid, None, None, None, None)
    day = [a(9, "S", 10100, 5), a(1, "B", 10000, 10), a(3, "B", 10010, 20), d(1), a(4, "S", 10200, 5), ("X", 3, None, None, 5, None)]
    rows = [(0, 0, i, i * S, *r) for i, r in enumerate(day)] + [(1, 0, i, i * S, *r) for i, r in enumerate([*day[:4], d(3), a(5, "B", 9990, 1)])]
    feed = spark.createDataFrame(rows, "symbol int, day bigint, seq bigint, time_ns bigint, kind string, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint")
    c = {r["symbol"]: r for r in rp.filter_checks(rp.filter_feed(feed, 1), 1).collect()}
    found = lambda r: tuple(r[k] for k in ("phantoms", "evicted_phantoms", "survivors", "survivor_shares", "oldest_ns"))
    assert found(c[0]) == (1, 0, 1, 10, 2 * S) and found(c[1]) == (1, 1, 0, 0, None) and c[0]["no_anomaly"] and c[1]["no_anomaly"]


def test_feed_refusals(spark):
    rows = [("A", 1, None, "B", 100, 10000), ("A", 2, None, "B", 50, 10000), ("A", 3, None, "S", 10, 10010), ("E", 2, None, None, 20, None), ("C", 2, None, None, 10, None), ("U", 1, 9, None, 10, 10010), ("E", 1, None, None, 100, None), ("X", 2, None, None, 20, None), ("D", 77, None, None, None, None), ("P", 0, None, None, None, None)]
    feed = spark.createDataFrame([(0, 0, i, i, *r) for i, r in enumerate(rows)], "symbol int, day bigint, seq bigint, time_ns bigint, kind string, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint")
    s = rp.replay_stats(scan.replay_feed(feed)).first()
    assert (s["front_violation"], s["crossing"], s["full_fill"], s["anomaly"], s["unknown_ref"], s["applied"], s["messages"], s["max_live"]) == (1, 1, 1, 1, 1, 9, 10, 3) and not s["clean"]


def test_divergence_classes(spark):
    cases = [([(100, 10), (98, 5)], [(100, 10), (97, 5)], 2, "STALE"), ([(100, 10), (98, 5)], [(100, 10), (99, 5)], 2, "BACKFILL"), ([(100, 10)], [(100, 12)], 1, "BACKFILL_SIZE"), ([(100, 12)], [(100, 10)], 1, "STALE_SIZE"), ([(100, 10), (98, 5)], [(100, 10)], 2, "STALE"), ([(100, 10)], [(100, 10), (98, 5)], 2, "BACKFILL")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], f"i int, o {LEVELS}, r {LEVELS}")
    out = df.orderBy("i").select(rp.divergence(rp.BID, "o", "r").alias("d")).collect()
    assert [(x["d"]["rank"], x["d"]["class"]) for x in out] == [(k, c) for _, _, k, c in cases]


def test_streams_equal_batches(spark):
    from tickloom.sources.adapters import tape

    messages = tape(spark, "/root/testdata/sf0.001").where("symbol < 2")
    check = shared_path(spark, "stream-check")
    out = stateful.run_through(spark, messages, stateful.book_states, check=check)
    rows = out.where("NOT closed").orderBy("symbol", "day", "seq").collect()
    batch = rp._grouped(messages, lambda: rp.Repaired(10), 1000, False).orderBy("symbol", "day", "seq").collect()
    best = lambda side: side[0]["price"] if side else None
    assert [(r["symbol"], r["day"], r["seq"], r["bid"], r["ask"], r["dark"], r["evicted"], r["late"]) for r in rows] == [(b["symbol"], b["day"], b["seq"], best(b["bids"]), best(b["asks"]), b["dark"], b["evicted"], False) for b in batch]
    # Each day but the last is closed by a timer, with the book as its last message left it, and its state is gone.
    ends = {(b["symbol"], b["day"]): b for b in batch}
    last = max(d for _, d in ends)
    closed = {(r["symbol"], r["day"]): r for r in out.where("closed").collect()}
    assert closed.keys() == {k for k in ends if k[1] < last}
    assert all((r["bid"], r["ask"]) == (best(ends[k]["bids"]), best(ends[k]["asks"])) for k, r in closed.items())
    # The last day's book is in the checkpoint, an entry a level.
    levels = spark.read.format("statestore").option("stateVarName", "levels").load(check).select("key.*", "user_map_key.*", "user_map_value.*").collect()
    assert {r["day"] for r in levels} <= {last}
    for k in (k for k in ends if k[1] == last):
        found = sorted((r["side"], r["price"], r["size"]) for r in levels if (r["symbol"], r["day"]) == k)
        assert found == sorted((s, x["price"], x["size"]) for s, c in ((1, "bids"), (-1, "asks")) for x in ends[k][c])


def test_late_messages_and_messages_of_a_closed_day(spark):
    check, sink, source = (shared_path(spark, x) for x in ("check", "sink", "source"))
    kind = "symbol int, day bigint, seq bigint, time_ns bigint, kind int, order_id bigint, size bigint, price bigint, direction int"
    parts = [[(0, 0, 1, S, 1, 7, 5, 100, 1), (0, 0, 3, 2 * S, 1, 8, 5, 101, 1)], [(0, 0, 2, 3 * S, 3, 7, 5, 100, 1), (0, 0, 4, 4 * S, 4, 8, 2, 101, 1)], [(0, 1, 1, 86_401 * S, 1, 9, 5, 90, 1)], [(0, 0, 9, 5 * S, 1, 7, 5, 100, 1), (0, 1, 2, 86_402 * S, 1, 10, 5, 95, 1)]]
    for rows in parts:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(source)
        stream = stateful.book_states(spark.readStream.schema(kind).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", check).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    out = sorted((r["day"], r["seq"], r["bid"], r["late"], r["closed"]) for r in spark.read.parquet(sink).collect())
    assert out == [(0, 1, 100, False, False), (0, 2, 101, True, False), (0, 3, 101, False, False), (0, 4, 101, False, False), (0, 4, 101, False, True), (1, 1, 90, False, False), (1, 2, 95, False, False)]


def test_registry(spark):
    path = shared_path(spark, "trials")
    rows = spark.createDataFrame([("q1", "m", "1"), ("q2", "m", "2")], "question string, metric string, value string")
    assert count_trials(spark, path) == 0
    assert [r["trial_id"] for r in log_trials(spark, path, rows).orderBy("trial_id").collect()] == [1, 2]
    assert [r["trial_id"] for r in log_trials(spark, path, rows).orderBy("trial_id").collect()] == [3, 4] and count_trials(spark, path) == 4
    for bad in (rows.withColumn("trial_id", F.lit(1)), rows.withColumn("odd", F.lit(1)), rows.withColumn("status", F.lit("odd")), rows.withColumn("metric", F.lit(" "))):
        with pytest.raises(ValueError):
            log_trials(spark, path, bad)
    later = spark.createDataFrame([("z", "m", "9", "abandoned"), ("a", "m", "1", "predictive")], "question string, metric string, value string, status string")
    logged = log_trials(spark, path, later).orderBy("trial_id").collect()
    assert [(r["trial_id"], r["question"], r["status"]) for r in logged] == [(5, "z", "abandoned"), (6, "a", "predictive")]
    assert sorted(r["trial_id"] for r in read_trials(spark, path).collect()) == [1, 2, 3, 4, 5, 6]


def test_two_writers_of_a_registry(spark):
    path = shared_path(spark, "trials")
    rows = lambda k, n: spark.createDataFrame([(f"q{k}-{i}", "m") for i in range(n)], "question string, metric string")
    seen: dict[int, list] = {}

    def write(k):
        seen[k] = [r["trial_id"] for n in (1, 3, 2) for r in log_trials(spark, path, rows(k, n)).orderBy("trial_id").collect()]

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    every = read_trials(spark, path).orderBy("trial_id").collect()
    assert [r["trial_id"] for r in every] == list(range(1, 19)) and sorted(x for k in seen for x in seen[k]) == list(range(1, 19))
    at = {r["trial_id"]: r["question"] for r in every}
    assert all([at[i] for i in seen[k]] == [f"q{k}-{i}" for n in (1, 3, 2) for i in range(n)] for k in seen)
    # A batch that was staged and never claimed is not read; a claim that is lost fails the query.
    rows(9, 2).write.parquet(f"{path}/batches/lost")
    assert count_trials(spark, path) == 18
    delete(spark, f"{path}/claims/{2:010d}")
    with pytest.raises(Exception, match="without gaps"):
        read_trials(spark, path).collect()


def test_results_carry_their_trials(spark):
    path = shared_path(spark, "trials")
    forecasts = spark.createDataFrame([(5, "forward", "ofi", 9, 7, 0.5, None, 0.1, 0.6, 1.0), (5, "reverse", "last", 9, 7, 0.5, 2.0, 0.1, None, 1.0)], "h int, direction string, predictor string, n_fit bigint, n_test bigint, beta double, t double, r2 double, hit_rate double, z double")
    out = logged(spark, path, forecasts, decay_trial("ABC", "2012-06-21"))
    trials = {r["trial_id"]: r for r in read_trials(spark, path).collect()}
    for r in out.collect():
        t = trials[r["trial_id"]]
        assert (t["horizon"], t["split"].split("/")[0], t["value"]) == ("5", "first-half" if r["direction"] == "forward" else "second-half", "" if r["hit_rate"] is None else "0.6")
    assert [r["trial_id"] for r in results.published(out, "decay").orderBy("trial_id").collect()] == [1, 2]


def test_members_of_many_days(spark):
    c = spark.createDataFrame([(1, "2010-01-05", "2012-12-31"), (1, "2011-01-01", "2011-06-30"), (2, "2012-03-01", None), (3, "2012-05-02", "2012-05-01"), (4, "1990-01-01", "2030-01-01")], "permno int, start string, ending string")
    n = spark.createDataFrame([(1, "OLD", "2009-01-01", "2012-01-01"), (1, "NEW", "2011-12-31", None), (2, "B", "2000-01-01", "2012-03-01"), (4, "D", "2000-01-01", "2040-01-01")], "permno int, ticker string, namedt string, nameendt string")
    daily = spark.createDataFrame([(1, "2012-01-01", -2.5, 10), (4, "2012-03-01", 3.0, None)], "permno int, date string, prc double, vol int")
    days = spark.createDataFrame([(x,) for x in ("2010-01-04", "2010-01-05", "2012-01-01", "2012-01-01", "2012-03-01", "2013-01-01", None)], "date string")
    out = sorted((str(r["date"]), r["permno"], r["ticker"], r["close"], r["dollar_volume"]) for r in tp.members_over(c, n, daily, days).collect())
    assert out == [("2010-01-04", 4, "D", None, None), ("2010-01-05", 1, "OLD", None, None), ("2010-01-05", 4, "D", None, None), ("2012-01-01", 1, "NEW", 2.5, 25.0), ("2012-01-01", 4, "D", None, None), ("2012-03-01", 1, "NEW", None, None), ("2012-03-01", 2, "B", None, None), ("2012-03-01", 4, "D", 3.0, None), ("2013-01-01", 4, "D", None, None)]
    assert [tuple(r) for r in tp.members(c, n, daily, "2010-01-05").select("permno", "ticker").orderBy("permno").collect()] == [(1, "OLD"), (4, "D")]
    assert tp.members_over(c, n, daily, days.limit(0)).count() == 0
