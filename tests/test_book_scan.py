"""Chunked replay of a feed against a plain fold from the day's start."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book_scan as scan
from tickloom.operators import replay as rp

FEED = "symbol int, day bigint, seq bigint, time_ns bigint, kind string, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint"


def plain(rows, levels):
    """(flags, live, asks, bids) after each message; orders are lists [side, price, rest] in queue order."""
    orders, out = {}, []
    for _, _, _, _, kind, oid, new, side, size, price in rows:
        f = dict.fromkeys(("applied", "crossing", "front_violation", "full_fill", "unknown_ref", "anomaly"), 0)
        best = lambda s: (max if s == "B" else min)((p for x, p, _ in orders.values() if x == s), default=None)
        over = lambda s, p: (o := best("S" if s == "B" else "B")) is not None and (p >= o if s == "B" else p <= o)
        f["applied"] = int(kind in "AFXDECU")
        if kind in "AF":
            if size <= 0 or oid in orders:
                f["anomaly"] = 1
            elif over(side, price):
                f["crossing"] = 1
            else:
                orders[oid] = [side, price, size]
        elif kind in "XDECU" and oid not in orders:
            f["unknown_ref"] = 1
        elif kind == "D":
            del orders[oid]
        elif kind == "X":
            if 0 < size < orders[oid][2]:
                orders[oid][2] -= size
            else:
                f["anomaly"] = 1
        elif kind == "U":
            own = orders[oid][0]
            if size <= 0 or new in orders:
                f["anomaly"] = 1
            elif over(own, price):
                f["crossing"] = 1
            else:
                del orders[oid]
                orders[oid if new is None else new] = [own, price, size]
        elif kind in "EC":
            own, level, rests = orders[oid]
            f["front_violation"] = int(kind == "E" and next(k for k, (s, p, _) in orders.items() if (s, p) == (own, level)) != oid)
            if size > rests or size <= 0:
                f["anomaly"] = 1
            elif size == rests:
                del orders[oid]
                f["full_fill"] = 1
            else:
                orders[oid][2] -= size
        top = []
        for s in "SB":
            sizes = {}
            for x, p, q in orders.values():
                if x == s:
                    sizes[p] = sizes.get(p, 0) + q
            top.append([(p, sizes[p]) for p in sorted(sizes, reverse=s == "B")[:levels]])
        out.append((f, len(orders), *top))
    return out


def feed(seed, n, symbol, day, wild):
    """A random feed. `wild`: ids are used again and replaced often, prices cross, sizes are too large."""
    rng, rows, ids = random.Random(seed), [], [1]
    for i in range(n):
        kind = rng.choice("AAAAFXDECUUP" if wild else "AAAXDEU")
        oid = rng.choice(ids[-12:]) if kind not in "AF" or (wild and rng.random() < 0.1) else len(ids) + 1
        new = None
        if kind in "AF" and oid not in ids:
            ids.append(oid)
        if kind == "U":
            new = None if wild and rng.random() < 0.1 else len(ids) + 1 if rng.random() < 0.9 else rng.choice(ids)
            ids += [new] if new is not None and new not in ids else []
        side = rng.choice("BS") if kind in "AF" else None
        price = 1000 + (rng.randint(-3, 3) if wild else -rng.randint(1, 4) if side == "B" else rng.randint(1, 4)) if kind in "AFU" else None
        size = rng.randint(0 if wild else 1, 9) if kind in "AFXECU" else None
        rows.append((symbol, day, 10 * i + rng.randint(0, 9), i, kind, oid, new, side, size, price))
    return rows


@pytest.mark.parametrize(("chunk", "wild", "n"), [(10**6, True, 150), (9, True, 150), (25, False, 400), (60, True, 400)])
def test_chunks_equal_a_plain_fold(spark, chunk, wild, n):
    days = [feed(k, n // (1 + k), k % 2, k // 2, wild) for k in range(4)]
    rows = [r for d in days for r in d]
    messages = spark.createDataFrame(rows, FEED).withColumn("chunk", F.lit("clash")).withColumn("live", F.lit(0)).repartition(3)
    out = scan.replay_feed(messages, 3, chunk)
    found = {(r["symbol"], r["day"], r["seq"]): r for r in out.collect()}
    assert len(found) == len(rows)
    for day in days:
        for r, (flags, live, asks, bids) in zip(day, plain(day, 3)):
            x = found[r[:3]]
            assert {k: x[k] for k in flags} == flags and x["live"] == live
            assert [(y["price"], y["size"]) for y in x["asks"]] == asks and [(y["price"], y["size"]) for y in x["bids"]] == bids
    if wild:
        total = rp.replay_stats(out).agg(*[F.sum(c).alias(c) for c in ("crossing", "front_violation", "full_fill", "unknown_ref", "anomaly")]).first()
        assert all(v > 0 for v in total)
    hours = scan.replay_hours(out, messages).collect()
    assert sum(h["applied"] for h in hours) == sum(r[4] != "P" for r in rows)


def test_a_day_is_many_tasks_and_nothing_is_nothing(spark):
    rows = feed(7, 500, 0, 0, False)
    m = scan.cut_in_chunks(spark.createDataFrame(rows, FEED), 50)
    sizes = [r["count"] for r in m.groupBy("symbol", "day", "chunk").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 150
    assert scan.replay_feed(spark.createDataFrame([], FEED)).count() == 0


def test_sides_through_a_long_chain_of_replacements(spark):
    rows = [(0, 0, 0, 0, "A", 1, None, "S", 5, 10)] + [(0, 0, i, 0, "U", i, i + 1, None, 5, 10 + i) for i in range(1, 40)]
    sides = scan.sides_of_replaced(spark.createDataFrame(rows, FEED).withColumn("side", F.when(F.col("side") == "B", 1).when(F.col("side") == "S", -1))).collect()
    assert sorted((r["order_ref"], r["side"]) for r in sides) == [(i + 1, -1) for i in range(1, 40)]


def test_opening_books_are_no_larger_than_the_feed(spark, monkeypatch):
    """Orders that are never removed: with chunks of ten messages the opening books would have some fifty orders a message."""
    rows = [(0, 0, i, i, "A", i + 1, None, "BS"[i % 2], 5, 1000 - i if i % 2 == 0 else 2000 + i) for i in range(1000)]
    sent, openings = [], scan.openings
    monkeypatch.setattr(scan, "openings", lambda changes, m: sent.append(openings(changes, m)) or sent[-1])
    out = scan.replay_feed(spark.createDataFrame(rows, FEED), 1, 10)
    found = {r["seq"]: r for r in out.collect()}
    for r, (flags, live, asks, bids) in zip(rows, plain(rows, 1)):
        x = found[r[2]]
        assert {k: x[k] for k in flags} == flags and x["live"] == live
        assert [(y["price"], y["size"]) for y in x["asks"]] == asks and [(y["price"], y["size"]) for y in x["bids"]] == bids
    m = scan.cut_in_chunks(spark.createDataFrame(rows, FEED), 10)
    merged = scan.chunks_to_merge(scan.net_changes(m.withColumn("side", F.col("side"))), m)
    assert merged > 10
    wide = m.withColumn("chunk", F.expr(f"cast(chunk div {merged} as int)"))
    assert 0 < openings(scan.net_changes(wide), wide).count() <= 1.1 * len(rows)


def test_small_chunks_of_a_long_feed_are_few_files(spark, monkeypatch):
    monkeypatch.setattr(scan, "PART_ROWS", 400)
    rows = [r for k in range(2) for r in feed(k, 1000, k, 0, False)]
    m = scan.cut_in_chunks(spark.createDataFrame(rows, FEED).repartition(3), 5)
    parts = max(5, spark.sparkContext.defaultParallelism)
    assert m.select(F.input_file_name()).distinct().count() <= parts
    chunks = m.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct("symbol", "seq")).alias("a"), F.max(F.struct("symbol", "seq")).alias("z")).orderBy("chunk").collect()
    assert [c["chunk"] for c in chunks] == list(range(len(chunks))) and len(chunks) >= 400 and max(c["n"] for c in chunks) <= 5
    assert all(x["z"] < y["a"] for x, y in zip(chunks, chunks[1:]))
