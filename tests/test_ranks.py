"""Global ranks, running totals and quantiles without a task that sees everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import ranks
from tickloom.operators.tape import volume_deciles
from tickloom.sources import text_feeds


def test_numbers_and_totals(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]) if i else "lone", rng.choice([None, *range(60)]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id int, w bigint").withColumns({c: F.lit(1) for c in ("t", "first", "before", "part")}).repartition(5)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    got = {r["id"]: r for r in ranks.numbered(df, ["v", "id"], "i", total="n").collect()}
    assert {r[2]: i for i, r in enumerate(sorted(rows, key=order), 1)} == {k: r["i"] for k, r in got.items()} and {r["n"] for r in got.values()} == {500}
    keyed = {r["id"]: (r["i"], r["n"]) for r in ranks.numbered(df, ["v", "id"], "i", ["k"], "n").collect()}
    sums = {r["id"]: (r["s"], r["all"]) for r in ranks.running_total(df, ["v", "id"], "w", "s", ["k"], "all").collect()}
    for k in (None, "a", "b", "lone"):
        some, upto = sorted((r for r in rows if r[0] == k), key=order), 0
        for i, r in enumerate(some, 1):
            upto += r[3]
            assert keyed[r[2]] == (i, len(some)) and sums[r[2]] == (upto, sum(x[3] for x in some))
    assert ranks.numbered(df.limit(0), ["v"], "i").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_by_both_rules(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 9 - 4, 2.0]) for _ in range(n)]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), ("none", None)], "k string, v double").repartition(3)
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    wanted = {f"f{i}": ranks.floor_place(q) for i, q in enumerate(qs)} | {f"n{i}": ranks.nearest_place(q) for i, q in enumerate(qs)}
    (r,) = ranks.picks(df, ["k"], "v", wanted).collect()
    s = sorted(values)
    for i, q in enumerate(qs):
        assert r[f"f{i}"] == s[max(0, min(n - 1, int(q * n)))] and r[f"n{i}"] == s[int(q * (n - 1) + 0.5)]


def test_many_values_of_one_key_in_many_tasks(spark):
    n = 2_000_000
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("k"), ((F.col("id") * 7_919) % n).alias("v"))
    wanted = {"a": ranks.floor_place(0.25), "b": ranks.nearest_place(0.999)}
    (r,) = ranks.picks(df, ["k"], "v", wanted).collect()
    assert (r["a"], r["b"]) == (n // 4, int(0.999 * (n - 1) + 0.5))
    ranged = ranks._ranged(df.groupBy("k", "v").count(), ["k"], ["v"])
    sizes = [x["count"] for x in ranged.groupBy(ranks._PART).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < n / 3


def test_no_window_over_one_partition(spark, tmp_path):
    universe = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "permno int, dollar_volume double")
    (tmp_path / "AB_2012-06-21_1_2_message_1.csv").write_text("".join(f"34200.{i:09d},1,{i},5,100,1\n\n" for i in range(3_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        feed = text_feeds.read_messages(spark, str(tmp_path))
        rows = sorted((r["seq"], r["order_id"]) for r in feed.collect())
        assert feed.rdd.getNumPartitions() >= 1 and rows == [(i, i) for i in range(3_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for df in (volume_deciles(universe), feed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert sorted(r["decile"] for r in volume_deciles(universe).collect())[0] == 1


def test_all_widths_from_one_pass(spark):
    from tickloom.operators import book_stats as bs
    from tickloom.operators import order_flow as of
    from tickloom.sources import adapters as ad

    d, s = "/root/testdata/sf0.001", 1_000_000_000
    widths = (1_800 * s, 2_700 * s, 36_000 * s)
    states, day = bs.holds(ad.book(spark, d), 86_400 * s), 86_400 * s
    ev = of.events(of.touches(ad.book(spark, d)))
    assert sorted(map(repr, of.touches(ad.book(spark, d)).collect())) == sorted(map(repr, ad.touch(spark, d).collect()))
    many = bs.time_weighted_many(states, widths, 0, day).cache()
    flows = of.calendars(ev, widths, 3_600 * s, day - 3_600 * s).cache()
    for w in widths:
        same = lambda a, b: sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
        assert same(many.where(F.col("width") == w), bs.time_weighted(states, w, 0, day))
        assert same(flows.where(F.col("width") == w), of.calendar(ev, w, 3_600 * s, day - 3_600 * s))
