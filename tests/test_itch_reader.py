"""Reader of binary feeds: split files, pushed filters and chosen columns against plain reads."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull

from tickloom.sources import itch


def messages(n, seed):
    rng, out = random.Random(seed), [{"kind": "S", "time_ns": 1, "event_code": "O", "stock_locate": 0}]
    out += [{"kind": "R", "time_ns": 2 + k, "stock": f"SYM{k}", "stock_locate": (k + seed) % 4 + 1} for k in range(4)]
    for i in range(n):
        m = {"kind": rng.choice("AFEXDUCPQZ"), "time_ns": 10 + i, "stock_locate": rng.randint(1, 4), "order_ref": i, "new_order_ref": i + 1, "side": rng.choice("BS"), "shares": i, "price": 7 * i, "stock": "SYM"}
        out.append(m)
    return out


@pytest.fixture(scope="module")
def feeds(tmp_path_factory):
    top = tmp_path_factory.mktemp("feeds")
    for k in range(3):
        (top / f"day{k}").write_bytes(itch.encode(messages(500 + k, k)))
    (top / "empty").write_bytes(b"")
    (top / "day3.gz").write_bytes(gzip.compress(itch.encode(messages(100, 3))))
    return top


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_split_files_equal_whole_ones(spark, feeds, tmp_path):
    whole = itch.read_itch(spark, str(feeds))
    for every in (1, 64, 505, 100_000):
        index = str(tmp_path / f"index{every}")
        itch.index_itch(spark, str(feeds), index, every)
        split = itch.read_itch(spark, str(feeds), index=index)
        assert rows(split) == rows(whole)
        n = sum(-(-(505 + k) // every) for k in range(3))
        assert split.rdd.getNumPartitions() == n + 2  # a part an index row, and the empty and the gzip file
        assert rows(itch.read_itch(spark, str(feeds), limit=70, index=index)) == rows(itch.read_itch(spark, str(feeds), limit=70))
        small = [p for part in itch.FeedReader({"path": str(feeds), "index": index, "piecebytes": "61"}, ("seq",)).partitions() for p in itch.frames(part, 61)]
        assert sum(len(x[1]) for x in small) == whole.count()


def test_filters_reach_the_reader(spark, feeds):
    whole = itch.read_itch(spark, str(feeds)).cache()
    for condition in ("kind = 'A'", "stock_locate IN (2, 9, 70000)", "kind IN ('A', 'D') AND stock_locate = 3 AND shares > 100", "file = 'day1' AND kind = 'Z'", "kind = 'A' AND kind = 'D'", "stock_locate IS NULL"):
        assert rows(itch.read_itch(spark, str(feeds), pushed=True).where(condition)) == rows(whole.where(condition))
    some = itch.read_itch(spark, str(feeds), pushed=True).where("stock_locate = 2 AND kind = 'A' AND shares > 5")
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter")[1].split("\n")[0]  # what Spark still has to test
    assert "> 5" in left and "= 2" not in left and "kind" not in left
    reader = itch.FilteredReader({"path": str(feeds)}, itch.COLUMNS)
    left = list(reader.pushFilters([EqualTo(("stock_locate",), 2), In(("kind",), ("A", "E")), IsNotNull(("kind",)), EqualTo(("shares",), 4)]))
    assert [f.attribute for f in left] == [("shares",)]
    decoded = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert decoded == whole.where("stock_locate = 2 AND kind IN ('A', 'E')").count() < whole.count() / 8


def test_chosen_columns_and_symbols(spark, feeds, tmp_path):
    whole = itch.read_itch(spark, str(feeds))
    columns = ["price", "kind", "stock", "seq", "file"]
    narrow = itch.read_itch(spark, str(feeds), columns=columns)
    assert narrow.columns == columns and rows(narrow) == rows(whole, *columns)
    asked = itch.read_itch(spark, str(feeds), kinds="AD", locates=[1, 4])
    assert rows(asked) == rows(whole.where("kind IN ('A', 'D') AND stock_locate IN (1, 4)"))
    assert itch.read_itch(spark, str(feeds), locates=[]).count() == 0
    index = str(tmp_path / "index")
    itch.index_itch(spark, str(feeds), index, 100)
    for symbols in (["SYM1", "SYM3"], ["SYM0"], ["NONE"], []):
        plain = itch.for_symbols(whole, symbols)
        assert rows(itch.read_symbols(spark, str(feeds), symbols, index=index), *plain.columns) == rows(plain)
    assert itch.for_symbols(whole, ["SYM1"]).where(F.col("kind") == "A").count() > 20


def test_damaged_feeds(spark, feeds, tmp_path):
    (tmp_path / "bad").write_bytes(itch.encode([{"kind": "D", "time_ns": 1, "order_ref": 1}]).replace(b"\x00\x13D", b"\x00\x12D")[:-1])
    with pytest.raises(Exception, match="has not 19 bytes"):
        itch.read_itch(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "cut").write_bytes((feeds / "day0").read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        itch.index_itch(spark, str(tmp_path / "cut"), str(tmp_path / "index-cut"))
