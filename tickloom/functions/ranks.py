"""Ranks and running totals in global order, without a task that sees all rows or all rows of a key.

Rows are partitioned by range of (keys, order) and written, so that all reads agree on the partitions. Totals by partition, one row a
partition and key, are summed up to give what stands before each partition; inside one a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.shared import kept

#: Columns beside the caller's; no column of a caller has these names.
_PART, _ROW, _FIRST, _T, _BEFORE, _ALL = (f"_ranks_{x}" for x in ("part", "row", "first", "t", "before", "all"))


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` written in ranges of (keys, order), each a partition: _PART names it and _ROW ascends in it."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_ROW, F.monotonically_increasing_id())
    return kept(rows.withColumn(_PART, F.shiftright(_ROW, 33)), "ranged")


def _before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _PART, .., _BEFORE, _ALL) of (keys, _PART, .., _T): what earlier partitions of a key hold, and all of them."""
    if keys:
        upto = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        all_of = F.sum(_T).over(Window.partitionBy(*keys))
        return totals.withColumn(_BEFORE, F.coalesce(F.sum(_T).over(upto), F.lit(0))).withColumn(_ALL, all_of)
    rows, before, out = sorted(totals.collect(), key=lambda r: r[_PART]), 0, []  # one row a partition
    for r in rows:
        out.append((*r, before))
        before += r[_T]
    kind = ", ".join(f"{n} {t}" for n, t in totals.dtypes)
    return totals.sparkSession.createDataFrame([(*r, before) for r in out], f"{kind}, {_BEFORE} bigint, {_ALL} bigint")


def numbered(df: DataFrame, order: list[str], name: str, keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """`df` with `name`: 1, 2, .. in order (nulls first) within the rows of equal keys, and with their number as `total`.

    Rows that agree in the order are numbered in some order. An empty table gives no rows.
    """
    keys = keys or []
    rows = _ranged(df, keys, order)
    starts = _before(rows.groupBy(*keys, _PART).agg(F.min(_ROW).alias(_FIRST), F.count("*").alias(_T)), keys)
    at = (F.col(_ROW) - F.col(_FIRST) + F.col(_BEFORE) + 1).cast("bigint").alias(name)
    more = [F.col(_ALL).cast("bigint").alias(total)] if total else []
    return _joined(rows, starts, keys).select(*df.columns, at, *more)


def _joined(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what stands before their partition; null keys are keys."""
    named = {c: f"_ranks_of_{c}" for c in (*keys, _PART)}
    starts = starts.withColumnsRenamed(named)
    same = F.col(_PART) == F.col(named[_PART])
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(named[k]))
    return rows.join(starts, same)


def running_total(df: DataFrame, order: list[str], value: str, name: str, keys: list[str], total: str) -> DataFrame:
    """`df` with `name`: the sum of `value` over the rows of equal keys up to and with each, and with their whole sum as `total`."""
    rows = _ranged(df, keys, order)
    starts = _before(rows.groupBy(*keys, _PART).agg(F.sum(value).alias(_T)), keys)
    inside = F.sum(value).over(Window.partitionBy(*keys, _PART).orderBy(_ROW))
    return _joined(rows, starts, keys).select(*df.columns, (F.col(_BEFORE) + inside).alias(name), F.col(_ALL).alias(total))


def floor_place(q: float):
    """Number (from 0) of a quantile among n sorted values: clamp(int(q n))."""
    return lambda n: F.least(n - 1, F.floor(F.lit(float(q)) * n))


def nearest_place(q: float):
    """Number (from 0) of a quantile among n sorted values: int(q (n - 1) + 0.5)."""
    return lambda n: F.floor(F.lit(float(q)) * (n - 1) + 0.5)


def picks(df: DataFrame, keys: list[str], value: str, wanted: dict[str, object]) -> DataFrame:
    """(keys, name..): of each group's sorted values those whose numbers `wanted` (name to a place of n) gives. Nulls are left out.

    Equal values are counted first. All quantiles come from one ranking, and a group of any size is as many tasks as its values ask for.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, [value], "_n", "_upto", keys, "_all")
    least = lambda place: F.min(F.when(F.col("_upto") > place(F.col("_all")), F.col(value)))
    return ranked.groupBy(*keys).agg(*[least(place).alias(name) for name, place in wanted.items()])


def floor_pick(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    return picks(df, keys, value, {name: floor_place(q)})


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    return picks(df, keys, value, {name: nearest_place(q)})
