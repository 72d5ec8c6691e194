"""Text feeds: order messages and book rows in CSV, quote and trade caches, delimited activity files, result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, hms

ABSENT = 9_999_999_999
_NUMBER = 1_000_000_000


def seconds_to_ns(text: Column) -> Column:
    """'sec.frac' to nanoseconds by digits: the fraction is padded or cut to nine; never by way of a float."""
    parts = F.split(text, "\\.")
    return F.get(parts, F.lit(0)).cast("bigint") * _NUMBER + F.rpad(F.substring(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 1, 9), 9, "0").cast("bigint")


def clock_to_ns(text: Column) -> Column:
    """'HH:MM:SS.ffffff' to nanoseconds after midnight."""
    p = F.split(text, ":")
    return (F.get(p, F.lit(0)).cast("bigint") * 3600 + F.get(p, F.lit(1)).cast("bigint") * 60) * _NUMBER + seconds_to_ns(F.get(p, F.lit(2)))


def missing(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c.cast("string"))).isin("", "NAN", "NA", "NAT", "NONE", "<NA>")


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value): lines of text files, in file order by block and row. Large files are split as Spark splits them."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    at = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"))]
    return lines.select(*at, F.monotonically_increasing_id().alias("row"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, f) of CSV files without header: seq is a line's number in its file, f its fields. Blank lines are left out.

    Lines are numbered within the blocks that Spark reads, and blocks by the lines before them: no file is sorted in one task.
    """
    rows = _raw_lines(spark, path).where(F.trim("value") != "").withColumn("row", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("lines"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("of"), F.col("block").alias("at"), "first", F.coalesce(F.sum("lines").over(upto), F.lit(0)).alias("before"))
    rows = rows.join(blocks, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    name = F.regexp_extract("file", "([^/]+)$", 1).alias("name")
    return rows.select(name, (F.col("before") + F.col("row") - F.col("first")).alias("seq"), F.split(F.rtrim("value"), ",").alias("f"))


def _named(rows: DataFrame) -> DataFrame:
    """symbol and day from names like TICKER_2012-06-21_34200000_57600000_message_10.csv; others get the name and a null day."""
    part = lambda k: F.regexp_extract("name", r"^([^_]+)_(\d{4}-\d\d-\d\d)_", k)
    return rows.withColumn("symbol", F.when(part(1) != "", part(1)).otherwise(F.col("name"))).withColumn("day", F.when(part(2) != "", part(2)))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages: symbol, day, seq, time_ns, kind 1 to 7, order_id, size, price, direction. Rows of another form fail the query."""
    rows = _named(_lines(spark, path))
    wrong = (F.size("f") != 6) | ~F.get("f", F.lit(1)).rlike("^[1-7]$") | ~F.get("f", F.lit(5)).rlike("^-?1$")
    checked = rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("not a message: "), F.array_join("f", ",")))).otherwise(F.lit(True)))
    at = lambda i, kind="bigint": F.get("f", F.lit(i)).cast(kind)
    return checked.select(*DAY, "seq", seconds_to_ns(F.get("f", F.lit(0))).alias("time_ns"), at(1, "int").alias("kind"), at(2).alias("order_id"), at(3).alias("size"), at(4).alias("price"), at(5, "int").alias("direction"))


def read_book(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """Book rows: symbol, day, seq, asks, bids, best first; absent levels are left out."""
    rows = _named(_lines(spark, path))
    rows = rows.where(F.when(F.size("f") != 4 * levels, F.raise_error(F.lit(f"a book row has not {levels} levels"))).otherwise(F.lit(True)))
    number = lambda i: F.get("f", i).cast("bigint")
    side = lambda first: F.filter(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct(number(i * 4 + first).alias("price"), number(i * 4 + first + 1).alias("size"))), lambda x: (x["size"] > 0) & (F.abs(x["price"]) != ABSENT))
    return rows.select(*DAY, "seq", side(0).alias("asks"), side(2).alias("bids"))


def describe(messages: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """Counts by type, first and last time, distinct orders, price range without halts, and whether the book rows align."""
    k = F.col("kind")
    g = messages.groupBy(*DAY).agg(F.count("*").alias("messages"), *[F.count_if(k == i).alias(f"type_{i}") for i in range(1, 8)], hms(F.min("time_ns")).alias("first"), hms(F.max("time_ns")).alias("last"), F.countDistinct("order_id").alias("orders"), F.min(F.when(k != 7, F.col("price"))).alias("least_price"), F.max(F.when(k != 7, F.col("price"))).alias("most_price"))
    if book is None:
        return g
    return g.join(book.groupBy(*DAY).agg(F.count("*").alias("book_rows")), list(DAY), "left").withColumn("aligned", F.col("messages").eqNullSafe(F.col("book_rows")))


def padded_rows(rows: DataFrame, levels: int) -> DataFrame:
    """Book rows as CSV text, absent levels filled with the absent price: the text form that read_book reads."""
    def level(i):
        a, b = F.get("asks", i), F.get("bids", i)
        return F.concat_ws(",", F.coalesce(a["price"], F.lit(ABSENT)), F.coalesce(a["size"], F.lit(0)), F.coalesce(b["price"], F.lit(-ABSENT)), F.coalesce(b["size"], F.lit(0)))

    return rows.select(*DAY, "seq", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), level), ",").alias("value"))


def message_rows(messages: DataFrame) -> DataFrame:
    time = F.format_string("%d.%09d", F.expr(f"time_ns div {_NUMBER}"), F.col("time_ns") % _NUMBER)
    return messages.select(*DAY, "seq", F.concat_ws(",", time, "kind", "order_id", "size", "price", "direction").alias("value"))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="time_ns bigint, bid double, ask double").where("bid IS NOT NULL AND ask IS NOT NULL")


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="time_ns bigint, price double, size double").where("price IS NOT NULL AND size IS NOT NULL").withColumn("size", F.col("size").cast("bigint"))


def iso_date(text: Column) -> Column:
    """20120621, 2012-06-21 and 6/21/2012 (the last two with anything after them) to 2012-06-21; anything else to null."""
    t = F.trim(text)
    plain, dashed, slashed = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    part = lambda pattern, k: F.lpad(F.regexp_extract(t, pattern, k), 4 if pattern != slashed and k == 1 else 2, "0")
    joined = lambda pattern: F.concat_ws("-", *[part(pattern, k) for k in (1, 2, 3)])
    turned = F.concat_ws("-", F.regexp_extract(t, slashed, 3), part(slashed, 1), part(slashed, 2))
    return F.when(t.rlike(plain), joined(plain)).when(t.rlike(dashed), joined(dashed)).when(t.rlike(slashed), turned)


def number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


#: Delimiters of activity files; of those that a header has equally often the first counts.
_MARKS = (",", "|", "\t", ";")
#: Columns of activity files that count thousands of shares.
THOUSANDS = ("LitVol('000)", "OrderVol('000)", "HiddenVol('000)", "TradeVolForHidden('000)", "OddLotVol('000)", "TradeVolForOddLots('000)")
#: Files up to which the table of their headers is broadcast; more of them are joined by shuffling.
BROADCAST_FILES = 20_000


def read_activity(spark: SparkSession, path: str, date: str, tickers: list[str] | None = None) -> DataFrame:
    """Daily activity records of any delimited file below `path`: ticker, date, and `fields`, a map of numbers by column name.

    The delimiter is the commonest of comma, pipe, tab and semicolon in the header (ties: the first of these); cells may be
    quoted. Ticker and date columns are found whatever their case, and files without them are skipped. A row counts if it
    reaches both; cells that it lacks are null, and those beyond the header are left out. Columns without a name are left out, and of
    columns of one name the last counts. THOUSANDS are multiplied out; of one ticker the last file and row counts.
    """
    lines = _raw_lines(spark, path).where(F.lower("file").rlike(r"\.(csv|txt|psv|tsv)$"))
    head = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("head"), F.min("row").alias("head_row"))
    head = head.withColumn("head", F.regexp_replace("head", "^\ufeff", ""))
    found = lambda i, m: F.struct(F.length("head") - F.length(F.translate("head", m, "")), F.lit(-i), F.lit(m).alias("m"))
    head = head.withColumn("mark", F.array_max(F.array(*[found(i, m) for i, m in enumerate(_MARKS)]))["m"])
    cells = F.split("head", F.concat(F.lit("\\Q"), "mark", F.lit("\\E")))
    head = head.withColumn("names", F.transform(cells, lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', ""))))
    place = lambda name: F.array_position(F.transform("names", F.lower), name) - 1
    later = lambda i: F.array_contains(F.slice("names", i + 2, F.size("names")), F.get("names", i))
    used = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: (F.get("names", i) != "") & ~later(i)).alias("used")
    head = head.select("file", "head_row", "mark", "names", used, *[place(n).cast("int").alias(n) for n in ("ticker", "date")])
    head = head.where("ticker >= 0 AND date >= 0")
    seen = head.agg(F.max(F.size("names")).alias("width"), F.count("*").alias("files")).first()
    names = [f"c{i}" for i in range(seen["width"] or 0)]
    if not names:
        return spark.createDataFrame([], "ticker string, date string, fields map<string,double>")
    head = F.broadcast(head) if seen["files"] <= BROADCAST_FILES else head
    rows = lines.join(head, "file").where("row != head_row")
    parsed = lambda m: F.from_csv("value", ", ".join(f"{c} string" for c in names), {"sep": m})
    row = reduce(lambda a, m: F.when(F.col("mark") == m, parsed(m)).otherwise(a), _MARKS[1:], parsed(_MARKS[0]))
    rows = rows.withColumn("csv", row).withColumn("cells", F.array(*[f"csv.{c}" for c in names]))
    times = lambda name: F.when(name.isin(*THOUSANDS), 1000).otherwise(1)
    entry = lambda i: F.struct(F.get("names", i), number(F.get("cells", i)) * times(F.get("names", i)))
    fields = F.map_from_entries(F.transform("used", entry)).alias("fields")
    ticker, day = F.upper(F.trim(F.get("cells", "ticker"))).alias("ticker"), iso_date(F.get("cells", "date")).alias("date")
    rows = rows.select("file", "block", "row", ticker, day, fields).where((F.col("date") == date) & F.col("ticker").isNotNull())
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin([t.upper() for t in tickers]))
    return rows.groupBy("ticker", "date").agg(F.max_by("fields", F.struct("file", "block", "row")).alias("fields"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table as Parquet, CSV with header, or JSON rows."""
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if kind == "csv" else w.json(path) if kind == "json" else w.parquet(path)
