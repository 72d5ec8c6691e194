"""Replay of complete order feeds in many tasks a day: chunks, their changes, a scan of the changes, and chunks side by side.

A book is the state of its orders. What a chunk of messages does to each order is computed by grouping (`net_changes`), a running
pass over an order's changes gives every chunk its opening book (`openings`), and chunks are replayed from these at once. Whether a
message is refused hangs on the book that it meets, so the grouping can only suppose that none is. A replay tells what each chunk
really changed; where that gives another opening book, the chunks concerned are replayed again, until all agree. The first chunk of a
day begins with an empty book and so is right at once, and each further round makes one chunk more right at least: what comes out is
the fold from the day's start. Refusals touch few orders, so that a round or two will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY
from tickloom.operators.replay import ASK, BID, FLAGS, Book, Refused
from tickloom.sources.shared import discard, kept

#: Messages of a chunk, on average. An opening book is sent to each chunk, so a chunk should have more messages than a book has orders.
CHUNK_ROWS = 50_000
#: Messages of a range that one task sorts and cuts in chunks, where there are more of them than tasks at once.
PART_ROWS = 200_000
#: Kinds that touch the book.
KINDS = "AFXDECU"
CROSSING, FRONT, FULL, UNKNOWN, ANOMALY = 1, 2, 4, 8, 16
_BITS = {"crossing": CROSSING, "front_violation": FRONT, "full_fill": FULL, "unknown_ref": UNKNOWN, "anomaly": ANOMALY}
_CHANGE = (*DAY, "chunk", "order_ref", "side", "price", "rest", "place")
_LEVELS = "array<struct<price:bigint,size:bigint>>"
_PA_LEVELS = pa.list_(pa.struct([("price", pa.int64()), ("size", pa.int64())]))


class ChunkBook:
    """The live orders of one book while one chunk is replayed, each with its place in the queue, and the orders that were touched."""

    def __init__(self):
        self.book, self.place, self.opened, self.touched = Book(), {}, set(), set()

    def rest(self, oid: int, side: int, price: int, qty: int, place: int) -> None:
        """An order of the opening book; orders come by place."""
        self.book.put(oid, side, price, qty)
        self.place[oid] = place
        self.opened.add(oid)

    def step(self, kind: str, oid: int, side: int | None, price: int | None, size: int | None, new: int | None, seq: int) -> int:
        """Apply a message; the bits of what it met."""
        book, said = self.book, 0
        try:
            if kind in "AF":
                if size > 0 and oid not in book.orders and book.crosses(side, price):
                    return CROSSING
                book.add(oid, side, price, size)
                self._placed(oid, seq)
                return 0
            if oid not in book.orders:
                return UNKNOWN
            own, level, rests = book.orders[oid]
            if kind == "D":
                book.cancel(oid)
            elif kind == "X":
                book.reduce(oid, size)
            elif kind == "U":
                if new not in book.orders and size > 0 and book.crosses(own, price):
                    return CROSSING
                book.replace(oid, price, size, new)
                self._placed(oid if new is None else new, seq)
            else:
                said = FRONT if kind == "E" and next(iter(book.queue[own][level])) != oid else 0
                if size > rests:
                    raise Refused("more than the order rests")
                if size == rests:
                    book.cancel(oid)
                    said |= FULL
                else:
                    book.reduce(oid, size)
            self.touched.add(oid)
        except Refused:
            said |= ANOMALY
        return said

    def _placed(self, oid: int, seq: int) -> None:
        self.place[oid] = seq
        self.touched.add(oid)

    def changes(self) -> Iterator[tuple]:
        """(order, side, price, rest, place) of touched orders; rest is 0 where one of the opening book is gone."""
        for oid in self.touched:
            if oid in self.book.orders:
                yield oid, *self.book.orders[oid], self.place[oid]
            elif oid in self.opened:
                yield oid, None, None, 0, None


def cut_in_chunks(messages: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """The messages as a table with `chunk`: ranges of symbol, day and seq of about `rows` messages each. A day has as many as it needs.

    Chunks are numbered without gaps. They are pieces of wider ranges, so that small chunks of a long feed are not as many shuffle
    partitions and files.
    """
    table = kept(messages, "feed")
    total = table.count()
    parts = max(1, min(-(-total // rows), max(table.sparkSession.sparkContext.defaultParallelism, -(-total // PART_ROWS))))
    ranged = table.repartitionByRange(parts, *DAY, "seq").sortWithinPartitions(*DAY, "seq").withColumn("row", F.monotonically_increasing_id())
    ranged = kept(ranged, "feed-chunks")
    part, row = F.expr("shiftright(row, 33)"), F.expr("row & 8589934591")
    sizes = ranged.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("size"))
    pieces = F.ceil(F.col("size") / rows)  # of a range; one row a range is summed
    sizes = sizes.withColumn("pieces", pieces).withColumn("before", F.sum("pieces").over(Window.orderBy("part")) - F.col("pieces"))
    cut = ranged.withColumn("part", part.cast("int")).join(F.broadcast(sizes), "part")
    chunk = (F.col("before") + F.floor(row * F.col("pieces") / F.col("size"))).cast("int").alias("chunk")
    cut = kept(cut.select(*table.columns, chunk), "feed-chunks")
    discard(table, ranged)
    return cut


def sides_of_replaced(m: DataFrame) -> DataFrame:
    """(symbol, day, order_ref, side) of orders that replace others: the side of the first one of their chain, by doubling steps."""
    links = m.where("kind = 'U' AND new_order_ref IS NOT NULL").groupBy(*DAY, F.col("new_order_ref").alias("order_ref")).agg(F.min("order_ref").alias("root"))
    known = m.where("kind IN ('A', 'F')").groupBy(*DAY, F.col("order_ref").alias("root")).agg(F.min_by("side", "seq").alias("side"))
    todo, done = kept(links, "links"), None
    before, left = -1, todo.count()
    while left and left != before:
        ends = todo.join(known, [*DAY, "root"], "left")
        found = kept(ends.where("side IS NOT NULL").select(*DAY, "order_ref", "side"), "sides")
        old = todo
        ends = ends.where("side IS NULL").drop("side")
        further = old.select(*DAY, F.col("order_ref").alias("root"), F.col("root").alias("next"))
        todo = kept(ends.join(further, [*DAY, "root"], "left").select(*DAY, "order_ref", F.coalesce("next", "root").alias("root")), "links")
        known = known.unionByName(found.withColumnRenamed("order_ref", "root"))
        done = found if done is None else done.unionByName(found)
        discard(old)
        before, left = left, todo.count()
    discard(todo)
    return m.sparkSession.createDataFrame([], links.withColumn("side", F.lit(0)).drop("root").schema) if done is None else done


def net_changes(m: DataFrame) -> DataFrame:
    """What each chunk does to each order if no message is refused: rest after it, 0 where an earlier chunk's order is gone."""
    f = m.withColumn("side", F.when(F.col("side") == "B", BID).otherwise(ASK)).where(F.col("kind").isin(*KINDS))
    made = ("seq", "chunk", "side", "price", "shares")
    born = f.where("kind IN ('A', 'F') AND shares > 0").select(*DAY, "order_ref", *made)
    new = f.where("kind = 'U' AND new_order_ref IS NOT NULL").select(*DAY, F.col("new_order_ref").alias("order_ref"), "seq", "chunk", "price", "shares")
    born = born.unionByName(new.join(sides_of_replaced(f), [*DAY, "order_ref"]).select(*born.columns))
    born = born.groupBy(*DAY, "order_ref").agg(F.min(F.struct(*made)).alias("b"))
    taken = F.sum(F.when(F.col("kind").isin("X", "E", "C"), F.col("shares")).otherwise(0)).alias("taken")
    cuts = f.where("kind NOT IN ('A', 'F')").groupBy(*DAY, "order_ref", "chunk").agg(taken, F.max(F.col("kind").isin("D", "U")).alias("gone"))
    rows = born.select(*DAY, "order_ref", F.col("b.chunk").alias("chunk"), F.lit(0).cast("bigint").alias("taken"), F.lit(False).alias("gone"), "b")
    rows = rows.unionByName(cuts, allowMissingColumns=True).groupBy(*DAY, "order_ref", "chunk").agg(F.sum("taken").alias("taken"), F.max("gone").alias("gone"), F.max("b").alias("b"))
    upto = Window.partitionBy(*DAY, "order_ref").orderBy("chunk")
    rows = rows.withColumn("b", F.last("b", ignorenulls=True).over(upto)).where("b IS NOT NULL")
    left = F.col("b.shares") - F.sum("taken").over(upto)
    rest = F.when(F.max("gone").over(upto) | (left <= 0), 0).otherwise(left).cast("bigint").alias("rest")
    rows = rows.select(*DAY, "chunk", "order_ref", F.col("b.side").alias("side"), F.col("b.price").alias("price"), rest, F.col("b.seq").alias("place"), F.col("b.chunk").alias("first"))
    return rows.where("rest > 0 OR chunk > first").select(*_CHANGE)


def openings(changes: DataFrame, m: DataFrame) -> DataFrame:
    """The orders that rest as each chunk begins: an order's last change before it."""
    alive = _alive(changes, m).withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("upto"))))
    return alive.select(*_CHANGE)


def _alive(changes: DataFrame, m: DataFrame) -> DataFrame:
    """Changes that leave a resting order for later chunks, with `upto`, the last one that it rests at the beginning of."""
    last = m.groupBy(*DAY).agg(F.max("chunk").alias("last"))
    upto = F.lead("chunk").over(Window.partitionBy(*DAY, "order_ref").orderBy("chunk"))
    alive = changes.withColumn("upto", upto).where("rest > 0").join(last, [*DAY]).withColumn("upto", F.coalesce("upto", "last"))
    return alive.where("chunk < upto")


def chunks_to_merge(changes: DataFrame, m: DataFrame) -> int:
    """Neighbouring chunks that should be one, so that all opening books have no more orders than the feed has messages.

    A book that grows with the day would else be sent to a number of chunks that grows with it too.
    """
    sent = _alive(changes, m).agg(F.sum(F.col("upto") - F.col("chunk"))).first()[0] or 0
    return max(1, -(-sent // max(1, m.count())))


def _played(m: DataFrame, opening: DataFrame, levels: int) -> DataFrame:
    """Each chunk from its opening book: a row a message, and the rows of what the chunk changed (`order_ref` is not null)."""
    kind_of_day = dict(m.dtypes)["day"]
    names = (*DAY, "chunk", "seq", "kind", "bits", "live", "asks", "bids", "order_ref", "side", "price", "rest", "place")
    types = {"symbol": pa.int32(), "day": pa.string() if kind_of_day == "string" else pa.int64(), "chunk": pa.int32(), "kind": pa.string(), "bits": pa.int32(), "asks": _PA_LEVELS, "bids": _PA_LEVELS, "side": pa.int32()}
    types = [types.get(c, pa.int64()) for c in names]
    n_message = len(names) - 5

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, ChunkBook()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def closing() -> list[tuple]:
            return [(*key, *[None] * (n_message - 3), *c) for c in state.changes()] if key else []

        for batch in batches:
            out = []
            for symbol, day, chunk, message, seq, kind, oid, new, side, price, size in zip(*(c.to_pylist() for c in batch.columns)):
                if (symbol, day, chunk) != key:
                    out += closing()
                    key, state = (symbol, day, chunk), ChunkBook()
                if not message:
                    state.rest(oid, side, price, size, seq)
                    continue
                said = state.step(kind, oid, side, price, size, new, seq) if kind in KINDS else 0
                top = (state.book.top(ASK, levels), state.book.top(BID, levels)) if levels else (None, None)
                out.append((*key, seq, kind, said, len(state.book.orders), *top, *[None] * 5))
            yield batch_of(out)
        yield batch_of(closing())

    side = F.when(F.col("side") == "B", BID).otherwise(ASK)
    shown = (*DAY, "chunk", "message", "seq", "kind", "order_ref", "new_order_ref", "side", "price", "shares")
    rows = m.withColumn("message", F.lit(True)).withColumn("side", side).withColumn("kind", F.coalesce("kind", F.lit("None"))).select(*shown)
    first = opening.select(*DAY, "chunk", F.lit(False).alias("message"), F.col("place").alias("seq"), F.lit("").alias("kind"), "order_ref", F.lit(None).cast("bigint").alias("new_order_ref"), "side", "price", F.col("rest").alias("shares"))
    ordered = rows.unionByName(first).repartition(*DAY, "chunk").sortWithinPartitions(*DAY, "chunk", "message", "seq")
    schema = f"symbol int, day {kind_of_day}, chunk int, seq bigint, kind string, bits int, live bigint, asks {_LEVELS}, bids {_LEVELS}, order_ref bigint, side int, price bigint, rest bigint, place bigint"
    return ordered.mapInArrow(play, schema)


def _prints(opening: DataFrame, name: str) -> DataFrame:
    """A print of each chunk's opening book."""
    h = F.xxhash64("order_ref", "side", "price", "rest", "place").cast("decimal(38,0)")
    return opening.groupBy(*DAY, "chunk").agg(F.struct(F.count("*").alias("n"), F.sum(h).alias("h")).alias(name))


def replay_feed(messages: DataFrame, levels: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a message of a complete feed, with flags, live orders and our top levels after it; kinds that do not touch the book are counted only.

    Chunks are ranges of seq, so one day of one symbol is as many tasks as its messages ask for; they are longer than `chunk_rows` where
    books are large (chunks_to_merge). seq is unique in a symbol and
    day; columns beyond those of a feed play no part; an empty feed gives no rows.
    """
    day = "string" if dict(messages.dtypes)["day"] == "string" else "bigint"
    feed = messages.select(F.col("symbol").cast("int").alias("symbol"), F.col("day").cast(day).alias("day"), *[F.col(c) for c in ("seq", "kind", "order_ref", "new_order_ref", "side", "shares", "price")])
    table = m = cut_in_chunks(feed, chunk_rows)
    kinds = f"symbol int, day {day}, chunk int, order_ref bigint, side int, price bigint, rest bigint, place bigint"
    cut = not m.groupBy(*DAY).agg(F.min("chunk").alias("a"), F.max("chunk").alias("z")).where("a < z").isEmpty()
    changes = kept(net_changes(m) if cut else m.sparkSession.createDataFrame([], kinds), "changes")
    if cut and (merged := chunks_to_merge(changes, m)) > 1:
        m = table.withColumn("chunk", F.expr(f"cast(chunk div {merged} as int)"))
        finer, changes = changes, kept(net_changes(m), "changes")
        discard(finer)
    opening = kept(openings(changes, m), "opening")
    out = kept(_played(m, opening, levels), "played")
    stale = kept(m.select(*DAY, "chunk").limit(0), "stale")
    while cut:  # days of one chunk begin with empty books, and that is all
        discard(stale)
        old, was = changes, opening
        changes = kept(out.where("order_ref IS NOT NULL").select(*_CHANGE), "changes")
        opening = kept(openings(changes, m), "opening")
        both = _prints(was, "a").join(_prints(opening, "b"), [*DAY, "chunk"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        stale = kept(both.select(*DAY, "chunk"), "stale")
        discard(old, was)
        if stale.isEmpty():
            break
        some = lambda df: df.join(stale, [*DAY, "chunk"], "left_semi")
        again = _played(some(m), some(opening), levels)
        before, out = out, kept(out.join(stale, [*DAY, "chunk"], "left_anti").unionByName(again), "played")
        discard(before, stale)
    discard(table, changes, opening, stale)
    bit = lambda f: F.when(F.col("bits").bitwiseAND(_BITS[f]) != 0, 1).otherwise(0) if f in _BITS else F.lit(0)
    flags = [(F.when(F.col("kind").isin(*KINDS), 1).otherwise(0) if f == "applied" else bit(f)).cast("bigint").alias(f) for f in FLAGS]
    return out.where("order_ref IS NULL").select(*DAY, "seq", "kind", *flags, "live", "asks", "bids")


def replay_hours(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Applied messages of a replay by symbol, day and hour after midnight."""
    times = messages.select(*DAY, "seq", F.expr("time_ns div 3600000000000").alias("hour"))
    return rows.join(times, [*DAY, "seq"]).groupBy(*DAY, "hour").agg(F.sum("applied").alias("applied"))
