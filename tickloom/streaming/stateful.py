"""Streaming twins: order-flow events and book state carried from batch to batch by symbol and day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.order_flow import touches
from tickloom.operators.replay import FLAGS, Refused, Repaired
from tickloom.sources.shared import delete, discard, kept, shared_path

_EVENTS = "symbol int, day bigint, seq bigint, time_prev bigint, time_ns bigint, e bigint, mid2_prev bigint, mid2 bigint, late boolean"
_BOOK = f"symbol int, day bigint, seq bigint, {', '.join(f'{f} bigint' for f in FLAGS)}, bid bigint, ask bigint, late boolean, closed boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


def flow_events(rows: DataFrame) -> DataFrame:
    """OFI events of a stream of book rows. Rows of a batch are put in order; a row at or before the last one seen is marked late and changes nothing."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_seq, *touch = state.get if state.exists else (-1, None, None, None, None, None)
        t0, b0, bs0, a0, as0 = touch
        out = []
        for r in _in_order(frames).itertuples():
            if r.seq <= last_seq:
                out.append((*key, r.seq, None, r.time_ns, None, None, None, True))
                continue
            last_seq = r.seq
            if pd.isna(r.bid) or pd.isna(r.ask):
                continue
            b, bs, a, as_ = int(r.bid), int(r.bid_size), int(r.ask), int(r.ask_size)
            if t0 is not None:
                e = (bs if b >= b0 else 0) - (bs0 if b <= b0 else 0) - (as_ if a <= a0 else 0) + (as0 if a >= a0 else 0)
                out.append((*key, r.seq, t0, r.time_ns, e, b0 + a0, b + a, False))
            t0, b0, bs0, a0, as0 = r.time_ns, b, bs, a, as_
        state.update((int(last_seq), *(None if x is None else int(x) for x in (t0, b0, bs0, a0, as0))))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _EVENTS.split(", ")]).astype({c: "Int64" for c in ("time_prev", "e", "mid2_prev", "mid2")})

    state = "last_seq bigint, time_ns bigint, bid bigint, bid_size bigint, ask bigint, ask_size bigint"
    return touches(rows).groupBy("symbol", "day").applyInPandasWithState(step, _EVENTS, state, "append", GroupStateTimeout.NoTimeout)


class BookProcessor(StatefulProcessor):
    """A book of one symbol and day as state: an entry an order and an entry a level.

    A batch reads the book's entries once and writes those that its messages changed. `last` is the sequence number of the last message.
    A timer at the day's close gives a closing row and clears the state.
    """

    def __init__(self, levels: int, close_ms: int):
        self.levels, self.close_ms = levels, close_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_id bigint", "side int, price bigint, size bigint, place bigint")
        self.sizes = handle.getMapState("levels", "side int, price bigint", "size bigint")
        self.last = handle.getValueState("last", "seq bigint")

    def _book(self) -> Repaired:
        """The book of the state's entries; orders join their queues in order of place."""
        fold = Repaired(self.levels)
        for (oid,), (side, price, size, _) in sorted(self.orders.iterator(), key=lambda x: x[1][3]) if self.orders.exists() else ():
            fold.book.put(oid, side, price, size)
        return fold

    def _write(self, old: dict, old_sizes: dict, places: dict, fold: Repaired) -> None:
        for oid, order in fold.book.orders.items():
            if old.get(oid) != order:
                self.orders.updateValue((oid,), (*order, places[oid] if oid in places else self.orders.getValue((oid,))[3]))
        for oid in old.keys() - fold.book.orders.keys():
            self.orders.removeKey((oid,))
        sizes = _sizes(fold)
        for at, size in sizes.items():
            if old_sizes.get(at) != size:
                self.sizes.updateValue(at, (size,))
        for at in old_sizes.keys() - sizes.keys():
            self.sizes.removeKey(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        if self.last.exists():
            last = self.last.get()[0]
        else:
            last = -(2**63)
            self.handle.registerTimer((int(key[1]) + 1) * self.close_ms)
        fold = self._book()
        old, old_sizes = {k: list(v) for k, v in fold.book.orders.items()}, _sizes(fold)
        places, out = {}, []
        for m in frame.to_dict("records"):
            flags = dict.fromkeys(FLAGS, 0)
            late = m["seq"] <= last
            if not late:
                last = m["seq"]
                try:
                    fold.step(m, flags)
                    flags["applied"] = 1
                except Refused:
                    flags["anomaly"] = 1
                if m["kind"] == 1 and m["order_id"] in fold.book.orders:
                    places[m["order_id"]] = m["seq"]
            out.append((*key, m["seq"], *(int(flags[f]) for f in FLAGS), fold.book.best(1), fold.book.best(-1), late, False))
        self._write(old, old_sizes, places, fold)
        self.last.update((int(last),))
        yield _book_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold = self._book()
        row = (*key, self.last.get()[0], *(0 for _ in FLAGS), fold.book.best(1), fold.book.best(-1), False, True)
        for state in (self.orders, self.sizes, self.last):
            state.clear()
        yield _book_frame([row])

    def close(self) -> None:
        pass


def _sizes(fold: Repaired) -> dict[tuple[int, int], int]:
    return {(side, price): size for side, levels in fold.book.total.items() for price, size in levels.items()}


def _book_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _BOOK.split(", ")]).astype({"bid": "Int64", "ask": "Int64"})


#: Milliseconds from midnight to the close of a day: the whole day.
CLOSE_MS = 86_400_000


def book_states(messages: DataFrame, levels: int = 10) -> DataFrame:
    """Flags and best prices after each message of a stream, and a closing row for each day that the event time has passed.

    The book is state of transformWithState, an entry an order and a level, for which the session's state store is RocksDB. `time_ns` counts from
    the epoch. Late messages, by seq, are marked and not applied; those of a closed day are dropped.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = messages.withColumn("event_time", F.timestamp_micros(F.expr("time_ns div 1000"))).withWatermark("event_time", "0 seconds")
    return timed.groupBy("symbol", "day").transformWithStateInPandas(BookProcessor(levels, CLOSE_MS), _BOOK, "append", "eventTime")


def run_through(spark: SparkSession, rows: DataFrame, operator, parts: int = 4, check: str | None = None) -> DataFrame:
    """Play `rows` as a file stream in `parts` batches in order of seq through a streaming operator; what it wrote, as a table.

    After each batch the query ends, and the next run takes its state from the checkpoint (in `check`, where that is given).
    """
    source, sink, check = shared_path(spark, "stream-in"), shared_path(spark, "stream-out"), check or shared_path(spark, "stream-state")
    rows = kept(rows, "stream-rows")
    ends = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("z")).first()
    step = ((ends["z"] or 0) - (ends["a"] or 0)) // parts + 1
    for k in range(parts):
        rows.where(F.expr(f"(seq - {ends['a'] or 0}) div {step} = {k}")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        query = operator(stream).writeStream.format("parquet").option("checkpointLocation", check).option("path", sink)
        query.trigger(availableNow=True).start().awaitTermination()
    discard(rows)
    delete(spark, source)
    return spark.read.parquet(sink)
