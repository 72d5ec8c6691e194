"""Book replay: order-dependent folds by symbol and day, and their checks as ordinary DataFrame operations."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import DAY, by_seq

BID, ASK = 1, -1
_LEVELS = "array<struct<price:bigint,size:bigint>>"
_PA_LEVELS = pa.list_(pa.struct([("price", pa.int64()), ("size", pa.int64())]))
FLAGS = ("applied", "dark", "unresolved", "unresolved_shares", "evicted", "evicted_shares", "size_disagrees", "anomaly", "unknown_ref", "crossing", "front_violation", "full_fill")
_FOLD = f"symbol int, day bigint, seq bigint, kind string, {', '.join(f'{f} bigint' for f in FLAGS)}, live bigint, asks {_LEVELS}, bids {_LEVELS}"


class Refused(ValueError):
    """An operation that the book does not take; nothing was changed."""


class Book:
    """Resting orders of one book: the state that a fold carries. Queues are insertion-ordered; prices are kept sorted, best
    first, and sizes summed by level."""

    def __init__(self):
        self.orders: dict[int, list] = {}
        self.queue: dict[int, dict[int, dict[int, None]]] = {BID: {}, ASK: {}}
        self.total: dict[int, dict[int, int]] = {BID: {}, ASK: {}}
        self.line: dict[int, list[int]] = {BID: [], ASK: []}  # prices, for bids with their signs turned

    def best(self, side: int) -> int | None:
        line = self.line[side]
        return -side * line[0] if line else None

    def prices(self, side: int) -> list[int]:
        return [-side * x for x in self.line[side]]

    def ahead(self, side: int, price: int, with_it: bool = False) -> list[int]:
        """Prices of a side better than a price, or as good, best first."""
        line = self.line[side]
        end = (bisect_right if with_it else bisect_left)(line, -side * price)
        return [-side * x for x in line[:end]]

    def crosses(self, side: int, price: int) -> bool:
        other = self.best(-side)
        return other is not None and (price >= other if side == BID else price <= other)

    def size_at(self, side: int, price: int) -> int:
        return self.total[side].get(price, 0)

    def top(self, side: int, k: int) -> list[dict]:
        total = self.total[side]
        return [{"price": -side * x, "size": total[-side * x]} for x in self.line[side][:k]]

    def add(self, oid: int, side: int, price: int, qty: int) -> None:
        if qty <= 0:
            raise Refused("size is not positive")
        if oid in self.orders:
            raise Refused("id rests already")
        if self.crosses(side, price):
            raise Refused("crosses the book")
        self.put(oid, side, price, qty)

    def put(self, oid: int, side: int, price: int, qty: int) -> None:
        """Rest an order that is known to be one."""
        self.orders[oid] = [side, price, qty]
        level = self.queue[side].get(price)
        if level is None:
            level = self.queue[side][price] = {}
            self.total[side][price] = 0
            insort(self.line[side], -side * price)
        level[oid] = None
        self.total[side][price] += qty

    def cancel(self, oid: int) -> int:
        if oid not in self.orders:
            raise Refused("id is unknown")
        side, price, qty = self.orders.pop(oid)
        level = self.queue[side][price]
        del level[oid]
        self.total[side][price] -= qty
        if not level:
            del self.queue[side][price], self.total[side][price]
            line = self.line[side]
            del line[bisect_left(line, -side * price)]
        return qty

    def reduce(self, oid: int, by: int) -> None:
        if oid not in self.orders:
            raise Refused("id is unknown")
        if not 0 < by < self.orders[oid][2]:
            raise Refused("reduction is not below what rests")
        order = self.orders[oid]
        order[2] -= by
        self.total[order[0]][order[1]] -= by

    def replace(self, oid: int, price: int, qty: int, new: int | None = None) -> None:
        if oid not in self.orders:
            raise Refused("id is unknown")
        side = self.orders[oid][0]
        if qty <= 0:
            raise Refused("size is not positive")
        if new is not None and new in self.orders:
            raise Refused("id rests already")
        if self.crosses(side, price):
            raise Refused("crosses the book")
        self.cancel(oid)
        self.add(oid if new is None else new, side, price, qty)

    def execute(self, side: int, qty: int) -> list[tuple[int, int, int]]:
        """(id, price, size) fills of resting orders by price, then time."""
        if not 0 < qty <= sum(self.total[side].values()):
            raise Refused("more than the side holds")
        fills = []
        while qty:
            price = self.best(side)
            oid = next(iter(self.queue[side][price]))
            take = min(qty, self.orders[oid][2])
            self.cancel(oid) if take == self.orders[oid][2] else self.reduce(oid, take)
            fills.append((oid, price, take))
            qty -= take
        return fills


class Repaired:
    """Replay of a level-filtered feed from a seed row: what the messages prove stale is removed and counted."""

    def __init__(self, levels: int):
        self.book, self.levels, self.seeded = Book(), levels, {}

    def seed(self, asks: list[dict], bids: list[dict]) -> None:
        number = -1_000_000
        for side, rows in ((BID, bids), (ASK, asks)):
            for x in rows or []:
                number -= 1
                self.book.add(number, side, x["price"], x["size"])
                self.seeded[side, x["price"]] = number

    def _evict(self, side: int, prices: list[int], out: dict) -> None:
        for p in prices:
            for oid in list(self.book.queue[side][p]):
                out["evicted"] += 1
                out["evicted_shares"] += self.book.cancel(oid)
            self.seeded.pop((side, p), None)

    def step(self, m: dict, out: dict) -> None:
        kind, side, price, size, oid, book = m["kind"], m["direction"], m["price"], m["size"], m["order_id"], self.book
        if kind >= 5:
            return
        better = book.ahead(side, price)[::-1]
        if (extra := len(better) - self.levels + 1) > 0:
            better.sort(key=lambda p: (side, p) not in self.seeded)
            self._evict(side, better[:extra], out)
        if kind == 1:
            self._evict(-side, book.ahead(-side, price, True), out)
            book.add(oid, side, price, size)
            return
        if kind == 4:
            self._evict(side, book.ahead(side, price), out)
        if oid in book.orders:
            rests = book.orders[oid][2]
            if kind == 3:
                out["size_disagrees"] += size != rests
                book.cancel(oid)
            elif size > rests:
                raise Refused("more than the order rests")
            elif size == rests:
                book.cancel(oid)
            else:
                book.reduce(oid, size)
            return
        out["dark"] += 1
        hidden = self.seeded.get((side, price))
        rests = book.orders[hidden][2] if hidden in book.orders else 0
        if size < rests:
            book.reduce(hidden, size)
        elif rests:
            book.cancel(hidden)
            del self.seeded[side, price]
        if size > rests or not rests:
            out["unresolved"] += 1
            out["unresolved_shares"] += size - rests


def _folded(batches: Iterator[pa.RecordBatch], make: Callable[[], object], first: bool) -> Iterator[tuple]:
    """(key, state after a message, the message, its flags) of rows that stream past by symbol and day; the first of a day only seeds with `first`."""
    key, state = None, None
    for batch in batches:
        for m in batch.to_pylist():
            out = dict.fromkeys(FLAGS, 0)
            begins = (m["symbol"], m["day"]) != key
            if begins:
                key, state = (m["symbol"], m["day"]), make()
            if first and begins:
                state.seed(m["seed_asks"], m["seed_bids"])
            else:
                try:
                    state.step(m, out)
                    out["applied"] += 1
                except Refused:
                    out["anomaly"] += 1
            yield key, state, m, out


def _in_order(messages: DataFrame) -> tuple[DataFrame, str]:
    """Messages by symbol and day in order of seq, and the type of their day."""
    day = "string" if dict(messages.dtypes)["day"] == "string" else "bigint"
    keyed = messages.withColumn("symbol", F.col("symbol").cast("int")).withColumn("day", F.col("day").cast(day))
    return keyed.repartition(*DAY).sortWithinPartitions(*DAY, "seq"), day


#: Rows of a batch that a fold gives on.
_BATCH = 10_000


def _grouped(messages: DataFrame, make: Callable[[], object], levels: int, first: bool) -> DataFrame:
    """One row a message: the fold of each symbol and day from a fresh state, over rows that stream past in order of seq.

    A task holds one state and one batch of rows, however long a day is.
    """
    ordered, day = _in_order(messages)
    names = ("symbol", "day", "seq", "kind", *FLAGS, "live", "asks", "bids")
    types = {"symbol": pa.int32(), "kind": pa.string(), "asks": _PA_LEVELS, "bids": _PA_LEVELS}
    types |= {"day": pa.string()} if day == "string" else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {c: [] for c in names}
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(columns[c], types.get(c, pa.int64())) for c in names], names)
        for _, state, m, out in _folded(batches, make, first):
            for c in (*DAY, "seq"):
                columns[c].append(m[c])
            columns["kind"].append(str(m["kind"]))
            for f in FLAGS:
                columns[f].append(int(out[f]))
            columns["live"].append(len(state.book.orders))
            columns["asks"].append(state.book.top(ASK, levels) if levels else None)
            columns["bids"].append(state.book.top(BID, levels) if levels else None)
            if len(columns["seq"]) >= _BATCH:
                yield batch_of()
                columns = {c: [] for c in names}
        yield batch_of()

    return ordered.mapInArrow(run, _FOLD.replace("day bigint", f"day {day}"))


def _seeded(messages: DataFrame, reference: DataFrame) -> DataFrame:
    """Messages with the book row of a day's first one, which seeds the replay."""
    first = F.min("seq").over(Window.partitionBy(*DAY))
    seeds = reference.withColumn("first", first).where("seq = first").select(*DAY, "seq", F.col("asks").alias("seed_asks"), F.col("bids").alias("seed_bids"))
    return messages.join(seeds, [*DAY, "seq"], "left")


def resting_orders(messages: DataFrame, reference: DataFrame, levels: int = 10) -> DataFrame:
    """(symbol, day, order_id, direction, price, size): what still rests after the last message of a level-filtered feed's replay."""
    ordered, day = _in_order(_seeded(messages, reference))
    kind = f"symbol int, day {day}, order_id bigint, direction int, price bigint, size bigint"
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int32(), pa.string() if day == "string" else pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closing(key: tuple, state: Repaired) -> pa.RecordBatch:
            rows = [(*key, oid, *order) for oid, order in state.book.orders.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names)

        last = None
        for key, state, _, _ in _folded(batches, lambda: Repaired(levels), True):
            if last is not None and last[0] != key:
                yield closing(*last)
            last = key, state
        if last is not None:
            yield closing(*last)

    return ordered.mapInArrow(run, kind)


def replay_filtered(messages: DataFrame, reference: DataFrame, levels: int = 10) -> DataFrame:
    """One row a message of a level-filtered feed, with flags and our top levels after it. Row one of a day is the seed.

    Each symbol and day is one task: what a message proves depends on the book that it meets.
    """
    return _grouped(_seeded(messages, reference), lambda: Repaired(levels), levels, True)


def replay_stats(rows: DataFrame) -> DataFrame:
    """Counters of each symbol and day, and whether a feed was clean."""
    g = rows.groupBy(*DAY).agg(F.count("*").alias("messages"), *[F.sum(f).alias(f) for f in FLAGS], F.max("live").alias("max_live"))
    return g.withColumn("clean", F.expr("unknown_ref + crossing + front_violation + anomaly = 0"))


def divergence(side: int, ours: str, refs: str):
    """First rank at which two sides differ and its class, as struct(rank, class); null where they agree."""
    n = F.greatest(F.size(ours), F.size(refs))
    at = lambda i: (F.get(ours, i), F.get(refs, i))

    def name(i):
        o, r = at(i)
        better = o["price"] > r["price"] if side == BID else o["price"] < r["price"]
        return F.when(o.isNull(), "BACKFILL").when(r.isNull(), "STALE").when(o["price"] == r["price"], F.when(r["size"] > o["size"], "BACKFILL_SIZE").otherwise("STALE_SIZE")).when(better, "STALE").otherwise("BACKFILL")

    differs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~at(i)[0].eqNullSafe(at(i)[1]))
    found = F.get(differs, F.lit(0))
    return F.when((n > 0) & found.isNotNull(), F.struct((found + 1).alias("rank"), name(found).alias("class")))


def graded_rows(ours: DataFrame, reference: DataFrame, levels: int) -> DataFrame:
    """Rows with `matched`, the depth to which both sides agree, and the first divergence (least rank, then name, of the sides)."""
    cut = lambda c: F.slice(c, 1, levels)
    both = ours.select(*DAY, "seq", cut("asks").alias("oa"), cut("bids").alias("ob")).join(reference.select(*DAY, "seq", "time_ns", cut("asks").alias("ra"), cut("bids").alias("rb")), [*DAY, "seq"])
    worst = F.least(divergence(ASK, "oa", "ra"), divergence(BID, "ob", "rb"))
    both = both.withColumn("w", worst)
    return both.select(*DAY, "seq", "time_ns", F.col("w").isNull().alias("matched"), F.coalesce(F.col("w.rank") - 1, F.lit(levels)).alias("agreed_depth"), F.col("w.class").alias("class"))


def validation(graded: DataFrame) -> DataFrame:
    """Match rate, streaks (gaps and islands), first divergence and matches to each depth, by symbol and day."""
    island = F.col("n") - F.row_number().over(Window.partitionBy(*DAY, "matched").orderBy("seq"))
    rows = graded.withColumn("n", F.row_number().over(by_seq())).withColumn("island", island)
    streaks = rows.where("matched").groupBy(*DAY, "island").agg(F.count("*").alias("length")).groupBy(*DAY).agg(F.count("*").alias("streaks"), F.max("length").alias("longest"))
    g = graded.groupBy(*DAY).agg(F.count("*").alias("rows"), F.count_if("matched").alias("matched"), F.min(F.when(~F.col("matched"), F.col("seq"))).alias("first_divergence"), F.count_if(F.col("agreed_depth") >= 1).alias("matched_at_1"), F.count_if(F.col("agreed_depth") >= 3).alias("matched_at_3"), *[F.count_if(F.col("class") == c).alias(c.lower()) for c in ("BACKFILL", "BACKFILL_SIZE", "STALE", "STALE_SIZE")])
    return g.join(streaks, [*DAY], "left").select("*", (F.col("matched") / F.col("rows")).alias("match_rate")).fillna(0, ["streaks", "longest"])


def hourly(graded: DataFrame) -> DataFrame:
    return graded.groupBy(*DAY, F.expr("time_ns div 3600000000000").alias("hour")).agg(F.count("*").alias("rows"), F.count_if("matched").alias("full"), F.count_if(F.col("agreed_depth") >= 1).alias("top"))


def mismatches(graded: DataFrame, ours: DataFrame, reference: DataFrame, n: int = 8) -> DataFrame:
    """The first n rows of each symbol and day that differ, with both sides as text. The limit is the feature."""
    w = Window.partitionBy(*DAY).orderBy("seq")
    first = graded.where("NOT matched").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%d x %d", x["price"], x["size"])), ", ")
    show = lambda df, tag: df.select(*DAY, "seq", F.concat(text("bids"), F.lit(" | "), text("asks")).alias(tag))
    return first.join(show(ours, "ours"), [*DAY, "seq"]).join(show(reference, "reference"), [*DAY, "seq"]).drop("k")


def primitives(feed: DataFrame) -> DataFrame:
    """A clean feed as add, reduce, delete and execute rows: a replace is a delete and an add. Adds `part`, the order within a message."""
    f = feed.where(F.col("kind").isin(*"AFXDEU"))
    code = F.when(F.col("kind").isin("A", "F"), 1).when(F.col("kind") == "X", 2).when(F.col("kind") == "E", 4).otherwise(3)
    two = F.when(F.col("kind") == "U", F.array(F.struct(F.lit(0).alias("part"), F.lit(3).alias("type"), F.col("order_ref").alias("id")), F.struct(F.lit(1).alias("part"), F.lit(1).alias("type"), F.col("new_order_ref").alias("id"))))
    return f.withColumn("p", F.explode(F.coalesce(two, F.array(F.struct(F.lit(0).alias("part"), code.alias("type"), F.col("order_ref").alias("id")))))).select("*", "p.*").drop("p")


_FILTERED = f"symbol int, day bigint, seq bigint, part int, time_ns bigint, kind int, order_id bigint, size bigint, price bigint, direction int, emitted boolean, prediction string, asks {_LEVELS}, bids {_LEVELS}"


def filter_feed(feed: DataFrame, levels: int) -> DataFrame:
    """The level-filtered view of a clean feed: one row a primitive, `emitted` when the top levels change.

    `prediction` says what a replay of the emitted rows must meet: dark and disagree for emitted ones; drift, phantom, below (born
    and died unseen) and add for silent ones. The feed's first message only seeds such a replay. A silent execution fails.
    """

    def run(table: pa.Table) -> pa.Table:
        book, seen, drifted, seed, rows = Book(), set(), set(), None, []
        for m in table.sort_by([("seq", "ascending"), ("part", "ascending")]).to_pylist():
            oid, kind = m["id"], m["type"]
            if kind == 1:
                old = m["order_ref"] if m["kind"] == "U" else None
                side = sides[old] if old is not None else (BID if m["side"] == "B" else ASK)
                price, size = m["price"], m["shares"]
            else:
                side, price, rests = book.orders[oid]
                size = rests if kind == 3 else m["shares"]
            if m["part"] == 0:
                sides = {oid: side}
            before = book.top(BID, levels), book.top(ASK, levels)
            if kind == 1:
                book.add(oid, side, price, size)
            elif size == book.orders[oid][2]:
                book.cancel(oid)
            else:
                book.reduce(oid, size)
            after = book.top(BID, levels), book.top(ASK, levels)
            said = None
            if emitted := before != after:
                if seed is None:
                    seed = oid
                elif kind == 1:
                    seen.add(oid)
                else:
                    said = "dark" if oid not in seen else "disagree" if kind == 3 and oid in drifted else None
            elif kind == 4:
                raise ValueError("an execution left the top of the book unchanged")
            elif kind == 1:
                said = "add"
            elif kind == 2 and oid in seen:
                said = "drift"
                drifted.add(oid)
            elif kind == 3:
                said = "phantom" if oid in seen else "below" if oid != seed else None
            rows.append((m["symbol"], m["day"], m["seq"], m["part"], m["time_ns"], kind, oid, size, price, side, emitted, said, after[1], after[0]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), _PA_LEVELS, _PA_LEVELS]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _FILTERED.replace(_LEVELS, "").split(", ")])

    p = primitives(feed).withColumn("symbol", F.col("symbol").cast("int")).withColumn("day", F.col("day").cast("bigint"))
    return p.select(*DAY, "seq", "part", "time_ns", "kind", "type", "id", "order_ref", "side", "price", "shares").groupBy(*DAY).applyInArrow(run, _FILTERED)


def filter_report(filtered: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """Emitted and silent counts and predictions; with a replay of the emitted rows, whether it met them."""
    says = lambda p: F.count_if(F.col("prediction") == p)
    g = filtered.groupBy(*DAY).agg(F.count("*").alias("events"), F.count_if("emitted").alias("emitted"), says("dark").alias("predicted_dark"), says("disagree").alias("predicted_disagree"), says("add").alias("silent_adds"), says("phantom").alias("phantoms"), says("below").alias("below"), F.coalesce(F.sum(F.when(F.col("prediction") == "drift", F.col("size"))), F.lit(0)).alias("drift_shares"))
    if replayed is None:
        return g
    s = replay_stats(replayed).select(*DAY, "dark", "size_disagrees", "anomaly")
    return g.join(s, [*DAY]).withColumn("as_predicted", F.expr("dark = predicted_dark AND size_disagrees = predicted_disagree AND anomaly = 0"))


def filter_checks(filtered: DataFrame, levels: int) -> DataFrame:
    """By symbol and day, the seven checks of a filter against a replay of what it emitted, whether all hold, and the census of phantoms.

    A phantom is an order that was shown and whose end was not. Of those the replay has evicted some; the others still rest in its book at the
    close (a semi join with resting_orders), with their ages then and their shares.
    """
    shown = filtered.where("emitted").withColumn("seq", 2 * F.col("seq") + F.col("part"))  # a replace is two rows of one seq
    played = replay_filtered(shown, shown, levels)
    named = ("BACKFILL", "BACKFILL_SIZE", "STALE", "STALE_SIZE")
    off = ~F.col("matched")
    graded = graded_rows(played, shown, levels).groupBy(*DAY).agg(
        F.count_if(off).alias("divergent"), F.count_if(off & F.col("class").isNotNull()).alias("classified"),
        F.count_if(F.col("class").isNotNull() & ~F.col("class").isin(*named)).alias("other_classes"),
    )
    g = filter_report(filtered).join(graded, [*DAY], "left").join(replay_stats(played).select(*DAY, "dark", "size_disagrees", "anomaly"), [*DAY], "left")
    checks = {
        "hid_something": "events > emitted", "diverged": "divergent > 0", "all_classified": "classified = divergent", "known_classes": "other_classes = 0",
        "dark_as_predicted": "dark >= predicted_dark", "disagree_as_predicted": "size_disagrees <= predicted_disagree", "no_anomaly": "anomaly = 0",
    }
    g = g.withColumns({k: F.coalesce(F.expr(v), F.lit(False)) for k, v in checks.items()})
    g = g.withColumn("ok", F.expr(" AND ".join(checks)))
    end = filtered.groupBy(*DAY).agg(F.max("time_ns").alias("last_ns"))
    ghosts = filtered.where("prediction = 'phantom'").select(*DAY, "order_id", "time_ns", "size")
    ghosts = ghosts.join(resting_orders(shown, shown, levels), [*DAY, "order_id"], "left_semi").join(end, [*DAY])
    age = F.col("last_ns") - F.col("time_ns")
    census = ghosts.groupBy(*DAY).agg(F.count("*").alias("survivors"), F.sum("size").alias("survivor_shares"), F.min(age).alias("youngest_ns"), F.median(age).alias("median_age_ns"), F.max(age).alias("oldest_ns"))
    g = g.join(census, [*DAY], "left").fillna(0, ["survivors", "survivor_shares"])
    return g.select(*DAY, *checks, "ok", "divergent", (F.col("divergent") - F.col("classified")).alias("unexplained"), "phantoms", (F.col("phantoms") - F.col("survivors")).alias("evicted_phantoms"), "survivors", "survivor_shares", "youngest_ns", "median_age_ns", "oldest_ns")


def trace_silent(filtered: DataFrame) -> DataFrame:
    """For each emitted row the last silent one before it at its side and price: an as-of join by one window."""
    w = Window.partitionBy(*DAY, "direction", "price").orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("emitted"), F.struct("seq", "kind", "order_id", "size")), ignorenulls=True).over(w)
    return filtered.withColumn("cause", last).where("emitted")


def level_deltas(operations: DataFrame) -> DataFrame:
    """Signed shares of each live operation at its order's side and price: the relational form of a clean replay."""
    home = Window.partitionBy(*DAY, "order_id", "life_no").orderBy("seq")
    ops = operations.where("life_no > 0 AND NOT dark").withColumn("at", F.first(F.struct("direction", "price", "seq")).over(home))
    delta = F.when(F.col("kind") == 1, F.col("size")).otherwise(-F.col("take"))
    return ops.select(*DAY, "seq", "order_id", "life_no", F.col("at.direction").alias("direction"), F.col("at.price").alias("price"), F.col("at.seq").alias("add_seq"), delta.alias("delta"))


def level_sizes(deltas: DataFrame) -> DataFrame:
    """Size of the touched level after each operation."""
    w = Window.partitionBy(*DAY, "direction", "price").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("level_size", F.sum("delta").over(w))


def front_of_queue(deltas: DataFrame) -> DataFrame:
    """Final levels: size, live orders and the add of the order in front."""
    live = deltas.groupBy(*DAY, "direction", "price", "order_id", "life_no").agg(F.sum("delta").alias("rest"), F.min("add_seq").alias("add_seq")).where("rest > 0")
    return live.groupBy(*DAY, "direction", "price").agg(F.sum("rest").alias("level_size"), F.count("*").alias("orders"), F.min("add_seq").alias("front_seq"))


def fifo_allocation(resting: DataFrame, demands: DataFrame, keys: list[str]) -> DataFrame:
    """Fills of demands (keys, seq, size) from resting orders (keys, seq, size), both first in first out.

    Running sums turn both sides into ranges of shares; where two overlap there is a fill. Ranges are met by union and a running
    count of begins, so each side is sorted once.
    """
    def ranges(df: DataFrame, name: str) -> DataFrame:
        upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        return df.select(*keys, F.col("seq").alias(name), (upto - F.col("size")).alias("start"), upto.alias("stop")).where("stop > start")

    r, d = ranges(resting, "resting_seq"), ranges(demands, "demand_seq")
    cuts = r.select(*keys, "start").union(d.select(*keys, "start")).distinct()
    tag = lambda df, name: df.select(*keys, "start", F.struct(F.col(name).alias("seq"), "stop").alias(name))
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    line = cuts.join(tag(r, "resting_seq"), [*keys, "start"], "left").join(tag(d, "demand_seq"), [*keys, "start"], "left")
    line = line.withColumn("r", F.last("resting_seq", ignorenulls=True).over(w)).withColumn("d", F.last("demand_seq", ignorenulls=True).over(w)).withColumn("next", F.lead("start").over(Window.partitionBy(*keys).orderBy("start")))
    size = F.least("r.stop", "d.stop", F.coalesce("next", F.lit(2**62))) - F.col("start")
    return line.select(*keys, F.col("r.seq").alias("resting_seq"), F.col("d.seq").alias("demand_seq"), size.alias("fill")).where("fill > 0")
