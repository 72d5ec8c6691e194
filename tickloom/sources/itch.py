"""Binary exchange feed (length-framed messages, 5.0 layout) as a Spark data source, and a writer for test days."""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "file string, seq bigint, kind string, decoded boolean, time_ns bigint, stock_locate int, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint, stock string, event_code string"
#: Body lengths of the message types, and the places of their fields as (offset, bytes).
LENGTHS = {"S": 12, "R": 39, "A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "H": 25}
FIELDS = {
    "A": {"order_ref": (11, 8), "side": (19, 1), "shares": (20, 4), "stock": (24, 8), "price": (32, 4)},
    "F": {"order_ref": (11, 8), "side": (19, 1), "shares": (20, 4), "stock": (24, 8), "price": (32, 4)},
    "P": {"order_ref": (11, 8), "side": (19, 1), "shares": (20, 4), "stock": (24, 8), "price": (32, 4)},
    "E": {"order_ref": (11, 8), "shares": (19, 4)},
    "C": {"order_ref": (11, 8), "shares": (19, 4), "price": (32, 4)},
    "X": {"order_ref": (11, 8), "shares": (19, 4)},
    "D": {"order_ref": (11, 8)},
    "U": {"order_ref": (11, 8), "new_order_ref": (19, 8), "shares": (27, 4), "price": (31, 4)},
    "R": {"stock": (11, 8)},
    "S": {"event_code": (11, 1)},
}
_TEXT = ("side", "stock", "event_code")


def _number(rows: np.ndarray, offset: int, width: int) -> np.ndarray:
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, 8 - width :] = rows[:, offset : offset + width]
    return wide.view(">u8").ravel().astype(np.int64)


def _text(rows: np.ndarray, offset: int, width: int) -> pa.Array:
    raw = np.ascontiguousarray(rows[:, offset : offset + width])
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(raw.tobytes())])
    return pc.ascii_rtrim_whitespace(fixed.cast(pa.binary()).cast(pa.string()))


COLUMNS = tuple(x.split()[0] for x in SCHEMA.split(", "))


def decode(data: bytes, starts: np.ndarray, lengths: np.ndarray, name: str, seq: np.ndarray, wanted: tuple[str, ...] = COLUMNS) -> pa.RecordBatch:
    """Columns `wanted` of the messages at `starts` as one batch; each type is decoded at once. A length that is not the type's fails."""
    raw = np.frombuffer(data, np.uint8)
    kinds = raw[starts]
    n = len(starts)
    numbers = {c: np.zeros(n, np.int64) for c in ("order_ref", "new_order_ref", "shares", "price") if c in wanted}
    known = {c: np.zeros(n, bool) for c in numbers}
    texts: dict[str, list] = {c: [] for c in _TEXT if c in wanted}
    decoded = np.zeros(n, bool)
    for kind, length in LENGTHS.items():
        at = np.flatnonzero(kinds == ord(kind))
        if not len(at):
            continue
        if (lengths[at] != length).any():
            raise ValueError(f"{name}: a message of type {kind} has not {length} bytes")
        decoded[at] = kind in FIELDS
        fields = {f: place for f, place in FIELDS.get(kind, {}).items() if f in wanted}
        rows = raw[starts[at, None] + np.arange(length)] if fields else None
        for field, (offset, width) in fields.items():
            if field in _TEXT:
                texts[field].append((at, _text(rows, offset, width)))
            else:
                numbers[field][at] = _number(rows, offset, width)
                known[field][at] = True
    for c in ("order_ref", "new_order_ref"):
        if c in numbers and (numbers[c] < 0).any():
            raise ValueError(f"{name}: an order reference is over 63 bits")
    values = {c: pa.array(v, mask=~known[c]) for c, v in numbers.items()}
    for c, parts in texts.items():
        place = np.full(n, -1)
        if parts:
            place[np.concatenate([at for at, _ in parts])] = np.arange(sum(len(at) for at, _ in parts))
        every = pa.concat_arrays([x for _, x in parts]) if parts else pa.array([], pa.string())
        values[c] = every.take(pa.array(place, mask=place < 0))
    head = raw[np.minimum(starts[:, None] + np.arange(11), len(raw) - 1)] if {"time_ns", "stock_locate"} & set(wanted) else None
    makers = {
        "file": lambda: pa.array([name] * n, pa.string()), "seq": lambda: pa.array(seq), "decoded": lambda: pa.array(decoded), "kind": lambda: pa.array([chr(k) for k in kinds], pa.string()),
        "time_ns": lambda: pa.array(_number(head, 5, 6), mask=lengths < 11), "stock_locate": lambda: pa.array(_number(head, 1, 2).astype(np.int32), mask=lengths < 3),
    }
    return pa.RecordBatch.from_arrays([values[c] if c in values else makers[c]() for c in wanted], list(wanted))


class FeedPart(InputPartition):
    """Frames of a file from byte `start` to `stop` (None: its end), the first of which is message number `first`."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None, first: int = 0):
        self.path, self.start, self.stop, self.first = path, start, stop, first


def feed_files(path: str) -> list[str]:
    """The feed files at a path: itself, or those of a folder whose names begin with neither _ nor a dot."""
    from pyarrow import fs

    store, plain = _store(path)
    prefix = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    info = store.get_file_info(plain)
    files = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(plain)) if x.is_file and not x.base_name.startswith(("_", "."))]
    return [prefix + x.path for x in sorted(files, key=lambda x: x.path)]


def frames(part: FeedPart, piece_bytes: int, limit: int = -1) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int, int]]:
    """(bytes, starts of bodies, lengths of bodies, number of the first, byte of the file at which the bytes begin), piece by piece."""
    store, path = _store(part.path)
    gzipped = path.endswith(".gz")
    seq, rest, at_byte = part.first, b"", part.start
    with store.open_input_stream(path, compression="gzip") if gzipped else store.open_input_file(path) as stream:
        if part.start:
            stream.seek(part.start)
        left = -1 if part.stop is None else part.stop - part.start
        while left and (piece := stream.read(piece_bytes if left < 0 else min(left, piece_bytes))):
            left -= len(piece) if left > 0 else 0
            data = rest + bytes(piece)
            at, end, starts, lengths = 0, len(data), [], []
            while at + 2 <= end:
                length = data[at] << 8 | data[at + 1]
                if at + 2 + length > end or seq + len(starts) == limit:
                    break
                starts.append(at + 2)
                lengths.append(length)
                at += 2 + length
            rest = data[at:]
            if starts:
                yield data, np.array(starts), np.array(lengths), seq, at_byte
                seq += len(starts)
            at_byte += at
            if seq == limit:
                return
    if rest:
        raise ValueError(f"{path.rsplit('/', 1)[-1]}: the last message is cut off")


class FeedReader(DataSourceReader):
    """Messages of feed files, read in pieces and never held whole.

    Without an index a file is one partition, because frames are sequential; with one (`index`, see index_itch) it is one for each
    of the index's rows. A gzip file is always one. Frames of other kinds and locates than those asked for are left out before
    they are decoded or checked; a reader that asks for some files opens no others.
    """

    def __init__(self, options: dict, columns: tuple[str, ...]):
        self.path, self.limit, self.piece = options["path"], int(options.get("limit", -1)), int(options.get("piecebytes", 1 << 24))
        self.index, self.columns = options.get("index"), columns
        self.only: dict[str, set] = {}
        if "kinds" in options:
            self.only["kind"] = set(options["kinds"])
        if "locates" in options:
            self.only["stock_locate"] = {int(x) for x in options["locates"].split(",") if x}

    def partitions(self) -> list[InputPartition]:
        files = [p for p in feed_files(self.path) if "file" not in self.only or p.rsplit("/", 1)[-1] in self.only["file"]]
        if not self.index:
            return [FeedPart(p) for p in files]
        import pyarrow.parquet as pq

        store, at = _store(self.index)
        found: dict[str, list[tuple]] = {}
        for r in pq.read_table(at, filesystem=store).to_pylist():
            found.setdefault(r["file"], []).append((r["first"], r["start"], r["stop"]))
        out = []
        for p in files:
            name = p.rsplit("/", 1)[-1]
            if name not in found:
                out.append(FeedPart(p))  # gzip, or not in the index
            out += [FeedPart(p, start, stop, first) for first, start, stop in sorted(found.get(name, [])) if self.limit < 0 or first < self.limit]
        return out

    def read(self, partition: FeedPart) -> Iterator[pa.RecordBatch]:
        name = partition.path.rsplit("/", 1)[-1]
        kinds = np.array([chr(k) in self.only.get("kind", ()) for k in range(256)])
        locates = np.zeros(1 << 16, bool)
        locates[[x for x in self.only.get("stock_locate", ()) if x is not None and 0 <= x < 1 << 16]] = True
        for data, starts, lengths, first, _ in frames(partition, self.piece, self.limit):
            raw, seq = np.frombuffer(data, np.uint8), first + np.arange(len(starts))
            if "kind" in self.only:
                some = kinds[raw[starts]]
                starts, lengths, seq = starts[some], lengths[some], seq[some]
            if "stock_locate" in self.only:
                there = lengths >= 3
                starts, lengths, seq = starts[there], lengths[there], seq[there]
                some = locates[raw[starts + 1].astype(np.int64) << 8 | raw[starts + 2]]
                starts, lengths, seq = starts[some], lengths[some], seq[some]
            if len(starts):
                yield decode(data, starts, lengths, name, seq, self.columns)


class ItchSource(DataSource):
    """spark.read.format("itch").load(file or folder, gzip too); options: limit (messages read a file), index (path of index_itch).

    A schema of some of the columns reads and decodes these alone.
    """

    @classmethod
    def name(cls) -> str:
        return "itch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options, tuple(schema.names))


class FilteredReader(FeedReader):
    """A feed reader that takes equality filters on file, kind and stock_locate from the query's plan.

    Spark 4.1 keeps a pushed reader with its relation, so two branches of one frame with different filters would share it: load
    a frame for each.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("file", "kind", "stock_locate"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.only[name] = self.only.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and f.attribute in (("file",), ("kind",))):
                yield f


class FilteredSource(ItchSource):
    @classmethod
    def name(cls) -> str:
        return "itch_filtered"

    def reader(self, schema) -> DataSourceReader:
        return FilteredReader(self.options, tuple(schema.names))


class FrameReader(FeedReader):
    """Rows of a file's index: every so many messages the number of the next one and the bytes to the row after."""

    def read(self, partition: FeedPart) -> Iterator[tuple]:
        path = partition.path
        if path.endswith(".gz"):
            return
        name, last = path.rsplit("/", 1)[-1], (0, 0)
        end = 0
        for _, starts, lengths, first, byte in frames(partition, self.piece):
            cuts = np.flatnonzero((first + np.arange(len(starts))) % self.limit == 0)
            for k in cuts.tolist():
                here = (first + k, byte + int(starts[k]) - 2)
                if here[0]:
                    yield name, last[0], last[1], here[1]
                last = here
            end = byte + int(starts[-1] + lengths[-1])
        if end:
            yield name, last[0], last[1], end


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "itch_frames"

    def schema(self) -> str:
        return "file string, first bigint, start bigint, stop bigint"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options, ())


def index_itch(spark: SparkSession, path: str, index: str, every: int = 1_000_000) -> None:
    """Write the frame index of feed files to `index` as Parquet: a row for every `every` messages of a file, from one pass over it
    (a task a file). Gzip files have no rows, and an empty file has none."""
    spark.dataSource.register(FrameSource)
    spark.read.format("itch_frames").option("limit", every).load(path).write.parquet(index)


def read_itch(
    spark: SparkSession, path: str, limit: int | None = None, index: str | None = None, columns: list[str] | None = None,
    kinds: str | None = None, locates: list[int] | None = None, pushed: bool = False,
) -> DataFrame:
    """Messages of a feed file or folder. With an index many tasks read one file; `columns` are decoded alone, and of messages those of
    `kinds` (letters) and `locates`. `pushed`: the query's own equality filters reach the reader too (see FilteredReader); the session's filter
    pushdown for Python sources is turned on for this."""
    spark.dataSource.register(FilteredSource if pushed else ItchSource)
    if pushed:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("itch_filtered" if pushed else "itch")
    given = None if locates is None else ",".join(map(str, locates))
    for name, value in (("limit", limit), ("index", index), ("kinds", kinds), ("locates", given)):
        reader = reader if value is None else reader.option(name, value)
    if columns is not None:
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def for_symbols(feed: DataFrame, symbols: list[str]) -> DataFrame:
    """System events, and all messages of the wanted symbols: their locates come from the feed's own directory rows."""
    wanted = feed.where((F.col("kind") == "R") & F.col("stock").isin(symbols)).select("file", "stock_locate", F.col("stock").alias("symbol_name")).distinct()
    named = feed.join(wanted, ["file", "stock_locate"], "left")
    return named.where((F.col("kind") == "S") | F.col("symbol_name").isNotNull())


def read_symbols(spark: SparkSession, path: str, symbols: list[str], limit: int | None = None, index: str | None = None) -> DataFrame:
    """for_symbols() of a feed with the symbols' filter in the reader.

    A first read takes directory rows alone; the locates found, at most one a symbol and file, are a filter of the second. As a locate can stand for
    another symbol in another file, files are told apart afterwards.
    """
    listed = read_itch(spark, path, limit, index, ["file", "stock_locate", "stock"], kinds="R").where(F.col("stock").isin(symbols))
    wanted = listed.select("file", "stock_locate", F.col("stock").alias("symbol_name")).distinct()
    locates = sorted({r["stock_locate"] for r in wanted.collect()})
    events = read_itch(spark, path, limit, index, kinds="S").join(wanted, ["file", "stock_locate"], "left")
    own = read_itch(spark, path, limit, index, locates=locates).where("kind != 'S'")
    return events.unionByName(own.join(wanted, ["file", "stock_locate"]))


def describe_itch(feed: DataFrame) -> DataFrame:
    """Counts by type, those not decoded, and the span of times without system events and directory rows."""
    timed = F.when(~F.col("kind").isin("S", "R"), F.col("time_ns"))
    return feed.groupBy("file", "kind").agg(F.count("*").alias("messages"), F.count_if(~F.col("decoded")).alias("not_decoded"), F.min(timed).alias("first_ns"), F.max(timed).alias("last_ns"))


def as_feed(feed: DataFrame) -> DataFrame:
    """Feed rows keyed for replay: one book a locate, one day a file."""
    return feed.select(F.col("stock_locate").alias("symbol"), F.col("file").alias("day"), "seq", "time_ns", "kind", "order_ref", "new_order_ref", "side", "shares", "price")


def _store(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_itch(feed: DataFrame, path: str, messages_per_file: int = 50_000) -> DataFrame:
    """Write rows as binary files below `path`: (file, messages, bytes) of the files, written when this is run.

    Rows have stock_locate, day, seq, kind, time_ns (of the day) and the fields of their kind. They are ranged by locate, day
    and seq over as many tasks as a shuffle has; each writes files of one locate and day and at most messages_per_file messages,
    named by locate, day and first seq, so that names sort as the messages do. A file appears whole, by renaming; a task
    that runs again writes the same files.
    """
    order = ["stock_locate", "day", "seq"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder)
        rows = (r for b in batches for r in b.to_pylist())
        for (locate, day), run in itertools.groupby(rows, lambda r: (r["stock_locate"], r["day"])):
            while part := list(itertools.islice(run, messages_per_file)):
                name, started = f"{locate:05d}-{day:07d}-{part[0]['seq']:020d}", f"{folder}/_{uuid.uuid4().hex}"
                data = encode([{k: v for k, v in r.items() if v is not None} for r in part])
                with store.open_output_stream(started) as out:
                    out.write(data)
                store.move(started, f"{folder}/{name}")
                yield pa.record_batch([pa.array([name]), pa.array([len(part)], pa.int64()), pa.array([len(data)], pa.int64())], ["file", "messages", "bytes"])

    tasks = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return feed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(write, "file string, messages bigint, bytes bigint")


def encode(messages: list[dict]) -> bytes:
    """Messages as feed bytes: dicts with kind, time_ns, stock_locate and the fields of the kind; others are zero."""
    out = []
    for m in messages:
        body = bytearray(LENGTHS.get(m["kind"], 12))
        body[0] = ord(m["kind"])
        body[1:3] = struct.pack(">H", m.get("stock_locate", 1))
        body[5:11] = m["time_ns"].to_bytes(6, "big")
        for field, (offset, width) in FIELDS.get(m["kind"], {}).items():
            if field in m:
                body[offset : offset + width] = m[field].ljust(width).encode() if field in _TEXT else m[field].to_bytes(width, "big")
        out.append(struct.pack(">H", len(body)) + bytes(body))
    return b"".join(out)
