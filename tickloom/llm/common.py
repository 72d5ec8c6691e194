"""Helpers that several operators share: the shared folder, written tables, streamed vector sums."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.hashing import frugal, give_back, grouped

_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none, a master on one machine (as in tests) gets a folder of this process; a cluster is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(_unset[app])
    return _unset[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call got."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside give their shuffle files back as they end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written to the shared folder: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.written_path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle_driver(spark: SparkSession) -> None:
    """The driver drops what no query needs any more and returns free memory to the system.

    Plans, broadcasts and map outputs of ended jobs stay with the driver until it collects its garbage, which it does when its heap is
    full; a method of many small jobs asks for it between its steps.
    """
    gc.collect()
    spark._jvm.System.gc()
    give_back(True)


#: Bits of a row of a bitmap; bits of the smallest and of the largest bitmap (16 MB).
_BLOCK_BITS = 1 << 15
_LEAST_BITS, _MOST_BITS = 1 << 20, 1 << 27


def _bit_of(df: DataFrame, wanted: DataFrame, keys: tuple[str, ...], hit: str) -> DataFrame:
    """`df` with a column `hit`: whether the bit of the keys' hash is set by a row of the written table `wanted`."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    block, bitmap = free_name(df, "bitmap_block"), free_name(df, "bitmap_bits")
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    at, number = place % _BLOCK_BITS, F.floor(place / _BLOCK_BITS)
    maps = wanted.select(number.alias(block), at.alias("bit")).groupBy(block)
    maps = maps.agg(F.bitmap_construct_agg("bit").alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return df.withColumn(block, number).join(F.broadcast(maps), block, "left").select(*df.columns, found.alias(hit))


def maybe_in(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows of `df` that may have keys of the written table `wanted`: all rows of wanted keys, and some others.

    The bitmap has 16 bits or more for each row of `wanted` and 16 MB at most, and is broadcast; where keys fill it, more
    of the other rows stay. It saves the shuffle of most of `df` before an exact join.
    """
    hit = free_name(df, "bitmap_hit")
    return _bit_of(df, wanted, keys, hit).where(F.col(hit)).drop(hit)


def surely_out(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows of `df` that maybe_in() leaves out: none of them has keys of `wanted`."""
    hit = free_name(df, "bitmap_hit")
    return _bit_of(df, wanted, keys, hit).where(~F.col(hit)).drop(hit)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with underscores before it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def texts_of(column: pa.Array) -> Iterator[str]:
    """The column's strings one by one; null counts as empty."""
    for x in column:
        yield x.as_py() or ""


#: Counters of a rarity order: members share 2**20 of them. Any order is right; counters make it a rare-first one.
COUNTER_BITS = 20
_BLOCK = 1 << 14


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def rarity_counts(docs: DataFrame, text: str, members: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """Members of all texts by counter, `members` giving the 64-bit hashes of some texts.

    Each task counts in one table of fixed size, and the tables are summed in a shuffle; 2**20 sums come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for _, texts in grouped(batch.column(0)):
                total += np.bincount(counter_of(members(texts)), minlength=len(total))
        blocks = total.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(1))
        sums = [np.minimum(blocks[k], 0xFFFFFFFF).astype("<u4").tobytes() for k in used]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(sums, pa.binary())], ["block", "sums"])

    out = np.zeros((1 << COUNTER_BITS) // _BLOCK * _BLOCK, np.int64).reshape(-1, _BLOCK)
    parts = docs.select(text).mapInArrow(frugal(count), "block int, sums binary")
    for r in summed_vectors(parts, "block", "sums", "<u4").collect():
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    return out.ravel()


def summed_vectors(parts: DataFrame, key: str, vector: str, dtype: str = "<i4") -> DataFrame:
    """Element-wise sums of the binary `vector` column (packed `dtype`) by `key`, packed as 64-bit integers.

    The rows are shuffled by key and summed as they stream past, so a task holds one vector for each of its
    keys, however many rows a key has. Rows of one key must have vectors of one length.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(v.as_buffer(), dtype)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.astype(np.int64)
        if sums:
            columns = [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
            yield pa.record_batch(columns, [key, vector])

    spread = parts.select(F.col(key).cast("int").alias(key), vector).repartition(key)
    return spread.mapInArrow(frugal(add), f"{key} int, {vector} binary")
