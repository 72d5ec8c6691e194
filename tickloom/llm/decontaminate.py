"""Benchmark decontamination: Wu-Manber multi-pattern search for benchmark windows, word by word."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import discard, free_name, fresh_path, texts_of, written
from tickloom.llm.hashing import frugal

#: UTF-8 bytes of distinct benchmark texts whose patterns one search holds (some 100 bytes of tables for each of them); a
#: larger benchmark is searched block after block.
BLOCK_BYTES = 4_000_000
#: Slices of the benchmark's hash order, in which running bytes are summed.
_SLICES = 1_024

#: Bytes of words to themselves, A-Z to a-z, all others to a space. Bytes of characters over U+007F are word bytes.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Search:
    """Patterns of one length with their Wu-Manber tables; a block is two words, or one for single-word patterns."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket[words[-self.block :]].append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        m, block, default, shift = self.length, self.block, self.default, self.shift.get
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift(key, default)
            if step:
                end += step
                continue
            start, here = end - m, None
            first = words[start]
            for pattern, items in self.bucket.get(key, ()):
                if pattern[0] == first:
                    here = here or tuple(words[start:end])
                    if pattern == here:
                        yield start, items
            end += 1


def build_searches(items: Iterable[tuple[int, str]], window: int) -> list[_Search]:
    """Search tables of the windows of (item number, text) rows."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for number, text in items:
        words = words_of(text)
        m = min(window, len(words))
        if m:
            for p in {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}:
                by_length[m][p].append(number)
    return [_Search(m, patterns) for m, patterns in sorted(by_length.items())]


def search_text(text: str, searches: list[_Search]) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, hit flag of each, and the numbers of items with a window in the text."""
    words = words_of(text)
    edges, items = np.zeros(len(words) + 1, np.int32), set()
    for s in searches:
        for start, numbers in s.find(words):
            edges[start] += 1
            edges[start + s.length] -= 1
            items.update(numbers)
    return len(words), np.cumsum(edges[:-1]) > 0, items


def _blocks(items: DataFrame, block_bytes: int) -> DataFrame:
    """(text, ids, block) of distinct texts (id, text): a block closes with the text that fills it, so only one larger than a
    block makes it larger. Running bytes are summed by slice of the hash order, then within slices."""
    texts = items.groupBy("text").agg(F.collect_set("id").alias("ids")).withColumn("size", F.octet_length("text").cast("bigint"))
    texts = texts.withColumn("h", F.xxhash64("text")).withColumn("slice", F.pmod("h", F.lit(_SLICES)))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = texts.groupBy("slice").agg(F.sum("size").alias("bytes"))
    sums = sums.select("slice", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slice").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return texts.join(F.broadcast(sums), "slice").select("text", "ids", F.floor(upto / block_bytes).alias("block"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with a struct column `contamination`: n_words, n_hit, spans, item_ids and contaminated.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. `spans`
    are the maximal runs of hit words as (first, count); `item_ids` are the found ids as strings, sorted and distinct.
    Null and empty texts have no words and no hits; null items are skipped; an item without id makes hits but is not
    named; items with equal ids count once; an empty benchmark finds nothing. Very long texts are searched in whole.
    Rows of `docs` are independent, repeated ones too, and are never shuffled; a column called `contamination` is replaced.

    The benchmark's distinct texts are cut into blocks of `block_bytes`. The documents pass the blocks one after the
    other, so no task ever holds the tables of more than one block, which a worker builds once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocked = written(_blocks(items, block_bytes), "benchmark-blocks")
    numbers = [r["block"] for r in blocked.select("block").distinct().orderBy("block").collect()]
    hits, ids, n_words, source = (free_name(docs, c) for c in ("hit_bits", "hit_ids", "n_words_seen", "searched_text"))
    carried = [c for c in docs.columns if c.lower() != "contamination"]
    empty = [F.lit(None).cast("binary").alias(hits), F.array().cast("array<string>").alias(ids), F.lit(0).cast("bigint").alias(n_words)]
    rows = docs.select(*carried, F.col(text).alias(source), *empty)
    for k in numbers or [0]:
        last = k == (numbers or [0])[-1]
        mine = [(r["ids"], r["text"]) for r in blocked.where(F.col("block") == k).select("ids", "text").collect()]
        rows = rows.mapInArrow(frugal(_pass(spark.sparkContext.broadcast(mine), fresh_path(spark, str(k)), window, not last)), rows.schema)
        if not last:
            rows = rows.checkpoint()
    discard(blocked)

    spans = F.expr(f"from_json(decode({hits}, 'UTF-8'), 'array<struct<first:bigint,count:bigint>>')")
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["count"])
    named = F.sort_array(F.array_distinct(ids)).alias("item_ids")
    found = F.struct(F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), spans.alias("spans"), named, (F.size(spans) > 0).alias("contaminated"))
    return rows.select(*carried, found.alias("contamination"))


#: The tables that a worker has built last, by name.
_built: dict[str, list[_Search]] = {}


def _searches(name: str, pairs: list[tuple[list[str], str]], window: int) -> list[_Search]:
    """A block's tables, built once a worker: tasks reach this function, and with it the worker's own memory, by its name."""
    if name not in _built:
        _built.clear()
        _built[name] = build_searches(((k, t) for k, (_, t) in enumerate(pairs)), window)
    return _built[name]


def _pass(shared, name: str, window: int, keep_text: bool):
    """One pass of all rows over one block's tables; the last four columns are text, spans so far, ids so far, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        searches = _searches(name, pairs, window)
        for batch in batches:
            *carried, text, bits, ids, _ = batch.columns
            n_words, new_bits, new_ids = [], [], []
            for t, b, i in zip(texts_of(text), bits.to_pylist(), ids.to_pylist()):
                n, hit, numbers = search_text(t, searches)
                for span in json.loads(b) if b else []:
                    hit[span["first"] : span["first"] + span["count"]] = True
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                n_words.append(n)
                runs = zip(edges[::2].tolist(), edges[1::2].tolist())
                new_bits.append(json.dumps([{"first": a, "count": z - a} for a, z in runs]).encode())
                new_ids.append(i + [x for k in numbers for x in pairs[k][0]])
            made = [text if keep_text else pa.nulls(len(text), text.type), pa.array(new_bits, pa.binary())]
            made += [pa.array(new_ids, pa.list_(pa.string())), pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays([*carried, *made], batch.schema.names)

    return run

