"""Phrases of two and three words that occur together more often than their parts would have them, by language."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import delete, discard, fresh_path, written
from tickloom.llm.hashing import frugal, mixed

#: Bytes of text of one language that are encoded in one go.
GROUP_BYTES = 8_000_000
#: n-grams that a task holds before it sends their counts on.
HELD = 3_000_000
#: Bits of a dense word id, and with it the most words of a dictionary that is broadcast (8 bytes each): three ids fit 63 bits.
ID_BITS = 21
#: Words or pairs up to which a table of them is broadcast in the joins that score; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Bits of the smallest and of the largest bitmap (16 MB), and of a row of it.
_LEAST_BITS, _MOST_BITS, _BLOCK_BITS = 1 << 20, 1 << 27, 1 << 15

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP[[9, 32]] = True
_GAP |= _BREAK


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by a break) of a (lang, text) batch, about GROUP_BYTES at a time; null is no text, A-Z become a-z."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        held[lang].append((text.as_py() or "").encode("utf-8", "surrogatepass").lower())
        size[lang] += len(held[lang][-1])
        if size[lang] >= GROUP_BYTES:
            yield lang, b"\n".join(held.pop(lang))
            del size[lang]
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _split(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word among them, whether a piece ends before it) of joined texts."""
    data = np.frombuffer(raw, np.uint8)
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    start, size = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).dictionary_encode()
    ends = np.flatnonzero(_BREAK[data])
    piece = np.searchsorted(ends, start)
    return coded.dictionary, coded.indices.to_numpy(), np.diff(piece, prepend=-1) != 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in _groups(batch):
                words, index, _ = _split(raw)
                n = np.bincount(index, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.cast(pa.string()), pa.array(n)], ["lang", "word", "n"])

    return texts.mapInArrow(frugal(count), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(h, 0xB17) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(keys: DataFrame, rows: int, pair: bool) -> np.ndarray:
    """Bits (16 a row or more, 16 MB at most) that the rows of a (w1) or (w1, w2) table set, as bytes on the driver."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << (16 * rows).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, *b = (c.to_numpy().view(np.uint64) for c in batch.columns)
            yield pa.record_batch([pa.array(_place(_pair(a, b[0]) if pair else a, bits))], ["p"])

    blocks = keys.mapInArrow(frugal(place), "p bigint").groupBy(F.floor(F.col("p") / _BLOCK_BITS).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.agg(F.bitmap_construct_agg(F.col("p") % _BLOCK_BITS).alias("x")).collect():
        out[r["b"] * (_BLOCK_BITS // 8) :][: _BLOCK_BITS // 8] = np.frombuffer(r["x"], np.uint8)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a.astype(np.uint64), 0x2A) * np.uint64(3) + b.astype(np.uint64)


class WordIds:
    """Word hashes to ids above 0, and 0 for words that are not frequent.

    Dense: `table` is the sorted array of all frequent hashes, and an id is a place in it. Wide: `table` is a bitmap, an id is the
    hash itself, and a few words that are not frequent get ids too; nothing that holds them is frequent in the end.
    """

    def __init__(self, table: np.ndarray, dense: bool):
        self.table, self.dense = table, dense

    def of(self, h: np.ndarray) -> np.ndarray:
        if not self.dense:
            return np.where(_has(self.table, h.view(np.uint64)), h, 0)
        if not len(self.table):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
        return np.where(self.table[at] == h, at + 1, 0)


def _hashed(words: pa.Array, lang: str, salt: int) -> np.ndarray:
    """The words' hashes, as Spark's xxhash64 of salt, language and word gives them."""
    head = f"{salt}:{lang}".encode("utf-8", "surrogatepass") + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)


def _encoded(texts: DataFrame, ids, salt: int) -> DataFrame:
    """(ids) packed 64-bit ids of groups of texts, with 0 for words that are not frequent and between pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: WordIds = ids.value
        kind = "<i4" if table.dense else "<i8"
        for batch in batches:
            for lang, raw in _groups(batch):
                words, index, begins = _split(raw)
                known = table.of(_hashed(words, lang, salt))[index]
                at = np.arange(len(known)) + np.cumsum(begins)
                out = np.zeros(len(known) + int(begins.sum()), kind)
                out[at] = known
                yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["ids"])

    return texts.mapInArrow(frugal(encode), "ids binary")


def _packed(columns: list[np.ndarray], dense: bool) -> np.ndarray:
    """Fixed-width keys of n-grams, ordered as unsigned bytes are: 8 bytes of dense ids, 8 bytes an id of wide ones."""
    if dense:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = key << np.uint64(ID_BITS) | c.astype(np.uint64)
        return key
    return np.ascontiguousarray(np.stack([c.view(np.uint64) for c in columns], 1).astype(">u8")).view(f"S{8 * len(columns)}")[:, 0]


def _unpacked(keys: np.ndarray, words: int, dense: bool) -> list[np.ndarray]:
    if dense:
        return [((keys >> np.uint64(ID_BITS * i)) & np.uint64((1 << ID_BITS) - 1)).astype(np.int64) for i in reversed(range(words))]
    wide = np.frombuffer(keys.tobytes(), ">u8").reshape(-1, words).astype(np.uint64)
    return [wide[:, i].copy().view(np.int64) for i in range(words)]


def _runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their counts) of sorted keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _ngram_counts(encoded: DataFrame, words: int, dense: bool, least: int, pairs=None) -> DataFrame:
    """(w1, .., n) of n-grams with n >= least. `pairs`: a broadcast bitmap; n-grams with two neighbours outside it are left out.

    A task sorts and counts what it holds, so that a frequent n-gram is few rows. Keys with their counts are partitioned by
    range and sorted there (Spark sorts by radix of the first 8 bytes), and runs of equal keys are summed as they stream past.
    """
    kind, width = ("<i4" if dense else "<i8"), 8 if dense else 8 * words

    def sent(held: list) -> pa.RecordBatch:
        keys, counts = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, counts = _runs(keys[order], counts[order])
        raw = keys.astype(">u8") if dense else keys
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(keys), [None, pa.py_buffer(raw.tobytes())])
        return pa.RecordBatch.from_arrays([column.cast(pa.binary()), pa.array(counts)], ["key", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_buffer(), kind)
                there = ids != 0
                n = len(ids) - words + 1
                if n <= 0:
                    continue
                ok = np.logical_and.reduce([there[i : n + i] for i in range(words)])
                if pairs is not None:
                    near = np.flatnonzero(there[:-1] & there[1:])
                    known = np.zeros(len(ids) - 1, bool)
                    known[near] = _has(pairs.value, _pair(ids[near].astype(np.int64).view(np.uint64), ids[near + 1].astype(np.int64).view(np.uint64)))
                    ok &= np.logical_and.reduce([known[i : n + i] for i in range(words - 1)])
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                keys = np.sort(_packed([ids[at + i].astype(np.int64) for i in range(words)], dense))
                held.append(_runs(keys, np.ones(len(keys), np.int64)))
                size += len(held[-1][0])
                if size >= HELD:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64 if dense else f"S{width}"), np.empty(0, np.int64)

        def frequent() -> pa.RecordBatch:
            some = counts >= least
            columns = [pa.array(c) for c in (*_unpacked(keys[some], words, dense), counts[some])]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            raw = batch.column(0).cast(pa.binary(width)).buffers()[1] if batch.num_rows else b""
            new = np.frombuffer(raw, ">u8" if dense else f"S{width}", batch.num_rows).astype(keys.dtype)
            k, n = np.concatenate((keys, new)), np.concatenate((counts, batch.column(1).to_numpy()))
            if not len(k):
                continue
            k, n = _runs(k, n)
            keys, counts = k[:-1], n[:-1]
            yield frequent()
            keys, counts = k[-1:], n[-1:]
        yield frequent()

    names = [*[f"w{i + 1}" for i in range(words)], "n"]
    partial = encoded.mapInArrow(frugal(part), "key binary, n bigint")
    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(frugal(whole), ", ".join(f"{c} bigint" for c in names))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), exact: products are decimals of 38 digits."""
    return F.expr(f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * 1000000) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the `top` phrases of each language, from rank 1.

    Texts, with A-Z as a-z, are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at space and tab into words. A candidate is two or
    three words of one piece that occur a >= `least` times. Cut after its first k words it scores floor(1000000 * a * a / (l * r)) by
    the counts of both parts; its lowest-scoring cut counts, of equal ones the first. A candidate inside a longer one of at
    least `percent` % of its count is dropped. Order: score, then a, both descending, then the phrase by its UTF-8 bytes. n is all words
    of the language. A null language is `und`, null and empty texts have no words, whole texts are read however long, repeated rows
    count again, an empty table gives no rows. The limit `top` is the feature; all else counts everything.

    Method: words are counted, and those with `least` occurrences get ids, by a dictionary that is broadcast while it has
    fewer than 2**ID_BITS words; beyond, ids are the words' 64-bit hashes and a bitmap tells which words have one. Rarer words end a piece, as no candidate
    holds them. n-grams of ids are packed into fixed-width keys and counted by range, sort and run length (_ngram_counts); three words
    are counted only where both pairs may be frequent (by a bitmap). Words whose hash is shared with a frequent word
    make the hash be drawn anew.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts, salt = written(word_counts(texts), "phrase-words"), 0
    while True:
        h = F.xxhash64(F.concat(F.lit(f"{salt}:"), "lang", F.lit("\0"), "word"))
        shared = counts.select(h.alias("h"), "n").groupBy("h").agg(F.count("*").alias("words"), F.max("n").alias("most"))
        if shared.where((F.col("most") >= least) & ((F.col("words") > 1) | (F.col("h") == 0))).isEmpty():
            break
        salt += 1
    common = written(counts.where(F.col("n") >= least).select("lang", "word", "n", h.alias("h")), "phrase-common")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("all")), "phrase-totals")
    n_words = common.count()
    dense = n_words < 1 << ID_BITS
    if dense:
        lookup = WordIds(np.sort(common.select("h").toArrow().column(0).to_numpy()), True)
    else:
        lookup = WordIds(_bitmap(common.select("h"), n_words, False), False)
    ids = spark.sparkContext.broadcast(lookup)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ids.value.of(batch.column(0).to_numpy())), *batch.columns[1:]], ["id", "lang", "word", "n"])

    words = common.select("h", "lang", "word", "n").mapInArrow(frugal(numbered), "id bigint, lang string, word string, n bigint")
    words = written(words, "phrase-ids")
    path = fresh_path(spark, "phrase-encoded")
    _encoded(texts, ids, salt).write.parquet(path)
    encoded = spark.read.schema("ids binary").parquet(path)
    two = written(_ngram_counts(encoded, 2, dense, least), "phrase-two")
    n_two = two.count()
    pairs = spark.sparkContext.broadcast(_bitmap(two.select("w1", "w2"), n_two, True))
    three = written(_ngram_counts(encoded, 3, dense, least, pairs), "phrase-three")
    delete(spark, path)
    discard(counts, common)

    one = lambda i: _small(words.select(F.col("id").alias(f"w{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("lang", "word", "n")]), n_words)
    pair = lambda i: _small(two.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{i + 1}"), F.col("n").alias(f"n{i}{i + 1}")), n_two)
    long = three.select("w1", "w2", "w3", F.col("n").alias("a"))
    around = long.select("a", F.explode(F.array(F.struct(F.col("w1"), F.col("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    around = around.groupBy("p.w1", "p.w2").agg(F.max("a").alias("longer"))
    short = two.join(around, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("n"), F.lit(True)))
    short = short.select("w1", "w2", F.col("n").alias("a")).join(one(1), "w1").join(one(2), "w2")
    short = short.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.struct(_score("a", "n1", "n2").alias("score"), F.lit(1).alias("k"), F.col("n1").alias("l"), F.col("n2").alias("r")).alias("cut"))
    long = long.join(pair(1), ["w1", "w2"]).join(pair(2), ["w2", "w3"]).join(one(1), "w1").join(one(2), "w2").join(one(3), "w3")
    cuts = [F.struct(_score("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "n1", "n23"), (2, "n12", "n3"))]
    long = long.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.least(*cuts).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("all").alias("n"), "cut.score")
    out = written(best, "phrases")
    discard(words, two, three, totals)
    return out
