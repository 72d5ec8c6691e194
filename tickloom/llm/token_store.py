"""Token ids in a compact container: one id array a shard, document boundaries in Elias-Fano code.

A shard is one row of a Parquet table, so that Spark's own writer commits it to whatever store the path names:

    part, seq          ascending order of shards (range partition, then shard within it)
    first_doc, n_docs  not stored: documents are counted, never numbered globally, until they are read
    doc_ids            the documents' ids, ascending, nulls first
    width, ids         bytes a token (2 up to 65,536 ids, else 4), and the concatenated ids, little-endian
    before             ids in earlier shards of the part
    low_bits, low      Elias-Fano: lower bits of each document's end, packed
    high               Elias-Fano: upper bits in unary, one set bit a document
    samples            select samples: bit position of every SAMPLE-th set bit of `high`
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.hashing import WHITE, frugal, grouped

#: Set bits between two select samples.
SAMPLE = 64
#: Tokens and documents after which a shard is closed; one longer document is a shard of its own.
SHARD_TOKENS = 1_000_000
SHARD_DOCS = 50_000
#: Bytes of text that are encoded in one go.
GROUP_BYTES = 4_000_000
#: Chunks that the library codes as one text, and a chunk of one token that parts them.
JOINED = 200
SEPARATOR = b"0"

#: Parts up to which the table with one row a part is broadcast (some 16 bytes each); more of them are joined by shuffling.
BROADCAST_PARTS = 1_000_000

_SHARD = (
    "part int, seq int, before bigint, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, width int, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)


class EliasFano:
    """A non-decreasing sequence below `bound` in about 2 + log2(bound / n) bits a value, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        at = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        packed = [np.packbits(x, bitorder="little").tobytes() for x in (low.ravel(), bits)]
        return cls(n, low_bits, *packed, at[::SAMPLE].astype("<u4").tobytes())

    def _low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def block(self, first: int) -> np.ndarray:
        """Values first, first + 1, ... of one sample (`first` a multiple of SAMPLE): bits of `high` from there to the next sample."""
        start, k = int(self.samples[first // SAMPLE]), first // SAMPLE + 1
        end = int(self.samples[k]) if k < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start >> 3 : -(-end // 8)], bitorder="little")
        at = start - (start & 7) + np.flatnonzero(bits)
        i = np.arange(first, min(first + SAMPLE, self.n))
        return ((at[at >= start][: len(i)] - i) << self.low_bits) + self._low_part(i)

    def select(self, i: int) -> int:
        """Value number i: from the sample before it, bytes of `high` are skipped by their counts of set bits."""
        start = int(self.samples[i // SAMPLE])
        todo, byte = i % SAMPLE, start >> 3
        bits = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (ones := bits.bit_count()) <= todo:
            todo -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(todo):
            bits &= bits - 1
        at = byte * 8 + (bits & -bits).bit_length() - 1
        return ((at - i) << self.low_bits) + int(self._low_part(np.array([i]))[0])


class ChunkEncoder:
    """Ids of texts by the tokenizers library, remembered by white-space-free chunk.

    For tokenizers that drop white space and never look across it (as word_bpe_49k.json does: its pre-token pattern
    matches no white space, and normalisation to NFC and lower case works within a chunk), the ids of a text are those
    of its chunks in turn. Chunks are cut at ASCII white space only. The distinct chunks of some texts are found by
    Arrow's dictionary encoding, and their ids are laid out by index.
    """

    def __init__(self, path: str, remembered: int = 100_000, longest: int = 48):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core; the library's threads would take more
        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = next(c for c in "HIL" if array(c).itemsize == self.width)
        # Where case is dropped and signs are apart from letters and digits before them, chunks can be folded (_folded).
        signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        self.folds = all(self._ids(f"Ab1{p} Zz{p}Yx \xc9\xe7Z\u0159{p}") == self._ids(f"ab1 {p} zz {p}yx \xe9\xe7z\u0159 {p}") for p in signs)
        # Many chunks are coded as one text: a run of letters ends with the token that has the vocabulary's suffix of words, and
        # others are parted by a token that only SEPARATOR gives.
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.last, self.parting = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.last[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.parting[self._ids(SEPARATOR.decode())] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.remembered, self.longest = remembered, longest

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Give the memory back: a worker that waits for its next task holds no chunks."""
        self.known, self.before = {}, {}

    def pack(self, ids: list[int]) -> bytes:
        """Ids as little-endian bytes; an array of the standard library takes a few numbers faster than numpy does."""
        made = array(self.code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of distinct chunks. What is remembered has two ages: the old one goes when the young one is full."""
        out = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(out) if x is None]
        if self.before:
            olds = list(map(self.before.get, [chunks[i] for i in new]))
            for i, old in zip(new, olds):
                if old is not None:
                    out[i] = self.known[chunks[i]] = old
            new = [i for i, old in zip(new, olds) if old is None]
        letters = [i for i in new if chunks[i].isalpha()]
        others = [i for i in new if not chunks[i].isalpha()]
        for code, those in ((self._code_letters, letters), (self._code_others, others)):
            for at in range(0, len(those), 20_000):
                some = those[at : at + 20_000]
                names = [chunks[i] for i in some]
                packed = code(names)
                for i, x in zip(some, packed):
                    out[i] = x
                self.known.update((c, x) for c, x in zip(names, packed) if len(c) <= self.longest)
        if len(self.known) > self.remembered:
            self.before, self.known = self.known, {}
        return out

    def _code_letters(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of runs of ASCII letters."""
        return self._code_joined(chunks, b"\n", self.last, 1) or self._code_each(chunks)

    def _code_others(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of any chunks. What may hold the separator or a special token is coded by itself."""
        odd = [SEPARATOR in c or b"<|" in c for c in chunks]
        common = [c for c, x in zip(chunks, odd) if not x]
        rare = iter(self._code_each([c for c, x in zip(chunks, odd) if x]))
        found = iter(self._code_joined(common, b"\n" + SEPARATOR + b"\n", self.parting, 0) or self._code_each(common))
        return [next(rare if x else found) for x in odd]

    def _code_each(self, chunks: list[bytes]) -> list[bytes]:
        coded = self.library.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [self.pack(e.ids) for e in coded]

    def _code_joined(self, chunks: list[bytes], between: bytes, marks: np.ndarray, own: int) -> list[bytes]:
        """Packed ids of chunks, JOINED of them coded as one text with `between` them. Each chunk ends at the next id that is in
        `marks`, which is its own or not; nothing is returned if such ids are not as many as the chunks."""
        texts = [between.join(chunks[at : at + JOINED]).decode("utf-8", "replace") for at in range(0, len(chunks), JOINED)]
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        out = []
        for at, e in zip(range(0, len(chunks), JOINED), coded):
            ids = np.array(e.ids, f"<u{self.width}")
            end = np.flatnonzero(marks[ids])
            if not own:
                end = np.append(end, len(ids))
            if len(end) != len(chunks[at : at + JOINED]):
                return []
            packed, start = ids.tobytes(), np.concatenate(([0], end[:-1] + 1)) * self.width
            out += [packed[a:z] for a, z in zip(start.tolist(), ((end + own) * self.width).tolist())]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text among them)."""
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        white = WHITE[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], white, [True]))))
        start, size = edges[::2], edges[1::2] - edges[::2]
        if self.folds:
            data, start, size = _folded(raw, data, start, size)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[~white])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), buffers).dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), f"<u{self.width}")
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        index = coded.indices.to_numpy()
        count = each[index]
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat((np.cumsum(each) - each)[index] - ends[:-1], count) + np.arange(ends[-1])
        return flat[at], ends[np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))]


_ALNUM, _SIGN, _PLAIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN[33:127] = ~_ALNUM[33:127]
#: First bytes of ASCII and of U+00C0 to U+017F: none of these is a mark that composes with what is before it.
_PLAIN[[*range(128), 0xC3, 0xC4, 0xC5]] = True


def _folded(raw: bytes, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that differ in capitals or in signs after them made one: (data, start, size) of more, shorter chunks.

    A-Z and the capitals of Latin-1 become small where ASCII or U+00C0 to U+017F follows, so that no mark can compose with the
    letter. A chunk is cut where an ASCII sign follows an ASCII letter or digit or a letter of U+00C0 to U+017F. Texts that may hold a
    special token (<|...|>) stay as they are.
    """
    if b"<|" in raw:
        return data, start, size
    capital = (data >= 65) & (data <= 90)
    letter = _ALNUM[data]
    if not raw.isascii():
        # Second bytes of two after C3 to C5, but for the signs of multiplication and division, and I with a dot, whose dot becomes a mark.
        second = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)) + 1
        first, byte = data[second - 1], data[second]
        worded = ((first != 0xC3) | ((byte != 0x97) & (byte != 0xB7))) & ((first != 0xC4) | (byte != 0xB0))
        letter[second[worded]] = True
        capital[second[worded & (first == 0xC3) & (byte <= 0x9E)]] = True
        capital[:-1] &= _PLAIN[data[1:]]
    cut = np.flatnonzero(letter[:-1] & _SIGN[data[1:]]) + 1
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[start] = begins[cut] = ends[start + size] = ends[cut] = True
    start = np.flatnonzero(begins)
    return data + capital * np.uint8(32), start, np.flatnonzero(ends) - start


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_token_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Encode whole texts and write shards to `path` in ascending `key` order (nulls first; ties by content).

    Null and empty texts are documents of `end_id` alone. Repeated rows are repeated documents. An empty table gives
    a table without shards. Other columns of `docs` are not written. Documents are range-partitioned by key once,
    as text; encoding and packing follow in the sorted partition, and a task holds one shard at a time. A text longer
    than a shard is a shard of its own.
    """
    names = [c.split()[0] for c in _SHARD.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 3]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        end = encoder.pack([end_id])
        part, seq, before, size, keys, ids = 0, 0, 0, 0, [], []

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(b) // encoder.width for b in ids])
            ef = EliasFano.of(ends)
            row = [part, seq, before, len(ids), int(ends[-1]), keys, encoder.width, b"".join(ids)]
            row += [ef.low_bits, *[x.tobytes() for x in (ef.low, ef.high, ef.samples)]]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for row, texts in grouped(batch.column(1), GROUP_BYTES):
                flat, ends = encoder.encode(texts)
                at = 0
                for k, z in zip(batch.column(0).slice(row, len(texts)).to_pylist(), ends.tolist()):
                    b = flat[at:z].tobytes() + end
                    at = z
                    if ids and (size + len(b) > SHARD_TOKENS * encoder.width or len(ids) >= SHARD_DOCS):
                        yield shard()
                        before += size // encoder.width
                        seq, size, keys, ids = seq + 1, 0, [], []
                    keys.append(k)
                    ids.append(b)
                    size += len(b)
        if ids:
            yield shard()
        encoder.forget()

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    ranged = rows.repartitionByRange(F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    shards = ranged.select("k", "t", F.spark_partition_id().alias("p")).mapInArrow(frugal(pack), _SHARD)
    shards.write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `base`: ids before the shard, from a running sum over parts. Shards are not shuffled.

    One row a part is summed and sorted; more than BROADCAST_PARTS parts are joined by shuffling.
    """
    shards = spark.read.parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("part_tokens").over(running), F.lit(0)).alias("part_base"))
    few = shards.select("part").distinct().count() <= BROADCAST_PARTS
    joined = shards.join(F.broadcast(bases) if few else bases, "part")
    return joined.withColumn("base", F.col("part_base") + F.col("before"))


def map_documents(shards: DataFrame, make: Callable[[np.ndarray], object], kind: pa.DataType, sql_kind: str, into: str) -> DataFrame:
    """One row a document of read shards: doc_id, start, n_tokens and `make` of its ids (numpy) in column `into`.

    Offsets come from the select structure, SAMPLE documents at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ef = EliasFano(s["n_docs"], s["low_bits"], s["low"], s["high"], s["samples"])
                ids, at, starts, sizes, made = np.frombuffer(s["ids"], f"<u{s['width']}"), 0, [], [], []
                for first in range(0, s["n_docs"], SAMPLE):
                    for end in ef.block(first).tolist():
                        starts.append(at + s["base"])
                        sizes.append(end - at)
                        made.append(make(ids[at:end]))
                        at = end
                columns = [pa.array(c, pa.int64()) for c in (s["doc_ids"], starts, sizes)]
                yield pa.record_batch([*columns, pa.array(made, kind)], ["doc_id", "start", "n_tokens", into])

    some = shards.select("base", "doc_ids", "n_docs", "width", "ids", "low_bits", "low", "high", "samples")
    return some.mapInArrow(frugal(read), f"doc_id bigint, start bigint, n_tokens bigint, {into} {sql_kind}")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
