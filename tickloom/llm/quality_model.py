"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, summed_vectors, texts_of
from tickloom.llm.hashing import frugal

#: Hashed vocabulary: words share 2**14 rows of DIM numbers, so tables have one size whatever the corpus.
BUCKETS = 1 << 14
DIM = 32
#: Non-zero entries of an index vector, neighbours on each side that count as context.
NONZERO = 2
REACH = 2
#: Pooled numbers of a document.
FEATURES = 2 * DIM + 3
#: Labelled documents that the network is fitted on at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
#: Buckets in one row of a task's partial sums; tokens handled in one go; words a worker remembers.
_ROWS = 256
_GROUP_TOKENS = 100_000
_REMEMBERED = 150_000
#: Words that a worker may keep from one batch to the next.
_KEPT = 50_000

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]")


class _Buckets(dict):
    """Bucket of a token; words in capitals are words of their own, all other case is folded."""

    def __missing__(self, token: bytes) -> int:
        shape = b"^" if len(token) > 1 and token.isupper() else b""
        self[token] = bucket = zlib.crc32(shape + token.lower()) & (BUCKETS - 1)
        return bucket


_bucket = _Buckets()


def _ids(text: str) -> np.ndarray:
    if len(_bucket) > _REMEMBERED:
        _bucket.clear()
    found = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_bucket.__getitem__, found), np.int32, len(found))


def _groups(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Ids of consecutive texts, in groups of about _GROUP_TOKENS."""
    group, size = [], 0
    for text in texts_of(column):
        group.append(_ids(text))
        size += len(group[-1])
        if size >= _GROUP_TOKENS:
            yield group
            group, size = [], 0
    if group:
        yield group
    if len(_bucket) > _KEPT:
        _bucket.clear()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's sparse ternary index vector; the row after the last is for no word."""
    rng = np.random.default_rng(7)
    place = np.stack([rng.permutation(DIM)[:NONZERO] for _ in range(BUCKETS + 1)]).astype(np.int32)
    sign = rng.choice(np.array([-1.0, 1.0]), (BUCKETS + 1, NONZERO))
    sign[BUCKETS] = 0
    return place, sign


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing context sums over all documents: BUCKETS x DIM, one row of sums a bucket.

    Every task adds up its documents in a table of fixed size, the tables are summed by blocks of rows in a shuffle,
    and what comes to the driver is the one summed table (4 MB), however large the corpus.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros((BUCKETS + 1) * DIM)
        gap = np.full(REACH, BUCKETS, np.int32)
        for batch in batches:
            for group in _groups(batch.column(0)):
                ids = np.concatenate([x for g in group for x in (g, gap)])
                for d in range(1, REACH + 1):
                    for word, context in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                        row = word * DIM
                        for j in range(NONZERO):
                            total += np.bincount(row + place[context, j], sign[context, j], len(total))
        blocks = total[: BUCKETS * DIM].astype("<i4").reshape(-1, _ROWS * DIM)
        used = np.flatnonzero(blocks.any(1))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "sums"])

    parts = docs.select(text).mapInArrow(frugal(add), "block int, sums binary")
    out = np.zeros((BUCKETS // _ROWS, _ROWS * DIM), np.int64)
    for r in summed_vectors(parts, "block", "sums").collect():
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    return out.reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit rows of damped context sums plus the word's own index vector; a last row of zeros is for no word."""
    place, sign = index_vectors()
    own = np.zeros((BUCKETS + 1, DIM))
    for j in range(NONZERO):
        own[np.arange(BUCKETS + 1), place[:, j]] += sign[:, j]
    damped = np.sign(sums) * np.sqrt(np.abs(sums))
    damped /= np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)
    out = own
    out[:BUCKETS] += damped * 1.5
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def _pool(group: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Per document: mean and spread of its word vectors, the mean's norm, the mean cosine of a word and the next,
    and the log of its length. No words: zeros."""
    size = np.array([len(g) for g in group])
    out = np.zeros((len(group), FEATURES), np.float32)
    some = np.flatnonzero(size)
    if len(some):
        x = vectors[np.concatenate([group[i] for i in some])]
        start = np.r_[0, np.cumsum(size[some])[:-1]]
        n = size[some][:, None]
        mean = np.add.reduceat(x, start, axis=0) / n
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(x * x, start, axis=0) / n - mean * mean, 0))
        out[some, 2 * DIM] = np.linalg.norm(mean, axis=1)
        near = np.r_[np.einsum("ij,ij->i", x[:-1], x[1:]), 0.0]
        near[start[1:] - 1] = 0
        out[some, 2 * DIM + 1] = np.add.reduceat(near, start) / np.maximum(size[some] - 1, 1)
        out[some, 2 * DIM + 2] = np.log1p(size[some]) / 10
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden tanh layer, a logistic output with a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 11) -> Network:
    """Adam on cross-entropy over four fifths of the rows; the temperature is fitted on the last fifth.

    Without rows of both labels the score is the share of label 1 (0.5 without rows).
    """
    width = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[used].mean(0), x[used].std(0) + 1e-3, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.005 * (1 - epoch / epochs) + 0.0002
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at : at + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - y[rows]) / len(rows)
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(held):
        raw, t = net.logits(x[held]), np.exp(np.linspace(-1.5, 2.0, 71))
        p = np.clip(1 / (1 + np.exp(-np.clip(raw / t[:, None], -60, 60))), 1e-9, 1 - 1e-9)
        net.temperature = float(t[np.argmin(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean(1))])
    return net


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """`docs` with a double column `quality_score` from 0 to 1, higher where label 1 is likelier.

    Word vectors come from every document. The network is fitted on at most `max_train_rows` labelled documents, those
    whose ids have the smallest hash among ids outside fold 0 (fold_of); ids with several labels count with
    the least, ids with several texts with one of them. Labels or ids that are null, and labels of absent
    documents, are left out. Only the text is an input of a score: empty and null texts get the score of a document
    without words, equal texts get equal scores, and repeated rows stay. A column called `quality_score` is replaced.
    Three passes over the texts; the shuffles carry fixed-size sums and the bounded training rows only.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(context_sums(docs, text)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row.tobytes() for group in _groups(batch.column(2)) for row in _pool(group, vectors.value)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["k", "y", "x"])

    known = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold_of("k") != 0))
    known = known.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_train_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k").select("k", "y", "t")
    kind = dict(rows.dtypes)["k"]
    sample = rows.mapInArrow(frugal(features), f"k {kind}, y double, x binary").groupBy("k").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    train = sorted(sample.collect(), key=lambda r: str(r["k"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in train], np.float64).reshape(-1, FEATURES)
    net = fit_network(x, np.array([r["y"] for r in train]))

    carried = [c for c in docs.columns if c.lower() != "quality_score"]
    source = free_name(docs, "scored_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [net.score(_pool(group, vectors.value).astype(np.float64)) for group in _groups(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(made) if made else [], pa.float64())], [*carried, "quality_score"])

    return docs.select(*carried, F.col(text).alias(source)).mapInArrow(frugal(score), f"{schema}{', ' if schema else ''}`quality_score` double")
