"""Near duplicates by MinHash signatures that are joined by their Hamming distance through several indexes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, maybe_in, written
from tickloom.llm.graph import components
from tickloom.llm.hashing import differing_bits, frugal, grouped, mixed, ordered_sets, set_digests, set_signatures, shingle_hashes
from tickloom.llm.jaccard_join import unseen, verified

#: Slots of a signature, of 8 bits each; slots of a chunk; errors that a chunk may have.
SLOTS, CHUNK, ERRORS = 96, 6, 1  # one error: _first_list counts on it
CHUNKS = SLOTS // CHUNK
#: By pigeonhole, signatures that differ in at most so many slots have a chunk with at most ERRORS errors.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Least Jaccard percentage for which SLOTS and CHUNK are chosen.
LEAST_PERCENT = 80
#: Columns of the signature, a chunk each, and of the parity sketch (see hashing.set_signatures), 64 bits each.
SIGNATURE = [f"m{k}" for k in range(CHUNKS)]
PARITY = [f"s{k}" for k in range(8)]
#: Rounds after the first, of which the last one is the exact rest, and partners that each set of a list tries in the others.
ROUNDS, PROBES = 2, 3

_rng = np.random.default_rng(0x5107)
_XOR, _TIMES = (_rng.integers(0, 1 << 32, SLOTS, np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
_KEPT = np.array(list(itertools.combinations(range(CHUNK), CHUNK - ERRORS)))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SLOTS bytes for each set of members that begins at `first`: 8 bits of the least of each slot's hashes."""
    out = np.zeros((len(first), SLOTS), np.uint8)
    if len(first):
        x = (mixed(h, 0x317) >> np.uint64(32)).astype(np.uint32)
        for k in range(SLOTS):
            least = np.minimum.reduceat((x ^ _XOR[k]) * _TIMES[k], first)
            out[:, k] = (least * np.uint32(0x9E3779B1) ^ least >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(24)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of each signature, a row each: every chunk with every choice of ERRORS slots left out.

    A key holds chunk, choice and the slots that are left, so two signatures share one just where a chunk of theirs has
    at most ERRORS errors.
    """
    chunks = sig.reshape(len(sig), CHUNKS, CHUNK).astype(np.uint64)
    keys = np.zeros((len(sig), CHUNKS, len(_KEPT)), np.uint64)
    keys += np.arange(CHUNKS, dtype=np.uint64)[:, None] * np.uint64(len(_KEPT)) + np.arange(len(_KEPT), dtype=np.uint64)
    for i in range(CHUNK - ERRORS):
        keys = keys << np.uint64(8) | chunks[:, :, _KEPT[:, i]]
    return keys.reshape(len(sig), -1)


def _packed(sig: np.ndarray) -> np.ndarray:
    """Signatures as a whole number a chunk, slots in bytes from the lowest."""
    wide = np.zeros((len(sig), CHUNKS, 8), np.uint8)
    wide[:, :, :CHUNK] = sig.reshape(len(sig), CHUNKS, CHUNK)
    return wide.view("<i8")[:, :, 0]


def _set_rows(rows: DataFrame, words: int) -> DataFrame:
    """(doc, h, text) rows to doc, h, n, node, signature and parity; n is the set's size and node its digest.

    A task gives signature and parity with the first row of a node only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for row, texts in grouped(batch.column(2)):
                owner, h = shingle_hashes(texts, words)
                owner, h, first = ordered_sets(owner, h, np.zeros(len(h), np.uint16))
                n, at = np.zeros(len(texts), np.int64), np.full(len(texts), -1)
                size = np.diff(np.append(first, len(h)))
                n[owner[first]], at[owner[first]] = size, np.arange(len(first))
                node = set_digests(h, first)
                fresh = np.full(len(first), -1)
                places = unseen(node.to_pylist(), sent).to_numpy()
                fresh[places] = places
                new = np.where(at >= 0, fresh[at], -1) if len(first) else at
                there, new = (pa.array(x, mask=x < 0) for x in (at, new))
                both = [_packed(signatures(h, first)), set_signatures(h, first, len(PARITY)).view(np.int64)]
                keys = batch.slice(row, len(texts))
                columns = [keys.column(0), keys.column(1), pa.array(n), node.take(there)]
                columns += [pa.array(np.ascontiguousarray(x[:, k])).take(new) for x in both for k in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc", "h", "n", "node", *SIGNATURE, *PARITY]
    return rows.mapInArrow(frugal(read), "doc bigint, h bigint, n bigint, node binary, " + ", ".join(f"{s} bigint" for s in SIGNATURE + PARITY))


def _postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, id, n) of all sets that can link with another one."""

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.ascontiguousarray(np.stack([c.to_numpy() for c in batch.columns[2:]], 1)).view(np.uint8)
            keys = chunk_keys(np.ascontiguousarray(wide.reshape(-1, CHUNKS, 8)[:, :, :CHUNK]).reshape(-1, SLOTS))
            again = np.repeat(np.arange(len(keys)), keys.shape[1])
            columns = [pa.array(keys.ravel().view(np.int64)), *[pa.array(batch.column(i).to_numpy()[again]) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n"])

    able = nodes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("id", "n", *SIGNATURE)
    return able.mapInArrow(frugal(list_all), "key bigint, id bigint, n bigint")


#: The low seven bits, and the high one, of each slot of a chunk.
_LOW, _HIGH = (sum(x << 8 * i for i in range(CHUNK)) for x in (0x7F, 0x80))


def _errors(a: str, b: str) -> str:
    """Slots in which two chunks differ."""
    return f"bit_count(((({a} ^ {b}) & {_LOW}L) + {_LOW}L | ({a} ^ {b})) & {_HIGH}L)"


def _distance(a: str, b: str) -> Column:
    """Slots in which two signatures differ."""
    return F.expr(" + ".join(_errors(a + s, b + s) for s in SIGNATURE))


def _first_list(key: str, a: str, b: str) -> Column:
    """Whether the list of `key` is the first that two signatures, given as arrays of chunks, share: the first chunk with few errors, and in
    it the first choice. It is one small call, as conditions that are too long for the JVM's compiler make a join slow."""
    chunk, choice = f"cast(({key} >> {8 * (CHUNK - ERRORS)}) div {len(_KEPT)} as int)", f"(({key} >> {8 * (CHUNK - ERRORS)}) % {len(_KEPT)})"
    before = f"zip_with(slice({a}, 1, {chunk}), slice({b}, 1, {chunk}), (p, q) -> {_errors('p', 'q')} <= {ERRORS})"
    own = _errors(f"element_at({a}, {chunk} + 1)", f"element_at({b}, {chunk} + 1)")
    return F.expr(f"NOT exists({before}, e -> e) AND ({choice} = 0 OR {own} = {ERRORS})")


def _allowed(percent: int) -> int:
    """Slots in which sets over the threshold differ, but for about one pair in a million at the threshold itself."""
    p = 1 - percent / 100
    return math.ceil(SLOTS * p + 5.25 * math.sqrt(SLOTS * p * (1 - p)))


def _alike(percent: int, a: str, b: str) -> Column:
    """Length, signature and parity filters; parity is a lower bound of the sets' difference."""
    near = F.expr(f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n)")
    bits = differing_bits([a + s for s in PARITY], [b + s for s in PARITY])
    sum_ = F.expr(f"{100 - percent} * ({a}n + {b}n)")
    return near & ((100 + percent) * bits <= sum_) & (_distance(a, b) <= _allowed(percent))


def _screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs of ids (a, b) the nodes (a, b) of those that pass all filters."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("node").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in ("n", *SIGNATURE, *PARITY)])
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(_alike(percent, "a_", "b_"))
    return both.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).where("a < b")


def _drawn(posts: DataFrame, turn: int) -> DataFrame:
    """(key, ys): the sets of each list that have the lowest hashes in PROBES orders."""
    unit = F.struct("id", "n", "comp").alias("u")
    order = lambda k: F.struct(F.xxhash64(F.lit(turn * PROBES + k), "id").alias("o"), unit)
    best = posts.groupBy("key").agg(*[F.min(order(k)).alias(f"p{k}") for k in range(PROBES)])
    return best.select("key", F.array_distinct(F.array(*[f"p{k}.u" for k in range(PROBES)])).alias("ys"))


def _tried(posts: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Pairs of ids (a, b), a < b, of each set of a list with those drawn of it in other components, as far as lengths let them link."""
    both = posts.join(drawn, "key").withColumn("y", F.explode("ys")).where(F.col("comp") != F.col("y.comp"))
    near = 100 * F.least("n", "y.n") >= percent * F.greatest("n", "y.n")
    return both.where(near).select(F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b"))


def _joined(lists: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Postings with their component, of lists that hold more than one."""
    at = nodes.select("id", "node").join(comps, "node", "left").select("id", F.coalesce("comp", "node").alias("comp"))
    posts = written(lists.select("key", "id", "n").join(at, "id"), "minhash-open")
    spread = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    out = written(posts.join(spread, "key", "left_semi"), "minhash-open")
    discard(posts)
    return out


def _rest(posts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of ids (a, b) of all sets of one list in two components that pass all filters, by list and class of size.

    The members of a list's largest component are not joined with each other, so a list of one large component and a few other sets
    costs its length for each of these. A pair comes from the first list that both share.
    """
    sizes = posts.groupBy("key", "comp").agg(F.count("*").alias("members"))
    main = sizes.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    full = posts.join(main, "key").join(nodes.select("id", *SIGNATURE, *PARITY), "id").withColumn("in_main", F.col("comp") == F.col("main"))
    level = F.floor(F.log(F.col("n")) / (1.0001 * math.log(100 / percent))).cast("int")
    full = full.withColumn("chunks", F.array(*SIGNATURE))
    kept = ("id", "n", "comp", "in_main", "chunks", *SIGNATURE, *PARITY)
    y = full.select("key", level.alias("level"), *kept).alias("y")
    x = full.where("NOT in_main").select("key", F.explode(F.array(level - 1, level, level + 1)).alias("level"), *kept).alias("x")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.level") == F.col("y.level"))
    once = F.col("y.in_main") | (F.col("x.id") < F.col("y.id"))
    fresh = _first_list("x.key", "x.chunks", "y.chunks")
    near = x.join(y, same & once & (F.col("x.comp") != F.col("y.comp")) & _alike(percent, "x.", "y.") & fresh)
    return near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def minhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, node) of every row: components of rows by their sets of word shingles.

    Rows link where their sets have Jaccard >= percent / 100, confirmed on whole sets; `percent` is LEAST_PERCENT or more. component_id is
    the least `key` (an integer) that is reachable by links. Rows with equal sets are one node. A row without words (null,
    empty or white text) has no shingles, links with nothing and is its own component; a null key comes after others and a component
    of null keys has a null id. Repeated rows stay, and rows of one key with different texts are apart. Very long texts are
    read in whole. An empty table gives no rows.

    Method: a set has a signature of SLOTS slots, each 8 bits of the least hash of its members in that slot. Signatures are cut into
    CHUNKS chunks, and a set is listed under each chunk with any ERRORS slots left out. So all pairs whose signatures differ in
    at most GUARANTEED slots share a list; a pair of Jaccard 0.8 differs in 19 on average, in more than that once in some 600, and
    then still shares a list but for one in ten million. Of two sets of a list the sizes, the slots (_allowed) and a parity
    sketch must allow a link; then whole sets are read from the texts and compared.
    In each list sets first try two others of it, then PROBES others, which joins most of what belongs together; after ROUNDS rounds all
    pairs of two components of a list are tried. So no link between components is lost, and m near copies cost about m comparisons and not m squared.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"signatures are made for {LEAST_PERCENT} % or more")
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    wide = written(_set_rows(rows, words), "minhash-rows")
    sketch = [F.max(c).alias(c) for c in ("n", *SIGNATURE, *PARITY)]
    nodes = wide.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.min("h").alias("h"), *sketch)
    nodes = written(nodes.withColumn("id", F.xxhash64("node")), "minhash-nodes")
    rows = written(wide.select("doc", "h", "n", "node"), "minhash-rows")
    discard(wide)

    posts = _postings(nodes, percent)
    # Ids are hashes, so the least and the most of a list are two of it drawn at random.
    ends = posts.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), (F.count("*") > 2).alias("more")).where("lo < hi")
    ends = written(ends, "minhash-ends")
    two, more = ends.where("NOT more").select(F.col("lo").alias("a"), F.col("hi").alias("b")), ends.where("more")
    lists = written(maybe_in(posts, more, "key").join(more.drop("more"), "key"), "minhash-lists")
    tried = lists.select("id", F.explode(F.array("lo", "hi")).alias("y")).where("id != y").select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b"))
    pairs = two.union(tried)
    pairs = written(_screened(pairs, nodes, percent), "minhash-pairs")
    found = verified(pairs, nodes, texts, words, percent)
    discard(ends, pairs)
    comps = components(found)
    discard(found)

    for turn in range(1, ROUNDS + 1):
        still = _joined(lists, comps, nodes)
        if turn == ROUNDS:
            pairs = _rest(still, nodes, percent)
        else:
            pairs = _tried(still, _drawn(still, turn), percent)
        pairs = written(_screened(pairs, nodes, percent), "minhash-pairs")
        if not pairs.isEmpty():
            found, old = verified(pairs, nodes, texts, words, percent), comps
            comps = components(old.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found))
            discard(found, old)
        discard(still, pairs)
    discard(lists)

    at = nodes.select("node", "doc").join(comps, "node", "left")
    ids = at.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc").alias("least"))
    at = written(at.join(ids, "comp", "left").select("node", F.coalesce("least", "doc").alias("component")), "minhash-ids")
    discard(nodes, comps)
    named = [F.col("doc").alias("doc_id"), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles")]
    worded = rows.where("n > 0").join(at, "node").select(*named, F.col("component").alias("component_id"), "node")
    bare = rows.where("n = 0").select(*named, F.col("doc").alias("component_id"), F.lit(None).cast("binary").alias("node"))
    return worded.unionByName(bare)
