"""Near duplicates by a grouped prefix join on word-shingle sets, exact at its threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import counter_of, discard, free_name, maybe_in, rarity_counts, settle_driver, surely_out, written
from tickloom.llm.graph import components
from tickloom.llm.hashing import (
    differing_bits, frugal, grouped, ordered_sets, rarity_ranks, set_digests, set_signatures, shingle_hashes,
)

#: Columns of a set's signature, 64 bits each.
SIGNATURE = [f"s{k}" for k in range(8)]
#: Posting lists of up to so many entries are paired in full at once; longer ones are probed first.
SHORT = 8
#: Partners that each group of a long list tries in a round of probing, and rounds, before the exact rest.
PROBES = 6
ROUNDS = 2
#: Sets that a task remembers to have sent.
_REMEMBERED = 1_000_000


def _linked(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of (a, b, ta, tb) pairs of texts with words those (a, b) whose whole sets have Jaccard >= percent / 100."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, group in grouped(batch.column(2)):
                pair = batch.slice(row, len(group))
                _, others = zip(*grouped(pair.column(3)))
                texts = [t for both in zip(group, (t for some in others for t in some)) for t in both]
                owner, h = shingle_hashes(texts, words)
                owner, h, first = ordered_sets(owner, h, np.zeros(len(h), np.uint16))
                both = np.diff(np.append(first[::2], len(h)))
                union = np.bincount(ordered_sets(owner // 2, h, np.zeros(len(h), np.uint16))[0], minlength=len(group))
                linked = pa.array(np.flatnonzero(100 * (both - union) >= percent * union))
                yield pa.RecordBatch.from_arrays([pair.column(0).take(linked), pair.column(1).take(linked)], ["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(frugal(read), "a binary, b binary")


def unseen(keys: list[bytes], sent: set[bytes]) -> pa.Array:
    """Places of the keys that are not in `sent`, each once; they are added to it."""
    out = []
    for i, k in enumerate(keys):
        if k not in sent:
            sent.add(k)
            out.append(i)
    if len(sent) > _REMEMBERED:
        sent.clear()
    return pa.array(out, pa.int64())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64), pa.int64()))


def _set_rows(rows: DataFrame, ranks, words: int, percent: int) -> DataFrame:
    """(doc, h, text) rows to doc, h, n, node, gid, prefix and signature of their sets.

    n is the set's size and node its digest; gid names the group of sets with one size and prefix. A task gives prefix and
    signature with the first row of a node only. Sets that are too small to link with any other have no prefix.
    """
    names = ["doc", "h", "n", "node", "gid", "prefix", *SIGNATURE]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, sent = ranks.value, set()
        for batch in batches:
            for row, texts in grouped(batch.column(2)):
                owner, h = shingle_hashes(texts, words)
                owner, h, first = ordered_sets(owner, h, rare[counter_of(h)])
                size = np.diff(np.append(first, len(h)))
                keep = size - -(-percent * size // 100) + 1
                some = h[np.arange(len(h)) - np.repeat(first, size) < np.repeat(keep, size)]
                starts = np.cumsum(keep) - keep
                gid = np.add.reduceat(_mixed_prefix(some), starts) * np.uint64(2) + size.astype(np.uint64) if len(size) else some
                node = set_digests(h, first)
                n, at = np.zeros(len(texts), np.int64), np.full(len(texts), -1)
                n[owner[first]], at[owner[first]] = size, np.arange(len(first))
                fresh = np.full(len(first), -1)
                places = unseen(node.to_pylist(), sent).to_numpy()
                fresh[places] = places
                lone = np.where(100 * size >= percent * (size + 1), fresh, -1)
                new, listed = (np.where(at >= 0, x[at], -1) if len(first) else at for x in (fresh, lone))
                there, new, listed = (pa.array(x, mask=x < 0) for x in (at, new, listed))
                sig = set_signatures(h, first, len(SIGNATURE)).view(np.int64)
                keys = batch.slice(row, len(texts))
                columns = [keys.column(0), keys.column(1), pa.array(n), node.take(there)]
                columns += [pa.array(gid.view(np.int64)).take(there), _lists(some, keep).take(listed)]
                columns += [pa.array(np.ascontiguousarray(sig[:, k])).take(new) for k in range(len(SIGNATURE))]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc bigint, h bigint, n bigint, node binary, gid bigint, prefix array<bigint>"
    return rows.mapInArrow(frugal(read), f"{kinds}, {', '.join(f'{s} bigint' for s in SIGNATURE)}")


def _mixed_prefix(h: np.ndarray) -> np.ndarray:
    """Scrambled prefix members; their sum names the prefix."""
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) ^ (h << np.uint64(7))


def _can_link(percent: int) -> Column:
    """Length filter, and positional filter at the first shingle that both x and y have (0-based `pos`)."""
    near = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    return F.expr(f"{near} AND {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)")


def _alike(percent: int, a: str = "a_", b: str = "b_") -> Column:
    """Signature filter: sets over the threshold differ in at most (100 - percent) / (100 + percent) of both sizes' sum."""
    bits = differing_bits([a + s for s in SIGNATURE], [b + s for s in SIGNATURE])
    return (100 + percent) * bits <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _side(table: DataFrame, side: str, key: str, *others: str) -> DataFrame:
    """A table with signatures, its columns named for one side of a pair."""
    named = [F.col(c).alias(f"{side}_{c}") for c in ("n", *others, *SIGNATURE)]
    return table.select(F.col(key).alias(side), *named)


def _screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of distinct node pairs (a, b) those that pass length and signature filters."""
    both = pairs.join(_side(nodes, "a", "node"), "a").join(_side(nodes, "b", "node"), "b")
    near = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return both.where(near & _alike(percent)).select("a", "b")


def _fewest(pairs: DataFrame) -> DataFrame:
    """Of (a, b) node pairs one for each b, with the least a: enough to join most of what belongs together."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Of (a, b) node pairs those that lie in two components."""
    at = lambda s: comps.select(F.col("node").alias(s), F.col("comp").alias(f"c{s}"))
    both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of (a, b) node pairs those with 100 * intersection >= percent * union, by whole sets, which are read from texts.

    Texts are sent, one of each node, and not sets: a set of 64-bit hashes is longer than its text and does not compress.
    """
    some = written(pairs.distinct(), "near-pairs")
    named = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
    wanted = written(nodes.join(named, "node", "left_semi").select("node", "h"), "near-wanted")
    whole = maybe_in(texts, wanted, "h").groupBy("h").agg(F.min("t").alias("t")).join(wanted, "h")
    whole = written(whole.select("node", "t"), "near-texts")
    side = lambda x: whole.select(F.col("node").alias(x), F.col("t").alias(f"t{x}"))
    found = written(_linked(some.join(side("b"), "b").join(side("a"), "a"), words, percent), "near-links")
    discard(some, wanted, whole)
    settle_driver(pairs.sparkSession)
    return found


def _units(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """(gid, comp, rep, members): what of a group lies in one component, its least node, and whether there are more."""
    return _members(nodes, comps).groupBy("gid", "comp").agg(F.min("node").alias("rep"), F.count("*").alias("members"))


def _members(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    at = nodes.select("node", "gid").join(comps, "node", "left")
    return at.select("node", "gid", F.coalesce("comp", "node").alias("comp"))


def _open(posts: DataFrame) -> DataFrame:
    """Of postings with `comp` those in lists that hold more than one component."""
    spread = posts.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return posts.join(spread.where("lo < hi").select("token"), "token", "left_semi")


def _probed(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (x, y) of postings: each with PROBES others of its list, drawn by hash, as far as filters let them through."""
    unit = F.struct("gid", "rep", "comp", "n", "pos").alias("u")
    drawn = lambda k: F.min(F.struct(F.xxhash64(F.lit(turn * PROBES + k), "rep").alias("o"), unit))
    best = posts.groupBy("token").agg(*[drawn(k).alias(f"p{k}") for k in range(PROBES)])
    tried = best.select("token", F.array_distinct(F.array(*[f"p{k}.u" for k in range(PROBES)])).alias("ys"))
    pairs = posts.join(tried, "token").select(unit.alias("x"), F.explode("ys").alias("y"))
    return pairs.where((F.col("x.comp") != F.col("y.comp")) & _can_link(percent))


def _rest(big: DataFrame, wide: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Node pairs of all groups that share a long list, or are in `wide` (ga, gb), or are one group, in two components.

    Lists are joined by list and class of size: sets over the threshold lie in one class or in neighbouring ones. Signatures
    are those of one node, so they filter where both sides have one.
    """
    units = written(_units(nodes, comps), "near-units")
    posts = _open(big.join(units, "gid")).join(nodes.select(F.col("node").alias("rep"), *SIGNATURE), "rep")
    level = F.floor(F.log(F.col("n")) / (1.0001 * math.log(100 / percent))).cast("int")
    least = F.struct("n", "gid", "comp").alias("o")
    kept = ("n", "pos", (F.col("members") > 1).alias("several"), *SIGNATURE)
    y = posts.select("token", level.alias("level"), least, *kept).alias("y")
    x = posts.select("token", F.explode(F.array(level, level + 1)).alias("level"), least, *kept).alias("x")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.level") == F.col("y.level"))
    apart = (F.col("x.o") < F.col("y.o")) & (F.col("x.o.comp") != F.col("y.o.comp"))
    alike = F.col("x.several") | F.col("y.several") | _alike(percent, "x.", "y.")
    near = x.join(y, same & apart & _can_link(percent) & alike)
    named = [F.col(f"{s}.o.{c}").alias(f"{c[0]}{t}") for s, t in (("x", "a"), ("y", "b")) for c in ("gid", "comp")]
    pairs = near.select(*named)
    at = lambda t: units.select(F.col("gid").alias(f"g{t}"), F.col("comp").alias(f"c{t}"))
    pairs = pairs.union(wide.join(at("a"), "ga").join(at("b"), "gb").where("ca != cb").select("ga", "ca", "gb", "cb"))
    split = units.groupBy("gid").agg(F.count("*").alias("parts")).where("parts > 1").select("gid")
    split = units.join(split, "gid", "left_semi")
    both = split.alias("x").join(split.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.comp") < F.col("y.comp")))
    inside = both.select(F.col("x.gid").alias("ga"), F.col("x.comp").alias("ca"), F.col("y.gid").alias("gb"), F.col("y.comp").alias("cb"))
    members = _members(nodes, comps)
    a = members.select(F.col("node").alias("a"), F.col("gid").alias("ga"), F.col("comp").alias("ca"))
    b = members.select(F.col("node").alias("b"), F.col("gid").alias("gb"), F.col("comp").alias("cb"))
    all_pairs = pairs.union(inside).distinct().join(a, ["ga", "ca"]).join(b, ["gb", "cb"])
    found = written(_screened(all_pairs.select("a", "b"), nodes, percent), "near-rest")
    discard(units)
    return found


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, node, comp) of every row: components of rows by shingle sets.

    Rows link where their sets have Jaccard >= percent / 100. component_id is the least `key` (an integer) that is
    reachable by links. Rows with equal sets are one node. A row without words (null, empty or white text) has no
    shingles, links with nothing and is its own component; a null key sorts after others and a component of null keys has a
    null id. Rows that repeat stay; rows of one key with different texts are apart. So component_id does not name a
    component where keys are null or repeat; `comp` does (a node of it, null without words). Very long texts are read in
    whole. An empty table gives no rows.

    Method: shingles are ordered rare first; two sets that link share a shingle among their first n - needed + 1, the
    prefix. Sets of equal size and prefix are one group, and a posting list has a shingle's groups. Shingles of one group
    alone leave before any list is made. Pairs of groups are filtered by length, position and signature (a lower bound
    of the sets' difference), and what remains is expanded to members and verified by whole sets. Short lists are
    paired in full. In a long list each group first tries PROBES others, ROUNDS times, which joins most of what belongs together;
    then all its pairs of two components are tried. Of the first pairs one for each set is verified, then those of two components. So no link between components is lost, and a list of m near copies
    costs about m comparisons and not m squared.
    Sets are 64-bit hashes of shingles, read from the texts of pairs that passed the filters, and compared whole. Texts go by a
    64-bit hash.
    """
    spark = docs.sparkSession
    counts = rarity_counts(docs, text, lambda texts: shingle_hashes(texts, words)[1])
    ranks = spark.sparkContext.broadcast(rarity_ranks(counts))
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = written(_set_rows(rows, ranks, words, percent), "near-rows")
    kept = [F.max(c).alias(c) for c in ("n", "gid", *SIGNATURE)]
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.min("h").alias("h"), *kept)
    nodes = written(nodes, "near-nodes")

    posts = rows.where("prefix IS NOT NULL").select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    spread = posts.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count("*").alias("all"))
    tokens = written(spread.where("lo < hi").select("token", (F.col("all") > SHORT).alias("long")), "near-tokens")
    lists = written(maybe_in(posts, tokens, "token").join(tokens, "token"), "near-lists")
    wide_rows, rows = rows, written(rows.select("doc", "h", "n", "node"), "near-rows")
    discard(tokens, wide_rows)
    settle_driver(spark)

    groups = nodes.groupBy("gid").agg(F.min(F.struct("node", "n", *SIGNATURE)).alias("c"), F.count("*").alias("members"))
    groups = written(groups.select("gid", "members", F.col("c.node").alias("rep"), "c.n", *[f"c.{s}" for s in SIGNATURE]), "near-groups")
    several = groups.where("members > 1").select("gid", "rep")
    big = written(lists.where("long").select("token", "gid", "n", "pos").distinct(), "near-long")
    short = lists.where("not long").groupBy("token").agg(F.collect_set(F.struct("gid", "n", "pos")).alias("all"))
    short = short.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    cand = short.where((F.col("x.gid") < F.col("y.gid")) & _can_link(percent)).select("x.gid", F.col("y.gid").alias("gb"))
    alone = big.withColumn("rep", F.col("gid")).withColumn("comp", F.col("gid"))
    probed = _probed(alone, 0, percent).select(F.least("x.gid", "y.gid"), F.greatest("x.gid", "y.gid"))
    cand = written(cand.toDF("ga", "gb").union(probed).distinct(), "near-candidates")
    discard(lists)
    settle_driver(spark)

    wide = cand.join(several.select(F.col("gid").alias("ga")), "ga", "left_semi").select("ga", "gb")
    wide = wide.union(cand.join(several.select(F.col("gid").alias("gb")), "gb", "left_semi").select("ga", "gb"))
    wide = written(wide.distinct(), "near-wide")
    sides = [_side(groups, s, "gid", "rep").withColumnRenamed(s, f"g{s}") for s in "ab"]
    pairs = cand.join(sides[0], "ga").join(sides[1], "gb").where(_alike(percent)).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    inside = nodes.join(several, "gid").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = pairs.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    screened = written(pairs.distinct(), "near-screened")
    discard(groups, cand)
    settle_driver(spark)
    # Texts are sent once for each pair, so one pair of each set comes first, and then those of two components yet.
    found = verified(_fewest(screened), nodes, texts, words, percent)
    comps = components(found)
    discard(found)

    for turn in range(1, ROUNDS + 1):
        last = turn == ROUNDS
        if last:
            pairs = _rest(big, wide, nodes, comps, percent)
        else:
            units = written(_units(nodes, comps), "near-units")
            tried = _probed(_open(big.join(units, "gid")), turn, percent)
            tried = tried.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
            pairs = written(_screened(tried, nodes, percent).union(_apart(screened, comps)), "near-tried")
            discard(units, screened)
        if not pairs.isEmpty():
            found, old = verified(pairs, nodes, texts, words, percent), comps
            comps = components(old.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found))
            discard(found, old)
        discard(pairs)
    discard(big, wide)

    at = nodes.select("node", "doc").join(comps, "node", "left")
    ids = at.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc").alias("least"))
    at = at.join(ids, "comp", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("least", "doc").alias("component"))
    at = written(at, "near-ids")
    discard(nodes, comps)
    named = [F.col("doc").alias("doc_id"), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles")]
    worded = rows.where("n > 0").join(at, "node").select(*named, F.col("component").alias("component_id"), "node", "comp")
    none = F.lit(None).cast("binary")
    bare = rows.where("n = 0").select(*named, F.col("doc").alias("component_id"), none.alias("node"), none.alias("comp"))
    return worded.unionByName(bare)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row with the least `key` stays, null last.

    Rows without words all stay, and repeated rows (equal key and text) stay once. Columns are unchanged. Who goes is
    decided on keys and hashes; only rows that may go, or may repeat, are shuffled with their texts.
    """
    near = near_components(docs, text, key, words, percent)
    near = written(near.select("doc_id", "text_hash", "n_shingles", "comp"), "near-found")
    d, h = (free_name(docs, c) for c in ("row_key", "row_hash"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    some = near.where("n_shingles > 0").groupBy("comp").agg(F.min(order).alias("s"))
    distinct = near.groupBy("doc_id", "text_hash").agg(F.max("comp").alias("comp"), F.count("*").alias("times"))
    first = F.col("s.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("s.text_hash") == F.col("text_hash"))
    named = [F.col("doc_id").alias(d), F.col("text_hash").alias(h)]
    judged = distinct.where("comp IS NOT NULL").join(some, "comp").select(*named, first.alias("stays"), "times")
    judged = judged.union(distinct.where("comp IS NULL").select(*named, F.lit(True), "times"))
    unsure = written(judged.where("NOT stays OR times > 1"), "near-unsure")
    discard(near)
    rows = docs.withColumn(d, F.col(key).cast("bigint")).withColumn(h, F.xxhash64(text))
    passed = surely_out(rows, unsure, d, h)
    gone = unsure.where("NOT stays").select(F.col(d).alias(f"{d}_"), F.col(h).alias(f"{h}_"))
    match = F.col(d).eqNullSafe(F.col(f"{d}_")) & (F.col(h) == F.col(f"{h}_"))
    checked = maybe_in(rows, unsure, d, h).join(gone, match, "left_anti").dropDuplicates([d, h])
    return passed.unionByName(checked).drop(d, h)
