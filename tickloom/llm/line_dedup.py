"""Line dedup by an exact set-similarity join over the lines' word sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import counter_of, discard, free_name, maybe_in, rarity_counts, surely_out, written
from tickloom.llm.hashing import (
    frugal, grouped, mixed, ordered_sets, rarity_ranks, set_digests, set_signatures, word_hashes,
)

#: A word with a larger counter is in lists only together with each of the next words of its line's prefix.
HEAVY = 1024
#: Most words of a line that is listed so; longer ones have lists of single words, and those near the bound have both.
PAIRED_WORDS = 256
#: Keys of a class, the rarest first, by which it tries one of a list, the class of most lines, before all others.
TRIED = 4
#: Words from which a line has a signature of 128 bits; 64 bits do not tell long lines from each other.
WIDE = 48
#: Ids of settled classes up to which their table is broadcast (8 bytes each); more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Posts of whole lists that are compared in one go, and pairs of them; a longer list is one go.
POSTS, PAIRS = 1 << 18, 1 << 19
#: Low bits of a packed key that are the place; the rest is the hash. A place beyond goes by the last one, which only passes more.
PLACE_BITS = 16
#: A character of a word.
_WORD = "[^\\x20\\x09-\\x0D]"


def _line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of all words of some texts; lines are numbered through all of them."""
    data = b"\n".join(texts)
    start, h = word_hashes(data)
    before = np.searchsorted(start, np.flatnonzero(np.frombuffer(data, np.uint8) == 10))
    count = np.diff(np.concatenate(([0], before, [len(h)])))
    return np.repeat(np.arange(len(count)), count), h


def _keys(h: np.ndarray, first: np.ndarray, rank: np.ndarray, heavy: int, percent: int) -> tuple[np.ndarray, ...]:
    """(set, key, pos) of the postings of ordered sets, by set and pos.

    Two sets over the threshold share a word among their first n - needed + 1, the prefix; if they have two words in common,
    the second is at most one place after the prefix. So a set is listed by each light word of its prefix, and by each
    heavy one with each word after it up to that place. `pos` of a pair of words is the second's place less one.
    """
    n = np.diff(np.append(first, len(h)))
    needed = -(-percent * n // 100)
    keep = np.where(100 * n >= percent * (n + 1), n - needed + 1, 0)
    paired, single = n <= PAIRED_WORDS, (100 * n > percent * PAIRED_WORDS) | (needed == 1)
    place = np.arange(len(h)) - np.repeat(first, n)
    some = np.flatnonzero(place < np.repeat(np.where(keep > 0, np.minimum(n, keep + 1), 0), n))
    owner, word, at = np.repeat(np.arange(len(n)), n)[some], h[some], place[some]
    is_heavy, inside = rank[some] > heavy, at < keep[owner]
    alone = inside & (~is_heavy | single[owner])
    found = [(owner[alone], word[alone], at[alone])]
    starts = inside & is_heavy & paired[owner]
    for step in range(1, int(keep[paired].max(initial=0)) + 1):
        i = np.flatnonzero(starts[:-step] & (owner[:-step] == owner[step:]))
        if not len(i):
            break
        found.append((owner[i], mixed(word[i] * np.uint64(3) + word[i + step], 0x9A15), at[i + step] - 1))
    owner, key, at = (np.concatenate(c) for c in zip(*found))
    order = np.argsort((owner << 32) | at)
    return owner[order], key[order], at[order]


def _signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two numbers for each set: a signature of 128 bits, and for sets of less than WIDE words both halves folded into the first."""
    sig = set_signatures(h, first, 2).view(np.int64)
    short = np.diff(np.append(first, len(h))) < WIDE
    sig[short, 0] ^= sig[short, 1]
    sig[short, 1] = 0
    return sig


def _line_rows(docs: DataFrame, ranks, percent: int) -> DataFrame:
    """(doc, h, text) rows to one row a line with words: doc, h, line, n, node (digest of its set), sig and more (signature), keys (packed)."""
    heavy = int(rarity_ranks(np.array([HEAVY]))[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = ranks.value
        for batch in batches:
            for row, texts in grouped(batch.column(2)):
                line, h = _line_words(texts)
                line, h, first = ordered_sets(line, h, rare[counter_of(h)])
                owner, key, pos = _keys(h, first, rare[counter_of(h)], heavy, percent)
                low = np.uint64((1 << PLACE_BITS) - 1)
                packed = (key & ~low) | np.minimum(pos.astype(np.uint64), low)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(first)))))
                keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(packed.view(np.int64)))
                text = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
                start = np.searchsorted(text, np.arange(len(texts)))
                at = line[first]
                rows = pa.array(row + text[at], pa.int64())
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - start[text[at]], pa.int32())]
                columns += [pa.array(np.diff(np.append(first, len(h))), pa.int32()), set_digests(h, first)]
                sig, more = _signatures(h, first).T
                columns += [pa.array(np.ascontiguousarray(sig)), pa.array(np.ascontiguousarray(more)), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "h", "line", "n", "node", "sig", "more", "keys"])

    kinds = "doc bigint, h bigint, line int, n int, node binary, sig bigint, more bigint, keys array<bigint>"
    return docs.mapInArrow(frugal(read), kinds)


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the lines in the written table `wanted` (node, doc, h, line), read from the texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: tuple[list, list] = ([], [])
            for text, lines in zip(batch.column(0), batch.column(1).to_pylist()):
                split = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                line, h = _line_words([b"\n".join(split[x["line"]] for x in lines)])
                line, h, _ = ordered_sets(line, h, np.zeros(len(h), np.uint16))
                for x, a, z in zip(lines, *np.searchsorted(line, [np.arange(len(lines)), np.arange(len(lines)) + 1])):
                    made[0].append(x["node"])
                    made[1].append(h[a:z].view(np.int64))
            yield pa.record_batch([pa.array(made[0], pa.binary()), pa.array(made[1], pa.list_(pa.int64()))], ["node", "words"])

    places = wanted.groupBy(F.col("doc").alias("d"), F.col("h").alias("g"))
    places = places.agg(F.collect_set(F.struct("line", "node")).alias("lines"))
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    rows = maybe_in(docs, wanted, "doc", "h").join(places, same).select("t", "lines")
    return rows.mapInArrow(frugal(read), "node binary, words array<bigint>").dropDuplicates(["node"])


def _late(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, id) of the later class of each pair of ids (a, b) whose word sets have Jaccard >= percent / 100. A written table."""
    pairs = written(pairs.distinct(), "line-pairs")
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = written(classes.select("id", "node", "at.*").join(named, "id", "left_semi"), "line-wanted")
    sets = _whole_sets(docs, wanted).join(wanted.select("id", "node", "last", "doc", "h", "line"), "node")
    sets = written(sets.select("id", F.struct("last", "doc", "h", "line", "node", "id").alias("at"), "words"), "line-sets")
    side = lambda s: sets.select(F.col("id").alias(s), F.col("at").alias(f"at_{s}"), F.col("words").alias(f"w{s}"))
    common = F.size(F.array_intersect("wa", "wb")).alias("i")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select(F.greatest("at_a", "at_b").alias("at"), F.size("wa").alias("n"), F.size("wb").alias("m"), common)
    linked = both.where(100 * F.col("i") >= percent * (F.col("n") + F.col("m") - F.col("i")))
    late = written(linked.select("at.node", "at.id").distinct(), "line-late")
    discard(pairs, wanted, sets)
    return late


def _posts(classes: DataFrame, *columns: str | Column, keys: str | Column = "keys") -> DataFrame:
    """A row for each key of each class: key, pos, id, n, sig, more and `columns`, shuffled and sorted by key."""
    low = (1 << PLACE_BITS) - 1
    rows = classes.select("id", "n", "sig", "more", *columns, F.explode(keys).alias("packed"))
    key, pos = F.col("packed").bitwiseAND(~low).alias("key"), F.col("packed").bitwiseAND(low).alias("pos")
    return rows.select(key, pos, *rows.columns[:-1]).repartition("key").sortWithinPartitions("key")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of posts sorted by key, some whole lists at a time, with `list`, which numbers the lists."""
    held, rows, wanted = [], 0, POSTS

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        out = {c: t[c].to_numpy() for c in t.column_names}
        key = out["key"]
        return out | {"list": np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))}

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(t["key"].to_numpy(), t["key"][-1].as_py()))
        if cut:
            yield columns(t.slice(0, cut))
        held, rows = t.slice(cut).to_batches(), rows - cut
        wanted = max(POSTS, 2 * rows)
    if rows:
        yield columns(pa.Table.from_batches(held).combine_chunks())


def _alike(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether signatures leave it open that posts i and j have Jaccard >= percent / 100."""
    n, m, sig, more = t["n"][i], t["n"][j], t["sig"][i] ^ t["sig"][j], t["more"][i] ^ t["more"][j]
    wide = np.minimum(n, m) >= WIDE
    bits = np.bitwise_count(np.where(wide, sig, sig ^ more).view(np.uint64)).astype(np.int64)
    bits += np.where(wide, np.bitwise_count(more.view(np.uint64)), 0)
    return (100 + percent) * bits <= (100 - percent) * (n + m)


def _reach(t: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """`percent` times the largest set over the threshold of which a post's key may be the first that both have, by lengths and places."""
    return (100 + percent) * (t["n"] - t["pos"]) - percent * t["n"]


def _named(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = t["id"][i], t["id"][j]
    return pa.record_batch([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], ["a", "b"])


def _tried_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the one of the largest `most` of its list, if filters pass them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            t["n"] = t["n"].astype(np.int64)
            first = np.flatnonzero(np.diff(t["list"], prepend=-1))
            best = np.flatnonzero(t["most"] == np.maximum.reduceat(t["most"], first)[t["list"]])
            j = best[np.searchsorted(t["list"][best], t["list"])]
            reach = _reach(t, percent)
            i = np.flatnonzero((reach >= percent * t["n"][j]) & (reach[j] >= percent * t["n"]))
            i = i[_alike(t, i, j[i], percent)]
            yield _named(t, i, j[i])

    return posts.mapInArrow(frugal(run), "a bigint, b bigint")


def _open_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of one list that filters pass, of which the later one may be not settled.

    Posts of a list are sorted by length, so that a post meets a run of the next ones, which may be as long as it reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _lists(batches):
            order = np.argsort((t["list"] << 32) | t["n"], kind="stable")
            t = {c: v[order] for c, v in t.items()}
            t["n"] = t["n"].astype(np.int64)
            reach = _reach(t, percent)
            end = np.searchsorted((t["list"] << 32) | t["n"], (t["list"] << 32) | np.maximum(reach // percent, 0), "right")
            count = np.maximum(end - np.arange(len(end)) - 1, 0)
            total = np.concatenate(([0], np.cumsum(count)))
            at = 0
            while at < len(count):
                stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
                i = np.repeat(np.arange(at, stop), count[at:stop])
                j = np.arange(total[at], total[stop]) - total[i] + i + 1
                some = reach[j] >= percent * t["n"][i]
                i, j = i[some], j[some]
                x, y = t["done"][i], t["done"][j]
                later = (t["place"][i] > t["place"][j]) * 1 - (t["place"][i] < t["place"][j])
                some = (x + y == 0) | ((x < y) & (later >= 0)) | ((x > y) & (later <= 0))
                i, j = i[some], j[some]
                some = _alike(t, i, j, percent)
                yield _named(t, i[some], j[some])
                at = stop

    return posts.mapInArrow(frugal(run), "a bigint, b bigint")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80) -> DataFrame:
    """`docs` with a struct column `deduped`: text (without removed lines), n_lines (with words), n_removed.

    Lines are \\n-split; a line's words are runs of anything but white space, A-Z as a-z, and count once. A line is
    removed when an earlier line, by (key, hash of the text, copy, line number), of any document has a word set
    with Jaccard >= percent / 100. Whether that line is removed too plays no part. Lines without words stay. A
    null text stays null, with 0 lines; a null key comes last. Of rows with equal key and text one, whichever, is the first copy, and
    the others lose all lines with words. Very long texts and lines are read in whole; an empty table gives no rows. Other columns are
    carried; one called `deduped` is replaced.

    Lines of equal sets are one class with its first place. Words are ordered rare first, by counters over all lines;
    classes that share a key of their prefix meet, after filters by length, position and signature (a lower bound of the sets'
    difference). First every class tries one class of its first TRIED lists, that of most lines (which in a swarm of near copies
    is the unchanged line); classes that have an earlier match then are settled. The others try all of their lists. Sets are read from the texts for pairs that pass, and verified.
    Only documents that may lose a line are shuffled with their texts. Sets are compared by 64-bit hashes of words,
    and in lists a class goes by a 64-bit hash.
    """
    spark = docs.sparkSession
    counts = rarity_counts(docs, text, lambda texts: word_hashes(b"\n".join(texts))[1])
    ranks = spark.sparkContext.broadcast(rarity_ranks(counts))
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    wide = written(_line_rows(texts, ranks, percent), "lines")
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "h", "line")
    first = F.min(F.struct(at.alias("at"), "n", "sig", "more", "keys")).alias("c")
    classes = wide.groupBy("node").agg(first, F.count("*").alias("times")).select("node", F.monotonically_increasing_id().alias("id"), "times", "c.*")
    classes = written(classes, "line-classes")
    lines = written(wide.select("doc", "h", "line", "node"), "lines")
    discard(wide)

    early = F.when(F.col("at.doc") >= 0, 1 / (2 + F.col("at.doc"))).otherwise(F.lit(0.0))
    most = (F.col("times") + early).alias("most")
    tried = _tried_pairs(_posts(classes, most, keys=F.slice("keys", 1, TRIED)), percent)
    settled = _late(tried, classes, texts, percent)

    mark = settled.select("id", F.lit(1).alias("done")).distinct()
    mark = F.broadcast(mark) if settled.count() <= BROADCAST_IDS else mark
    place = F.coalesce("at.doc", F.lit((1 << 63) - 1)).alias("place")
    marked = classes.join(mark, "id", "left")
    others = _late(_open_pairs(_posts(marked, place, F.coalesce("done", F.lit(0)).alias("done")), percent), classes, texts, percent)

    repeated = classes.where("times > 1").select("node", F.col("at").alias("first"), F.lit(False).alias("late"))
    late = settled.union(others).select("node", F.lit(None).cast(repeated.schema["first"].dataType), F.lit(True))
    marks = written(repeated.union(late).groupBy("node").agg(F.max("first").alias("first"), F.max("late").alias("late")), "line-marks")
    judged = maybe_in(lines, marks, "node").join(marks, "node").where(F.col("late") | (at != F.col("first")))
    d, g, gone, n = (free_name(docs, c) for c in ("dedup_doc", "dedup_hash", "dedup_gone", "dedup_lines"))
    late_lines = judged.groupBy(F.col("doc").alias(d), F.col("h").alias(g)).agg(F.collect_set("line").alias(gone))
    copies = texts.where(F.col("t").isNotNull()).groupBy(F.col("doc").alias(d), F.col("h").alias(g)).agg(F.count("*").alias("copies")).where("copies > 1")
    nothing = F.array().cast("array<int>").alias(gone)
    losing = late_lines.withColumn("copies", F.lit(1).cast("bigint")).unionByName(copies.select(d, g, nothing, "copies"))
    losing = losing.groupBy(d, g).agg(F.flatten(F.collect_list(gone)).alias(gone), (F.max("copies") > 1).alias(n))
    losing = written(losing, "line-losing")
    discard(classes, lines, settled, others, marks)

    carried = [c for c in docs.columns if c.lower() != "deduped"]
    whole, k, t, row, first = (free_name(docs, c) for c in ("dedup_text", "dedup_key", "dedup_text_hash", "dedup_row", "dedup_first"))
    rows = docs.select(*carried, F.col(text).alias(whole), F.col(key).cast("bigint").alias(k), F.xxhash64(text).alias(t))
    split = F.split(whole, "\n", -1)
    worded = F.regexp_count(F.concat(F.lit("\n"), whole), F.lit(f"\\n[\\x20\\x09\\x0B-\\x0D]*+{_WORD}"))
    count = F.when(F.col(whole).isNull(), 0).otherwise(worded).cast("bigint").alias("n_lines")
    named = losing.select(F.col(d).alias(k), F.col(g).alias(t))
    kept_all = F.struct(F.col(whole).alias("text"), count, F.lit(0).cast("bigint").alias("n_removed")).alias("deduped")
    untouched = surely_out(rows, named, k, t).select(*carried, kept_all)
    same = F.col(k).eqNullSafe(F.col(d)) & (F.col(t) == F.col(g))
    touched = maybe_in(rows, named, k, t).join(losing, same, "left").where(~F.coalesce(n, F.lit(False))).withColumn(row, F.lit(False))
    # Rows with copies are written with a number each, so that all reads agree on which one is the first.
    several = losing.where(n).select(F.col(d).alias(k), F.col(g).alias(t))
    some = written(maybe_in(rows, several, k, t).join(losing.where(n), same).withColumn(row, F.monotonically_increasing_id()), "line-rows")
    firsts = some.groupBy(F.col(d).alias(f"{d}_"), F.col(g).alias(f"{g}_")).agg(F.min(row).alias(first))
    some = some.join(firsts, F.col(d).eqNullSafe(F.col(f"{d}_")) & (F.col(g) == F.col(f"{g}_")))
    touched = touched.unionByName(some.withColumn(row, F.col(row) != F.col(first)).select(*touched.columns))
    touched = touched.withColumn(n, F.coalesce(gone, F.array().cast("array<int>")))
    # The text is split once, as a variable: what stands inside a lambda is computed for each element again.
    kept = lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), n), lambda i: F.get(s, i))
    joined = F.get(F.transform(F.array(split), lambda s: F.array_join(kept(s), "\n")), F.lit(0))
    shown = F.when(F.size(n) == 0, F.col(whole)).otherwise(joined)
    again = F.col(row)
    bare = F.array_join(F.filter(split, lambda x: ~F.rlike(x, F.lit(_WORD))), "\n")
    removed = F.when(again, worded).otherwise(F.size(n)).cast("bigint")
    cut = F.struct(F.when(again, bare).otherwise(shown).alias("text"), count, removed.alias("n_removed")).alias("deduped")
    return untouched.unionByName(touched.select(*carried, cut))
