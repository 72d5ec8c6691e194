"""WARC archives written and read by Spark, and a Merkle audit of replicas."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import discard, written

_END = "\r\n\r\n"
#: Bytes and records after which a file is closed, so that a file fits a task; one longer record is a file of its own.
FILE_BYTES = 16_000_000
RECORDS_PER_FILE = 1_000
#: Children of one tree node.
FANOUT = 16
#: Ranges up to which the table of all files' ranges is broadcast (some 20 bytes each); more of them are joined by shuffling.
BROADCAST_RANGES = 1_000_000
_DATE = "2024-01-01T00:00:00Z"


def record_text(record_id: Column, uri: Column, payload: Column, extra: dict[str, Column] | None = None) -> Column:
    """A WARC/1.1 `resource` record without its closing blank lines; null payloads are empty ones, null headers are left out.

    Line breaks in headers become spaces. Equal rows give equal records, and payloads of any length stay whole.
    """
    body = F.coalesce(payload, F.lit(""))
    clean = lambda c: F.regexp_replace(c, "[\\r\\n]+", " ")
    fields = {"WARC-Record-ID": record_id, "WARC-Target-URI": clean(uri), "WARC-Date": F.lit(_DATE), "Content-Type": F.lit("text/html")}
    fields |= {k: clean(v.cast("string")) for k, v in (extra or {}).items()}
    fields |= {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.sha2(body, 256)), "Content-Length": F.octet_length(body).cast("string")}
    lines = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), body)


def write_warc(
    records: DataFrame, record: Column, path: str, gzipped: bool = False,
    file_bytes: int = FILE_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one WARC record a row, in the rows' order and partitions: nothing is shuffled, and Spark's writer commits.

    A task packs its records into files of at most `file_bytes` (uncompressed) and `records_per_file`. With `gzipped` each
    record is a gzip member of its own, as readers of .warc.gz files expect, and a file ends with a zero byte of padding.
    An empty table gives no files.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            data = b"".join(_member(x) for x in held) if gzipped else b"".join(held)[: -len(_END)]
            return pa.record_batch([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for x in batch.column(0):
                raw = x.as_py().encode("utf-8", "surrogatepass") + _END.encode()
                if held and (size + len(raw) > file_bytes or len(held) >= records_per_file):
                    yield file()
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
        if held:
            yield file()

    files = records.select(record.alias("value")).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    end = "\0" if gzipped else _END
    files.write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def _member(data: bytes) -> bytes:
    """One gzip member without a time stamp, so that equal records are equal bytes."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of an archive's files; `file` is the name, or that of the folder `file=...` in a replica."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    folder = F.regexp_extract("path", "/file=([^/]+)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~name.startswith("_") & ~name.startswith("."))
    return files.select(F.when(folder != "", folder).otherwise(name).alias("file"), "content")


def copy_archive(files: DataFrame, path: str, gzipped: bool = False) -> None:
    """Write (file, content) rows as a replica: one folder `file=...` for each that has bytes, with the same bytes in it.

    A content that does not end as write_warc() ends files is an error, since the text writer adds that end.
    """
    end = "\0" if gzipped else _END
    body = F.expr(f"substring(content, 1, length(content) - {len(end)})").cast("string")
    tail = F.expr(f"substring(content, length(content) - {len(end) - 1}, {len(end)})")
    checked = F.when(tail == F.lit(end.encode()), body).otherwise(F.raise_error(F.lit("the file has another end")))
    sized = files.where("length(content) > 0").select("file", checked.alias("value"))
    sized.write.partitionBy("file").option("lineSep", end).text(path)


def flip_bytes(files: DataFrame, places: DataFrame) -> DataFrame:
    """(file, content) rows with the bits of the bytes at `places` (file, at) inverted: bit rot for drills."""

    def rot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = bytearray(batch.column(1)[row].as_buffer())
                for at in batch.column(2)[row].as_py() or ():
                    data[at] ^= 0xFF
                yield pa.record_batch([batch.column(0).slice(row, 1), pa.array([bytes(data)], pa.binary())], ["file", "content"])

    marks = _checked(places.groupBy("file").agg(F.collect_list("at").alias("places")), places)
    return files.join(marks, "file", "left").select("file", "content", "places").mapInArrow(rot, "file string, content binary")


def _checked(grouped: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a file, marked for broadcast if the rows behind it are few enough: then contents stay in their tasks."""
    return F.broadcast(grouped) if rows.count() <= BROADCAST_RANGES else grouped


def _headers(raw: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(start of payload, headers) of the record at an offset."""
    head = raw.find(b"\r\n\r\n", at)
    if head < 0 or not raw.startswith(b"WARC/", at):
        raise ValueError(f"no WARC record at byte {at}")
    lines = raw[at:head].decode("utf-8", "replace").split("\r\n")[1:]
    return head + 4, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _unpacked(raw: bytes, at: int) -> tuple[bytes, int]:
    """(data, end) of the gzip member at an offset."""
    member, parts = zlib.decompressobj(31), []
    while not member.eof:
        if at >= len(raw):
            raise ValueError("the last record is cut off")
        parts.append(member.decompress(raw[at : at + (1 << 16)]))
        at += 1 << 16
    return b"".join(parts), min(at, len(raw)) - len(member.unused_data)


def _cut(raw: bytes) -> Iterator[tuple[int, int, int, bytes, dict[str, str]]]:
    """(offset, length in the file, size, payload, headers) of every record of a file, plain or with a gzip member a record."""
    at, gzipped = 0, raw[:2] == b"\x1f\x8b"
    size = len(raw.rstrip(b"\0")) if gzipped and raw[-1] == 0 else len(raw)
    while at < size:
        if gzipped:
            data, end = _unpacked(raw, at)
            body, fields = _headers(data, 0)
            yield at, end - at, len(data), data[body : body + int(fields["content-length"])], fields
        else:
            body, fields = _headers(raw, at)
            end = body + int(fields["content-length"]) + len(_END)
            if end > size:
                raise ValueError(f"record at byte {at} is cut off")
            yield at, end - at, end - at, raw[body : end - len(_END)], fields
        at = end


_RECORD = {
    "file": pa.string(), "seq": pa.int32(), "start": pa.int64(), "length": pa.int64(), "size": pa.int64(),
    "record_id": pa.string(), "uri": pa.string(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(),
}


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive: file, seq, start, length (bytes in the file), size (bytes of the record), record_id, uri, headers, payload.

    Each file is one task's; payloads are bytes, or null where `payload` is false. Files of gzip members are
    recognised, and start and length are then those of the member. A file that is not WARC fails the query. A header that a
    record lacks is null. Records that repeat are rows that repeat; an archive without files has no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for seq, (at, length, whole, body, fields) in enumerate(_cut(content.as_py())):
                    known = (fields.get("warc-record-id"), fields.get("warc-target-uri"), [*fields.items()])
                    rows.append((name, seq, at, length, whole, *known, body if payload else None))
                    size += len(body) if payload else 0
                    if len(rows) == 500 or size > FILE_BYTES:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _RECORD.values())], [*_RECORD])
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _RECORD.values())], [*_RECORD])

    kinds = "file string, seq int, start bigint, length bigint, size bigint, record_id string, uri string"
    return read_files(spark, path).mapInArrow(parse, f"{kinds}, headers map<string,string>, payload binary")


def leaf_hashes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Leaves of a replica: (file, seq, start, length, hash) for the ordered ranges (file, seq, start, length).

    A leaf is the SHA-256 of its range and the bytes there, so a byte that changes, moves or is missing shows. A file
    that the replica lacks gives leaves of no bytes. Bytes after a file's last range, and those of a file without ranges,
    are one more leaf. Contents are not shuffled unless there are more than BROADCAST_RANGES ranges. Ranges may repeat or
    overlap; records of any length are hashed in whole; no files and no ranges give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                view, cuts = memoryview(content.as_buffer()) if content.is_valid else memoryview(b""), cuts or []
                end = max((c["start"] + c["length"] for c in cuts), default=0)
                if len(view) > end:
                    cuts.append({"seq": cuts[-1]["seq"] + 1 if cuts else 0, "start": end, "length": len(view) - end})
                made = []
                for c in cuts:
                    h = hashlib.sha256(b"%d:%d:" % (c["start"], c["length"]))
                    h.update(view[c["start"] : c["start"] + c["length"]])
                    made.append(h.hexdigest())
                columns = [pa.array([name] * len(cuts), pa.string()), pa.array([c["seq"] for c in cuts], pa.int32())]
                columns += [pa.array([c[k] for c in cuts], pa.int64()) for k in ("start", "length")]
                yield pa.record_batch([*columns, pa.array(made, pa.string())], ["file", "seq", "start", "length", "hash"])

    cuts = ranges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length"))).alias("cuts"))
    there = files.join(_checked(cuts, ranges), "file", "left").select("file", "content", "cuts")
    lost = cuts.join(files.select("file"), "file", "left_anti").select("file", F.lit(None).cast("binary").alias("content"), "cuts")
    return there.union(lost).mapInArrow(read, "file string, seq int, start bigint, length bigint, hash string")


def merkle_levels(leaves: DataFrame, fanout: int = FANOUT, most: int | None = None) -> list[DataFrame]:
    """The trees' levels from leaves to one root: each (grp, seq, start, length, hash), `grp` the file.

    A node hashes its at most `fanout` children with the range that they span. Within files the trees grow to
    one node a file; these, in order of file names, grow on to the archive's root. Files have at most a bounded number of records,
    so levels within files are known beforehand; above them one row a file is numbered. `most` is the greatest seq, where
    trees that are compared must have equal heights.
    """
    levels = [leaves.select(F.col("file").alias("grp"), "seq", "start", "length", "hash")]
    most = leaves.agg(F.max("seq")).first()[0] if most is None else most

    def up(level: DataFrame) -> DataFrame:
        children = F.sort_array(F.collect_list(F.struct("seq", "start", "length", "hash")))
        span = level.groupBy("grp", F.floor(F.col("seq") / fanout).cast("int").alias("parent")).agg(children.alias("c"))
        start, length = F.col("c")[0]["start"], F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["length"])
        joined = F.concat_ws(":", start.cast("string"), length.cast("string"), F.array_join(F.transform("c", lambda x: x["hash"]), ""))
        return written(span.select("grp", F.col("parent").alias("seq"), start.alias("start"), length.alias("length"), F.sha2(joined, 256).alias("hash")), "merkle")

    while most:
        levels.append(up(levels[-1]))
        most //= fanout
    return levels


def _top_levels(files: DataFrame, number: DataFrame, fanout: int, most: int | None) -> list[DataFrame]:
    """Levels above the files' roots, under the one group ''."""
    numbered = files.select("grp", "hash", "start", "length").join(number, "grp").select(F.lit("").alias("grp"), F.col("number").alias("seq"), "start", "length", "hash")
    return merkle_levels(numbered.withColumnRenamed("grp", "file"), fanout, most)


def audit(leaves: DataFrame, others: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves (file, seq, start, length, hash, other_hash) in which a replica differs: from the roots down. A written table.

    At each level only children of nodes that differ are compared. Equal roots end the audit at once, with no rows; empty
    archives are equal. Ranges and files that one side alone has are reported too, with a null hash of the other side.
    """
    most = leaves.select("seq").union(others.select("seq")).agg(F.max("seq")).first()[0]
    lower, lower2 = merkle_levels(leaves, fanout, most), merkle_levels(others, fanout, most)
    number = written(_numbered(lower[-1].select("grp").union(lower2[-1].select("grp")).distinct()), "merkle-files")
    last = number.agg(F.max("number")).first()[0]
    upper, upper2 = _top_levels(lower[-1], number, fanout, last), _top_levels(lower2[-1], number, fanout, last)
    ours = ("grp", "seq", "start", "length", "hash")

    def differing(a: DataFrame, b: DataFrame, parents: DataFrame | None) -> DataFrame:
        if parents is not None:
            inside = parents.select("grp", F.col("seq").alias("parent"))
            child = lambda x: (x["grp"] == inside["grp"]) & (F.floor(x["seq"] / fanout) == inside["parent"])
            a, b = (x.join(inside, child(x), "left_semi") for x in (a, b))
        b = b.select("grp", "seq", *[F.col(c).alias(f"other_{c}") for c in ours[2:]])
        both = a.join(b, ["grp", "seq"], "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        span = [F.coalesce(c, f"other_{c}").alias(c) for c in ("start", "length")]
        return written(both.select("grp", "seq", *span, "hash", "other_hash"), "merkle-differs")

    steps = [*zip(reversed(upper), reversed(upper2)), None]
    steps += zip(reversed(lower[:-1]), reversed(lower2[:-1])) if len(lower) > 1 else [(lower[0], lower2[0])]
    found, done = None, []
    for step in steps:
        if step is None:  # from the archive's tree to those of the files
            found = found.select(F.col("seq").alias("number")).join(number, "number").select("grp", F.lit(0).alias("seq"))
        else:
            found = differing(*step, found)
            done.append(found)
    discard(number, *done[:-1], *[t for levels in (lower, lower2, upper, upper2) for t in levels[1:]])
    out = found.withColumnRenamed("grp", "file")
    out.written_path = found.written_path
    return out


def _numbered(roots: DataFrame) -> DataFrame:
    """(grp, number): files in order of their names. One row a file is sorted, never records."""
    return roots.select("grp", (F.row_number().over(Window.orderBy("grp")) - 1).alias("number"))
