"""Queries of this subpackage, one an operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import warc
from tickloom.llm.common import delete, discard, fresh_path, written
from tickloom.llm.decontaminate import find_contamination
from tickloom.llm.fill_middle import fill_in_middle, restored
from tickloom.llm.jaccard_join import near_components
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.minhash_join import minhash_components
from tickloom.llm.mixing import mix_sources
from tickloom.llm.oracle import SQL
from tickloom.llm.phrases import mine_phrases
from tickloom.llm.quality_model import fold_of, score_quality
from tickloom.llm.quality_rules import quality_metrics
from tickloom.llm.surrogates import replace_entities
from tickloom.llm.token_count import token_counts
from tickloom.llm.token_store import ids_crc32, map_documents, read_token_shards, write_token_shards

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text"):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_metrics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text"), BYTE_BPE)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages with a gzip member a record, copy the archive with some bytes gone bad, and find what the copy has wrong.

    Bad are the last bytes of pages whose URL's MD5 begins below 05. Archive and copy are deleted when they are read.
    """
    pages = table(spark, sf_dir, "pages")
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record_id = F.concat(F.lit("<urn:x-page:"), F.md5(F.concat_ws(":", number, "url")), F.lit(">"))
    record = warc.record_text(record_id, F.col("url"), F.col("html"), {"X-Page-Id": number})
    path, copy = fresh_path(spark, "warc"), fresh_path(spark, "warc-copy")
    warc.write_warc(pages, record, path, gzipped=True)
    h = F.col("headers")
    named = [h["x-page-id"].cast("bigint").alias("page_id"), F.md5("uri").alias("mark"), h["warc-payload-digest"].alias("digest")]
    index = written(warc.read_warc(spark, path, payload=False).select("file", "seq", "start", "length", "size", *named), "warc-index")
    rotten = index.where("mark < '05'").select("file", (F.col("start") + F.col("length") - 5).alias("at"))
    warc.copy_archive(warc.flip_bytes(warc.read_files(spark, path), rotten), copy, gzipped=True)
    leaves = written(warc.leaf_hashes(warc.read_files(spark, path), index), "warc-leaves")
    others = written(warc.leaf_hashes(warc.read_files(spark, copy), index), "warc-leaves")
    bad = warc.audit(leaves, others)
    discard(leaves, others)
    delete(spark, path, copy)
    marked = index.join(bad.select("file", "seq", F.lit(True).alias("bad")), ["file", "seq"], "left")
    damaged = F.coalesce("bad", F.lit(False)).alias("damaged")
    return marked.select("page_id", F.col("size").alias("record_bytes"), F.substring("digest", 8, 64).alias("payload_sha256"), damaged)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Write the documents' ids as shards in the shared folder and digest what is read back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-shards")
    write_token_shards(docs, path, WORD_BPE, end_id=2)
    return map_documents(read_token_shards(spark, path), ids_crc32, pa.int64(), "bigint", "ids_crc32")


#: The key that the registered query draws with; a caller of the operator brings a secret of their own.
QUERY_KEY = "registered-query"


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    s = F.col("surrogates")
    return done.select("doc_id", s["text"].alias("text"), s["n_entities"].alias("n_entities"), F.array_join(F.transform(s["entities"], lambda e: e["kind"]), ",").alias("kinds"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_components(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = F.col("mix")
    return mix_sources(docs, word_count()).select("doc_id", *[m[c].alias(c) for c in ("size", "source_size", "target", "taken")])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("deduped")
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", d["n_lines"].alias("n_lines"), d["n_removed"].alias("n_removed"), d["text"].alias("text"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)
    return near.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fim")
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim")
    return done.select(
        "doc_id", *[f[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(restored(f["output"], f["form"]), 256).alias("restored_sha256"),
    )


_ALL = (
    op1_decontamination, op2_quality_classifier, op3_quality_rules, op4_token_counts, op5_warc_audit,
    op6_token_ids, op7_surrogates, op8_ngram_jaccard, op9_mixing, op10_line_dedup,
    op11_minhash, op12_phrases, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}
