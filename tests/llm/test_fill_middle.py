"""Fill-in-the-middle against a plain version with the standard library's regular expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F
from tests.llm.test_operators import SCHEMA, kept_columns, odd_rows

from tickloom.llm.fill_middle import fill_in_middle, restored, token_ends

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, percent=50, spm=80):
    w = TOKENS.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return len(w), "plain", None, None, text
    a, z = sorted(x % (len(w) + 1) for x in h[:2])
    pre, mid, suf = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < spm else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return len(w), form, len(pre), len(mid), out


def test_token_ends_in_pieces():
    for text in ("", " ", "a", "a b", "  a\n\nbc \t d\x85e  ", " x \U0001f600y z ", "ab " * 50, "x" * 40, " " * 40 + "y" * 40 + " "):
        ends, at = [], 0
        for w in TOKENS.findall(text):
            at += len(w)
            ends.append(at)
        for piece in (1, 2, 7, 10_000):
            assert token_ends(text, piece).tolist() == ends


def test_fill_in_middle_odd_rows(spark):
    marked = [(100 + i, t, "en", "s", 1, *["mix", "q", 1, "c", "n", "d", "x"]) for i, t in enumerate(["a <P> b", "<M>", "<S> x y z", "< P> a b c", "\x00 a\x0bb", "a b c"] * 4)]
    docs = spark.createDataFrame(odd_rows() + marked, SCHEMA).repartition(3).withColumn("fim", F.lit("clash")).withColumn("fim_key", F.lit(1))
    for percent, spm in ((50, 80), (100, 50), (0, 80)):
        out = fill_in_middle(docs, percent=percent, spm_percent=spm)
        assert kept_columns(out.drop("fim_key"), without="fim")
        rows = out.withColumn("back", restored("fim.output", "fim.form")).collect()
        assert len(rows) == docs.count()
        for r in rows:
            f = r["fim"]
            assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == plain(r["doc_id"], r["text"] or "", percent, spm)
            assert r["back"] == (r["text"] or "")
    assert {r["fim"]["form"] for r in fill_in_middle(docs, percent=100).collect()} == {"plain", "spm", "psm"}
    assert fill_in_middle(docs.limit(0)).count() == 0
