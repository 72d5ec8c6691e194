"""Phrase mining against a plain version that counts every run of words in dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, odd_rows

from tickloom.llm import phrases


def plain(rows, least, percent, top):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, n in f.items():
        found = {g: a for g, a in n.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in found.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], a)
        rows = []
        for g, a in found.items():
            if len(g) == 2 and 100 * longer[g] >= percent * a and longer[g]:
                continue
            score, k = min((1000000 * a * a // (n[g[:k]] * n[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), n[g[:k]], n[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(8)
    words = [*"abcdefgh", "Ä", "ä", "日本", "\U0001f600", "it's", "x\x0by", "Zz", "zZ"]
    out = [(rng.choice(["en", "en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r", "\x0c"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    return out + [("en", None), (None, None), ("fr", ""), ("en", "a b " * 20_000), ("es", "."), *[("en", "hot hot hot")] * 40]


@pytest.mark.parametrize("id_bits", [21, 3])
def test_mined_phrases_equal_plain_ones(spark, monkeypatch, id_bits):
    monkeypatch.setattr(phrases, "ID_BITS", id_bits)  # of 3: more words than a dense dictionary may have
    rows = texts() + [(r[2], r[1]) for r in odd_rows()]
    odd = spark.createDataFrame(odd_rows(), SCHEMA).select("lang", "text")
    docs = spark.createDataFrame(texts(), "lang string, text string").union(odd).repartition(5).withColumn("n", F.lit("clash")).withColumn("word", F.lit(1))
    for least, percent, top in ((10, 50, 2000), (2, 90, 7)):
        out = phrases.mine_phrases(docs, least=least, percent=percent, top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        found = sorted(tuple(r) for r in out.collect())
        assert found == plain(rows, least, percent, top) and len(found) > 20
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    assert phrases.mine_phrases(docs.where("text IS NULL")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(10**15, 10**15, 10**15), (10**12 + 1, 10**15, 10**13 - 1), (3, 7, 11), (10, 10**18, 10**18)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select("a", "l", "r", phrases._score("a", "l", "r").alias("s"))
    assert all(r["s"] == 1000000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_keys_of_both_widths():
    rng = np.random.default_rng(1)
    for dense, top in ((True, 1 << 21), (False, 1 << 63)):
        ids = [rng.integers(1, top, 500) * (1 if dense else rng.choice([-1, 1], 500)) for _ in range(3)]
        keys = phrases._packed(ids, dense)
        assert all((a == b).all() for a, b in zip(ids, phrases._unpacked(keys, 3, dense)))
        order = np.argsort(keys)
        raw = keys.astype(">u8") if dense else keys
        assert order.tolist() == sorted(range(500), key=lambda i: raw[i : i + 1].tobytes())
