"""MinHash components against comparison of all pairs, and the pigeonhole guarantee of the keys."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, odd_rows

from tickloom.llm import minhash_join as m
from tickloom.llm.hashing import ordered_sets, shingle_hashes


def test_signatures_within_the_guarantee_share_a_key():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 256, m.SLOTS, np.uint8)
        b = a.copy()
        at = rng.choice(m.SLOTS, m.GUARANTEED, replace=False)
        b[at] ^= np.uint8(1)
        ka, kb = m.chunk_keys(np.stack([a, b]))
        assert set(ka) & set(kb) and len(set(ka)) == m.CHUNKS * len(m._KEPT)
        wrong = [sum(a[c : c + m.CHUNK] != b[c : c + m.CHUNK]) for c in range(0, m.SLOTS, m.CHUNK)]
        shared = sum(1 if w == 1 else len(m._KEPT) if w == 0 else 0 for w in wrong)
        assert len(set(ka) & set(kb)) == shared


def test_slots_agree_as_often_as_jaccard():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(1200)]
    texts = []
    for _ in range(60):
        base = rng.sample(words, 200)
        texts += [" ".join(base), " ".join(base[:178] + rng.sample(words, 22))]
    owner, h = shingle_hashes([t.encode() for t in texts], 1)
    owner, h, first = ordered_sets(owner, h, np.zeros(len(h), np.uint16))
    sig = m.signatures(h, first)
    sets = [set(t.split()) for t in texts]
    real = np.array([len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])])
    got = (sig[::2] == sig[1::2]).mean(1)
    assert abs((got - real).mean()) < 0.02 and np.abs(got - real).max() < 0.2
    other = (sig[::2][1:] == sig[1::2][:-1]).mean()
    assert other < 0.2


def test_distance_counts_differing_slots(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, m.SLOTS), np.uint8)
    b = np.where(rng.random((40, m.SLOTS)) < 0.3, rng.integers(0, 256, (40, m.SLOTS), np.uint8), a).astype(np.uint8)
    row = lambda x, y, i: (*map(int, m._packed(x[None])[0]), *map(int, m._packed(y[None])[0]), i)
    names = ", ".join([f"{s}_{c} bigint" for s in "xy" for c in m.SIGNATURE] + ["i int"])
    df = spark.createDataFrame([row(x, y, i) for i, (x, y) in enumerate(zip(a, b))], names)
    assert [r["d"] for r in df.select(m._distance("x_", "y_").alias("d"), "i").orderBy("i").collect()] == (a != b).sum(1).tolist()


def test_each_pair_comes_from_one_list(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (200, m.SLOTS), np.uint8)
    b = np.where(rng.random((200, m.SLOTS)) < rng.choice([0.0, 0.1, 0.4, 0.9], (200, 1)), rng.integers(0, 256, (200, m.SLOTS), np.uint8), a).astype(np.uint8)
    names = "x array<bigint>, y array<bigint>, i int, k bigint"
    keys = [sorted(set(x) & set(y)) for x, y in zip(m.chunk_keys(a).tolist(), m.chunk_keys(b).tolist())]
    x, y = m._packed(a).tolist(), m._packed(b).tolist()
    df = spark.createDataFrame([(x[i], y[i], i, k) for i in range(200) for k in keys[i]], names)
    found = [r["i"] for r in df.where(m._first_list("k", "x", "y")).collect()]
    assert sorted(found) == [i for i in range(200) if keys[i]] and 60 < len(found) < 200


def swarms():
    """Texts of few and many words with copies, near copies around the threshold, and chains of near copies."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["Ä", "日本"]
    out = []
    for n in (1, 2, 3, 4, 5, 6, 9, 20, 60, 300):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(6):
                some = list(base)
                for i in rng.sample(range(n), min(n, rng.randint(0, max(1, n // 12)))):
                    some[i] = rng.choice(words)
                out.append(" ".join(some).upper() if rng.random() < 0.2 else "\n ".join(some))
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(0, 60, 4):
        chain[i] = rng.choice(words)
        out.append(" ".join(chain))
    return out


@pytest.mark.parametrize(("rounds", "probes", "words"), [(2, 3, 2), (1, 1, 2), (3, 1, 5)])
def test_components_equal_all_pairs(spark, monkeypatch, rounds, probes, words):
    monkeypatch.setattr(m, "ROUNDS", rounds)
    monkeypatch.setattr(m, "PROBES", probes)
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(swarms())]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(swarms())], "doc_id bigint, text string")
    docs = spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "text").union(more).withColumn("n", F.lit("clash")).withColumn("key", F.lit(1)).repartition(4)
    out = m.minhash_components(docs, words=words).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, out), key=repr) == brute.components(rows, words, 80)


def test_nothing_to_join(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    assert m.minhash_components(docs.limit(0)).count() == 0
    assert m.minhash_components(docs.where("text IS NULL")).count() == docs.where("text IS NULL").count()
    with pytest.raises(ValueError, match="80"):
        m.minhash_components(docs, percent=70)
