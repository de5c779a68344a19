"""Fingerprints and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidefolio.llm import simhash as H


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values, radius=2):
    """values: {id: fingerprint}; the smallest id reachable from each."""
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair():
    for radius in (1, 2):
        masks = H.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for a in range(64):
            for b in range(a, 64) if radius == 2 else [a]:
                change = (1 << a) | (1 << b)
                assert any(m & change == 0 for m in masks)


def test_documents_against_brute_force(spark, documents):
    rnd = random.Random(2)
    words = ["w%d" % i for i in range(300)]
    texts = [None, "", "  \n", "One", "one", "ONE two", "one two", "É é İ", "x" * 50_000, " ".join(["a"] * 40_000)]
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randint(1, 200))
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[rnd.randrange(len(near))] = rnd.choice(words)
            texts.append("\t".join(near))
    texts += [texts[20]] * 50
    df = documents(texts).withColumn("fp", F.lit("clash")).withColumn("hub", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in H.near_duplicates(df).collect()}
    values = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    roots = plain_components(values)
    assert got == {i: (f"{values[i]:016x}", roots[i]) for i in values}
    kept = H.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(roots.values()))


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_and_components_of_crowded_buckets(spark, radius):
    rnd = random.Random(radius)
    values = set()
    for _ in range(6):
        base = rnd.getrandbits(64)
        values.add(base)
        for _ in range(60):  # many within a few bits of each other, and chains of them
            base ^= 1 << rnd.choice([3, 9, 17, 28, 39, 40, 41, 55, 63])
            if rnd.random() < 0.5:
                base ^= 1 << rnd.randrange(64)
            values.add(base)
    values = list(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = H.links(fps, radius)
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= radius
    got = {r.node: r.root for r in H.components(edges).collect()}
    want = plain_components({s: v for s, v in zip(signed, values)}, radius)
    assert {s: got.get(s, s) for s in signed} == want


def test_repeated_rows_null_ids_and_empty(spark, documents):
    df = documents([(7, "a b c d", "s"), (7, "a b c d", "s"), (None, "a b c d", "s"), (None, "zz", "s"), (3, None, "s"), (5, "", "s")])
    got = sorted(((r.doc_id, r.component_id) for r in H.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None), (3, 3), (5, 3)], key=str)
    assert sorted(((r.doc_id, r.text) for r in H.keep_one(df).collect()), key=str) == sorted([(7, "a b c d"), (None, "zz"), (3, None)], key=str)
    assert H.near_duplicates(documents([])).count() == 0 and H.keep_one(documents([])).count() == 0
