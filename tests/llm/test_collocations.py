"""Collocations against a plain count; filters give back what they were given."""

import collections
import re

import numpy as np
import pytest

from tidefolio.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows = []
        for p, a in often.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(docs, **options):
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


def test_whole_table_equals_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    want = brute(rows, 30, 2000)
    assert want and mined(docs) == want
    assert mined(docs, least=10, top=50) == brute(rows, 10, 50)


def test_nulls_empty_ties_repeats_and_odd_characters(spark):
    texts = [None, "", " \t ", "a b a b a b", "A B\tC, d; a b", "x\x00y é世  z.\x0b\x0ca b c d e", "b a"] * 5
    texts += ["same words here again and again"] * 40 + ["a " * 3000]
    rows = [((None, "en", "", "und")[i % 4], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n bigint, key string")
    assert mined(docs, least=3) == brute(rows, 3, 2000)
    assert mined(docs, least=3, top=2) == brute(rows, 3, 2)
    assert mined(docs.limit(0)) == []


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    text = ("one two three four, " * 300 + "five six.") * 3
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", None]), pa.array([text, text])], names=["lang", "text"])
    monkeypatch.setattr(C, "SLICE_BYTES", 1000)
    parts = list(C.slices_by_language(batch))
    assert len(parts) > 10 and max(len(t) for _, t in parts) < 2100
    words = collections.Counter(lang for lang, t in parts for _ in C.words_of(t)[0])
    assert words == {b"en": 3 * 1202, b"und": 3 * 1202}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_permutation_and_filters_lose_nothing(n):
    rng = np.random.default_rng(n)
    blocks = rng.integers(0, 1 << 63, (500, n), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (500, n), dtype=np.uint64)
    blocks[:50] = blocks[50:100]
    assert (C.restored(C.permuted(blocks)) == blocks).all()
    counts = rng.integers(1, 1 << 40, 500).astype(np.uint64)
    ranked, total = C.merged(C.permuted(blocks), counts)
    assert len(ranked) == len(np.unique(blocks, axis=0)) and total.sum() == counts.sum()
    bits = 3
    back = []
    for shard in range(1 << bits):
        own = (ranked[:, 0] >> np.uint64(64 - bits)) == shard
        if own.any():
            x, y = C.unpack(C.pack(ranked[own], total[own], bits), shard, bits)
            back.append((x, y))
    assert (np.concatenate([x for x, _ in back]) == ranked).all() and (np.concatenate([y for _, y in back]) == total).all()


def test_equal_first_words_are_told_apart():
    blocks = np.array([[5, 2], [5, 1], [5, 2], [4, 9]], np.uint64)
    ranked, counts = C.merged(blocks, np.ones(4, np.uint64))
    assert ranked.tolist() == [[4, 9], [5, 1], [5, 2]] and counts.tolist() == [1, 1, 2]


def test_ids_agree_and_bitmaps_hold_every_mark(spark):
    rows = [("en", "a"), ("en", "é世"), ("d:e", "a"), ("d", "e:a")]
    table = spark.createDataFrame(rows, "lang string, word string").withColumn("id", C.word_id(3, C.F.col("lang"), C.F.col("word")))
    for r in table.collect():
        assert np.uint64(r.id & (1 << 64) - 1) == C.ids_of(3, r.lang.encode(), [r.word.encode()])[0]
    marks = spark.range(-3000, 3000).select((C.F.col("id") * 7919).alias("mark"))
    bits = C.bitmap(marks, "mark")
    known = np.array([r.mark for r in marks.collect()], np.int64).view(np.uint64)
    assert C.marked(bits, known).all() and C.marked(bits, np.arange(1 << 17, dtype=np.uint64)).mean() < 0.1


def test_shared_ids_take_the_next_salt(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 40), ("en", "b", 40)], "lang string, word string, f bigint")
    whole = C.word_id
    monkeypatch.setattr(C, "word_id", lambda salt, lang, word: C.F.lit(0).cast("long") if salt < 2 else whole(salt, lang, word))
    named, salt = C.named_words(words)
    assert salt == 2 and named.select("id").distinct().count() == 2
