"""Phrase collocation mining with counting quotient filters.

Words are runs without space and tab inside pieces, which end at ``.,;:!?`` and line ends; A-Z are lower-cased. A word's id
is the 64-bit xxHash of (salt, language, word); the table of all distinct words shows whether two share an id, and if they
do, the next salt is taken, so ids stand for words without loss and no task needs the vocabulary. A phrase is the ids of its
words side by side.

A phrase is counted as follows. Its ids are permuted invertibly as one block of 64 bits a word. The first bits of the block
name a shard, the next ones are the quotient, all others are the remainder, kept in full: a filter is the number of entries
per quotient, the remainders in order and a counter each (one byte, larger ones aside), and gives back every phrase with its
exact count. Each task fills a filter from its documents, a bounded number of entries at a time, and writes it out by shard;
the sorted filters of a shard are merged, whatever number of documents they come from. A phrase that is a third of all
words is one counter per filter.

Phrases of two, three and four words are counted in turn. A phrase can only be frequent if both phrases without its last
and first word are, so a pass skips those whose parts miss in a bitmap of the frequent shorter phrases. The bitmap has a
fixed largest size; what collides in it is counted for nothing, never lost.

Defined cases: null text is empty, null language is ``und``; empty texts and languages without words give nothing; a text of
any length is read in pieces; rows that repeat count again; ties are ordered as the caller's order says; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidefolio.llm.common import some_rows
from tidefolio.session import hand_off

LEAST = 30
MOST_WORDS = 4
TOP = 2000
NO_LANGUAGE = "und"
COVERED = 80  # per cent of a phrase's occurrences inside a longer one that make it redundant
SCALE = 2_000_000

SLICE_BYTES = 1 << 21
HELD_ENTRIES = 1 << 20
#: Occurrences per shard that bound a shard's memory when merged.
SHARD_WORDS = 1 << 22
LEAST_SHARDS = 64
RANK_PARTS = 256
MOST_BITS = 1 << 28
BITS_PER_ENTRY = 16
HASH_SEED = 42

PIECE_END = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(PIECE_END)] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = re.compile(b"[" + re.escape(PIECE_END) + b"]")

#: Odd multipliers of the permutation.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_INVERSE = np.array([pow(int(m), -1, 1 << 64) for m in _MIX], np.uint64)
_ROUNDS = 2


# --- words --------------------------------------------------------------------------------------------------------

def slices_by_language(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(language, text) from (lang, text): texts of a language side by side, pieces kept apart, about a slice at a time."""
    held: dict[bytes, list[bytes]] = {}
    size: dict[bytes, int] = {}
    langs, texts = (batch.column(k).cast(pa.large_binary()) for k in range(2))
    for lang, text in zip(langs, texts):
        lang, text = lang.as_py(), (text.as_py() or b"").translate(_LOWER)
        lang = NO_LANGUAGE.encode() if lang is None else lang
        at = 0
        while at < len(text):
            cut = _END.search(text, at + SLICE_BYTES)
            end = cut.end() if cut else len(text)
            held.setdefault(lang, []).append(text[at:end])
            size[lang] = size.get(lang, 0) + end - at
            at = end
            if size[lang] >= SLICE_BYTES:
                size.pop(lang)
                yield lang, b"\n".join(held.pop(lang))
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def words_of(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a lower-cased text in order, and the number of the piece each stands in."""
    data = np.frombuffer(text, np.uint8)
    kind = _CLASS[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    body = data[kind == 0]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    pieces = np.cumsum(kind == 2, dtype=np.int32)
    return words.dictionary_encode(), pieces[starts]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches):
            for lang, text in slices_by_language(batch):
                words, _ = words_of(text)
                if len(words):
                    f = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                    named = pa.array([lang.decode()] * len(f), pa.string())
                    word = words.dictionary.cast(pa.large_string()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([named, word, pa.array(f, pa.int64())], names=["lang", "word", "f"])

    counted = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, word string, f bigint")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_id(salt: int, lang: Column, word: Column) -> Column:
    """The id of a word, a long; ``ids_of`` makes the same."""
    head = F.concat(F.lit(f"{salt}:"), F.octet_length(lang).cast("string"), F.lit(":"), lang, F.lit(":"), word)
    return F.xxhash64(head)


def ids_of(salt: int, lang: bytes, words: list[bytes]) -> np.ndarray:
    head = f"{salt}:{len(lang)}:".encode() + lang + b":"
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(head + w, HASH_SEED) for w in words), np.uint64, len(words))


def id_bytes(number: Column) -> Column:
    """A long as eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def named_words(words: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``id`` to (lang, word, f), with a salt under which no two words share one."""
    for salt in range(64):
        named = words.withColumn("id", word_id(salt, F.col("lang"), F.col("word")))
        if named.groupBy("id").count().where("count > 1").isEmpty():
            return named, salt
    raise RuntimeError("no salt keeps all words apart")


# --- permutation and filters --------------------------------------------------------------------------------------

def permuted(blocks: np.ndarray) -> np.ndarray:
    """Each row of 64-bit words under a fixed invertible permutation; the first word depends on all."""
    out, n = blocks.copy(), blocks.shape[1]
    for r in range(_ROUNDS):
        for k in reversed(range(n)):
            x = out[:, k]
            if n > 1:
                x ^= (out[:, (k + 1) % n] + _MIX[r]) * _MIX[2]
            x *= _MIX[r]
            x ^= x >> np.uint64(32)
    return out


def restored(blocks: np.ndarray) -> np.ndarray:
    """What ``permuted`` was given."""
    out, n = blocks.copy(), blocks.shape[1]
    for r in reversed(range(_ROUNDS)):
        for k in range(n):
            x = out[:, k]
            x ^= x >> np.uint64(32)
            x *= _INVERSE[r]
            if n > 1:
                x ^= (out[:, (k + 1) % n] + _MIX[r]) * _MIX[2]
    return out


def merged(blocks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order of their words, counts summed. Runs that are in order already merge quickly."""
    if not len(blocks):
        return blocks, counts
    order = np.argsort(blocks[:, 0], kind="stable")
    ranked = blocks[order]
    new = np.any(ranked[1:] != ranked[:-1], axis=1)
    if np.any(new & (ranked[1:, 0] == ranked[:-1, 0])):  # unlike rows with the same first word
        order = np.lexsort(blocks.T[::-1])
        ranked = blocks[order]
        new = np.any(ranked[1:] != ranked[:-1], axis=1)
    first = np.concatenate(([0], np.flatnonzero(new) + 1))
    return ranked[first], np.add.reduceat(counts[order], first)


_HEAD = "<BQBBBQ"


def pack(blocks: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """The filter of sorted distinct permuted blocks of one shard: entries per quotient, remainders, counters."""
    m, n = blocks.shape
    bits = min(max(int(m - 1).bit_length(), 1), 24)
    first = blocks[:, 0] << np.uint64(shard_bits)
    runs = np.bincount((first >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    run_bytes = 1 if runs.max() < 256 else 8
    rest_bytes = (64 - bits + 7) // 8
    rest = (first & np.uint64((1 << 64 - bits) - 1)).astype("<u8").view(np.uint8).reshape(m, 8)[:, :rest_bytes]
    large = counts >= 255
    return b"".join(
        (
            struct.pack(_HEAD, n, m, bits, run_bytes, rest_bytes, int(large.sum())),
            runs.astype(f"<u{run_bytes}").tobytes(),
            np.ascontiguousarray(rest).tobytes(),
            np.ascontiguousarray(blocks[:, 1:], "<u8").tobytes(),
            np.where(large, 255, counts).astype(np.uint8).tobytes(),
            counts[large].astype("<u8").tobytes(),
        )
    )


def unpack(data: bytes, shard: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks and counts that ``pack`` was given."""
    n, m, bits, run_bytes, rest_bytes, larger = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    quotient = np.repeat(np.arange(1 << bits, dtype=np.uint64), take(1 << bits, f"<u{run_bytes}").astype(np.int64))
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :rest_bytes] = take(m * rest_bytes, "u1").reshape(m, rest_bytes)
    first = (quotient << np.uint64(64 - bits)) | wide.view("<u8")[:, 0]
    blocks = np.empty((m, n), np.uint64)
    blocks[:, 0] = first >> np.uint64(shard_bits)
    if shard_bits:
        blocks[:, 0] |= np.uint64(shard) << np.uint64(64 - shard_bits)
    blocks[:, 1:] = take(m * (n - 1), "<u8").reshape(m, n - 1)
    counts = take(m, "u1").astype(np.uint64)
    counts[counts == 255] = take(larger, "<u8")
    return blocks, counts


class Filling:
    """A filter in the making: blocks are merged as they come and given out by shard when many are held."""

    def __init__(self, n: int, shard_bits: int):
        self.n, self.shard_bits = n, shard_bits
        self.blocks, self.counts = np.empty((0, n), np.uint64), np.empty(0, np.uint64)

    def add(self, blocks: np.ndarray) -> None:
        fresh = merged(blocks, np.ones(len(blocks), np.uint64))
        self.blocks, self.counts = merged(np.concatenate((self.blocks, fresh[0])), np.concatenate((self.counts, fresh[1])))

    def give(self) -> Iterator[tuple[int, bytes]]:
        shift = np.uint64(64 - self.shard_bits)
        shards = (self.blocks[:, 0] >> shift).astype(np.int64)
        found, starts = np.unique(shards, return_index=True)
        for shard, a, b in zip(found, starts, [*starts[1:], len(shards)]):
            yield int(shard), pack(self.blocks[a:b], self.counts[a:b], self.shard_bits)
        self.__init__(self.n, self.shard_bits)


# --- counting -----------------------------------------------------------------------------------------------------

def bitmap(frequent: DataFrame, mark: str) -> np.ndarray:
    """Bits set at the marks (longs) of the rows, modulo the size; at most ``MOST_BITS`` of them reach the driver."""
    size = 1 << 15
    count = frequent.count()
    while size < min(count * BITS_PER_ENTRY, MOST_BITS):
        size *= 2
    at = (F.col(mark).bitwiseAND(F.lit(size - 1)) + 1).alias("at")
    parts = (
        frequent.select(at)
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )
    out = np.zeros(size >> 3, np.uint8)
    for row in parts.toLocalIterator():
        out[(row.bucket - 1) << 12 : row.bucket << 12] = np.frombuffer(row.bits, np.uint8)
    return out


def marked(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks & np.uint64(bits.size * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, n)


def count_phrases(docs: DataFrame, n: int, salt: int, shorter: np.ndarray, shard_bits: int, least: int) -> DataFrame:
    """(key, f, mark) of the phrases of ``n`` words that occur ``least`` times; ``shorter`` marks those of ``n - 1``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(shorter)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling = Filling(n, shard_bits)

        def out():
            rows = list(filling.give())
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "part"]
            )

        for batch in some_rows(batches):
            for lang, text in slices_by_language(batch):
                words, pieces = words_of(text)
                if len(words) < n:
                    continue
                ids = ids_of(salt, lang, words.dictionary.to_pylist())[words.indices.to_numpy()]
                known = marked(sent.value, permuted(windows(ids, n - 1))[:, 0])
                whole = (pieces[n - 1 :] == pieces[: len(pieces) - n + 1]) & known[1:] & known[:-1]
                filling.add(permuted(windows(ids, n)[whole]))
                if len(filling.counts) >= HELD_ENTRIES:
                    yield out()
        if len(filling.counts):
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, waiting, size = None, (np.empty((0, n), np.uint64), np.empty(0, np.uint64)), [], 0

        def settle():
            nonlocal held, waiting, size
            held = merged(*(np.concatenate(x) for x in zip(held, *waiting)))
            waiting, size = [], 0

        def out():
            settle()
            often = held[1] >= least
            blocks = held[0][often]
            keys = np.ascontiguousarray(restored(blocks), ">u8").view(f"V{8 * n}").reshape(-1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                    pa.array(held[1][often].astype(np.int64)),
                    pa.array(blocks[:, 0].view(np.int64)),
                ],
                names=["key", "f", "mark"],
            )

        for batch in some_rows(batches):
            for s, part in zip(batch.column(0), batch.column(1)):
                if shard is not None and s.as_py() != shard:
                    yield out()
                    held = (held[0][:0], held[1][:0])
                shard = s.as_py()
                waiting.append(unpack(part.as_py(), shard, shard_bits))
                size += len(waiting[-1][1])
                if size > len(held[1]) + HELD_ENTRIES:
                    settle()
        if shard is not None:
            yield out()

    filters = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(fill, "shard int, part binary")
    return filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "key binary, f bigint, mark bigint")


def frequent_phrases(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (n, key, f), frequent words (id, lang, word) and (lang, n), the number of all words.

    ``key`` is the ids of a phrase's words, eight bytes each; single words are phrases of length 1.
    """
    words = hand_off(word_counts(docs), "phrase-words")
    named, salt = named_words(words)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    everything = words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first().n
    shard_bits = max(LEAST_SHARDS, -(-everything // SHARD_WORDS)) - 1
    shard_bits = int(shard_bits).bit_length()
    known = hand_off(named.where(F.col("f") >= least), "phrase-vocabulary")
    # The mark of a phrase is the first word of its permuted block; for one word that is done here as for the others.
    level = known.select(id_bytes(F.col("id")).alias("key"), "f", _mark_of_word(F.col("id")).alias("mark"))
    tables = [level.select(F.lit(1).alias("n"), "key", "f")]
    for n in range(2, most_words + 1):
        level = hand_off(count_phrases(docs, n, salt, bitmap(level, "mark"), shard_bits, least), f"phrases-{n}")
        tables.append(level.select(F.lit(n).alias("n"), "key", "f"))
    phrases = tables[0]
    for t in tables[1:]:
        phrases = phrases.unionByName(t)
    return phrases, known.select(id_bytes(F.col("id")).alias("id"), "lang", "word"), totals


def _mark_of_word(number: Column) -> Column:
    """``permuted`` of one word, as a column."""

    @F.pandas_udf("bigint")
    def mark(ids):
        import pandas as pd

        return pd.Series(permuted(ids.to_numpy().view(np.uint64)[:, None])[:, 0].view(np.int64))

    return mark(number)


# --- scores -------------------------------------------------------------------------------------------------------

def exact(c) -> Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else F.lit(c).cast("decimal(20,0)")


def part(key: str, first: Column, words: Column) -> Column:
    """``words`` words of a key from word ``first`` (0 is the first)."""
    return F.substring(F.col(key), first * 8 + 1, words * 8)


def scored(phrases: DataFrame) -> DataFrame:
    """(n, key, a, l, r, score): each candidate's lowest cut, without candidates that longer ones cover."""
    several = phrases.where("n > 1").withColumnRenamed("f", "a")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select(
        "n", "key", "a", "k", part("key", F.lit(0), F.col("k")).alias("left"), part("key", F.col("k"), F.col("n") - F.col("k")).alias("right")
    )
    sides = cuts.join(phrases.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(
        phrases.select(F.col("key").alias("right"), F.col("f").alias("r")), "right"
    )
    value = F.call_function("div", exact(SCALE) * exact("a"), exact("l") + exact("r")).cast("bigint")
    lowest = sides.groupBy("n", "key", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"))
    inner = several.where("n > 2").select(
        "key", "n", "a", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("words")
    ).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("words"))))
    longest = inner.select(part("key", F.col("first"), F.col("words")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    open_ = lowest.join(longest, "key", "left").where(
        F.col("longer").isNull() | (exact(100) * exact("longer") < exact(COVERED) * exact("a"))
    )
    return open_.select("n", "key", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by score, count and phrase: lang, rank, phrase, a, l, r, n, score."""
    phrases, words, totals = frequent_phrases(docs, least=least, most_words=most_words)
    first = words.select(F.col("id").alias("head"), "lang")
    rows = scored(phrases).withColumn("head", part("key", F.lit(0), F.lit(1))).join(first, "head").drop("head")
    # Names are looked up for rows that can be among the first ones only, ties at the end included.
    # Parts of a language are ranked first, so that what meets in one task is bounded by the parts and ``top``.
    by_part = W.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(RANK_PARTS))).orderBy(F.desc("score"), F.desc("a"))
    near = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    for order in (by_part, near):
        rows = rows.withColumn("at", F.rank().over(order)).where(F.col("at") <= top)
    best = hand_off(rows, "phrases-best")
    places = best.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).withColumn(
        "id", part("key", F.col("pos"), F.lit(1))
    )
    spelled = (
        places.join(words.select("id", "word"), "id")
        .groupBy("key")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("phrase"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelled, "key").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals.withColumnRenamed("n", "n_words"), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"
    )
