"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Features are words and word beginnings of four to eight characters. A bounded sample of labelled rows (``sample`` per
class, those with the smallest hash of their id, near-copies left out) gives the examples and the vocabulary: features
whose odds in toxic examples are surely higher, at most ``FEATURES`` of them. Everything else covers all documents:
each text is reduced to its counts of the vocabulary's features, document frequencies are counted over all of them,
and every document is scored.

The index holds, per feature, postings in blocks of example numbers with the largest weight per block. For a document
the blocks' upper bounds are sums of its weights times those maxima; blocks are scored by falling bound until none can
reach the kth similarity, so the ``K`` nearest are exact (ties to the smaller example number). Votes weigh 1 /
(distance + ``NEAR``) times how many labelled rows an example of its class stands for, and one vote of the base rate,
so a score estimates the share of toxic rows among equally close ones. A text without any feature gets the share among
the examples without features. The nearest examples' ids are returned as evidence.

Defined cases: null text counts as empty; empty texts get the score of texts without features; texts of any length are
read whole; rows that repeat score alike; ids without or with a null label teach nothing, an id labelled twice teaches
what the larger label says; without examples of both classes every score is the base rate (0 without any label); an
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.llm.common import as_bytes, as_text, some_rows
from tidefolio.session import hand_off

#: Bounds of the labelled sample: toxic examples, others.
SAMPLE = (1500, 4500)
FEATURES = 4096
BEGINNINGS = (4, 5, 6, 7, 8)
HEAD = min(BEGINNINGS)
#: A feature's least share of the toxic examples, how many standard errors its log odds ratio must be above zero, and the
#: ratio that must be surely exceeded (``LIMIT`` standard errors).
LEAST_SHARE = 0.01
SURE = 3.3
ODDS = 4.0
LIMIT = 1.96
K = 15
NEAR = 0.05
BLOCK = 64
THRESHOLD = 0.7
SHINGLE = 5
SKETCHES = 8
SEED = 11
WORDS = re.compile(r"\w+")


def features(text: str) -> Counter:
    """Words and, marked by ``^``, their shorter beginnings."""
    words = Counter(WORDS.findall(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        for m in BEGINNINGS:
            if len(w) > m:
                out["^" + w[:m]] += n
    return out


class Vectorizer:
    """Counts of the vocabulary's features."""

    def __init__(self, names: list[str]):
        self.words = {f: i for i, f in enumerate(names) if not f.startswith("^")}
        self.beginnings = {f[1:]: i for i, f in enumerate(names) if f.startswith("^")}
        self.lengths = sorted({len(f) for f in self.beginnings})
        #: How any feature starts: most words are ruled out by this alone.
        self.heads = {f[:HEAD] for f in (*self.words, *self.beginnings)}

    def count(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        words, beginnings, lengths, heads = self.words, self.beginnings, self.lengths, self.heads
        for w, n in Counter(WORDS.findall(text.lower())).items():
            if w[:HEAD] not in heads:
                continue
            if w in words:
                out[words[w]] = out.get(words[w], 0) + n
            for m in lengths:
                if len(w) <= m:
                    break
                if (start := w[:m]) in beginnings:
                    out[beginnings[start]] = out.get(beginnings[start], 0) + n
        return out


class BlockMaxIndex:
    """Exact top-k cosine over weighted, normalised examples."""

    def __init__(self, vectors: list[dict[int, float]]):
        postings: dict[int, list[tuple[int, float]]] = {}
        for at, vector in enumerate(vectors):
            for f, w in vector.items():
                postings.setdefault(f, []).append((at, w))
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.lists = {}
        for f, entries in postings.items():
            at, w = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
            blocks, begin = np.unique(at // BLOCK, return_index=True)
            most = np.maximum.reduceat(w, begin)
            self.lists[f] = (at, w, blocks, np.append(begin, len(at)), most)

    def top(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the k best examples that share a feature, best first."""
        bound = np.zeros(self.blocks)
        terms = [(w, *self.lists[f]) for f, w in sorted(vector.items()) if f in self.lists]
        for w, _, _, blocks, _, most in terms:
            bound[blocks] += w * most
        order = np.argsort(-bound, kind="stable")
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for block in order:
            if bound[block] <= 0 or (len(best) == k and bound[block] < best[-1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            for w, at, weights, blocks, begin, _ in terms:
                place = np.searchsorted(blocks, block)
                if place < len(blocks) and blocks[place] == block:
                    lo, hi = begin[place], begin[place + 1]
                    score[at[lo:hi] - block * BLOCK] += w * weights[lo:hi]
            some = np.nonzero(score > 0)[0]
            all_at = np.concatenate([best_at, some + block * BLOCK])
            all_score = np.concatenate([best, score[some]])
            first = np.lexsort((all_at, -all_score))[:k]
            best_at, best = all_at[first], all_score[first]
        return best_at, best


@dataclass
class Model:
    """All that scoring needs; its size is bounded by ``SAMPLE`` and ``FEATURES``."""

    vectorizer: Vectorizer
    idf: np.ndarray
    index: BlockMaxIndex
    example_ids: np.ndarray
    votes: np.ndarray
    toxic: np.ndarray
    base: float
    without: float

    def weigh(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {f: (1 + np.log(n)) * self.idf[f] for f, n in counts.items()}
        norm = float(np.sqrt(sum(w * w for w in raw.values())))
        return {f: float(w) / norm for f, w in raw.items()} if norm else {}

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        """Score and the ids of the nearest examples."""
        if not counts:
            return self.without, []
        at, similarity = self.index.top(self.weigh(counts), K)
        if not len(at):
            return self.base, []
        weight = self.votes[at] / (np.maximum(1 - similarity, 0) + NEAR)
        share = (float((weight * self.toxic[at]).sum()) + self.base) / (float(weight.sum()) + 1)
        return min(max(share, 0.0), 1.0), self.example_ids[at].tolist()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _narrow(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def without_copies(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic) of a bounded (doc_id, text, toxic), one per group of copies and near-copies in a class, so that
    features of one text do not count as evidence from many.

    Rows that share one of ``SKETCHES`` smallest shingle hashes are taken for copies; the sample is small enough to be
    gone through on the driver.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
        for b in some_rows(batches):
            out = []
            for text in as_bytes(b.column(1)):
                words = text.lower().split()
                grams = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))) or [b" ".join(words)]
                hashes = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams))
                out.append([int((hashes * f).min() >> np.uint64(1)) for f in factors])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "toxic", "least"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(sketch, "doc_id long, toxic int, least array<long>").collect()
    seen: set[tuple] = set()
    kept: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["least"])):
        marks = {(r["toxic"], i, x) for i, x in enumerate(r["least"])}
        if not marks & seen:
            kept.setdefault(r["doc_id"], r["toxic"])
        seen |= marks
    return sample.sparkSession.createDataFrame(list(kept.items()), "doc_id long, toxic int")


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, features) of every document: array<struct<f, n>> of its counts."""
    learned = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    learned = learned.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    learned = learned.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learned = hand_off(learned.join(docs.select("doc_id"), "doc_id", "left_semi"), "tox-labels")
    rows = {r[0]: r[1] for r in learned.groupBy("toxic").agg(F.count("*")).collect()}
    n_toxic, n_other = rows.get(1, 0), rows.get(0, 0)
    chosen = [learned.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m) for c, m in ((1, sample[0]), (0, sample[1]))]
    picked = hand_off(chosen[0].union(chosen[1]), "tox-sample")
    # At most sum(sample) ids, so this side may be broadcast at any scale.
    picked = without_copies(docs.join(F.broadcast(picked), "doc_id"))
    n_picked = {r[0]: r[1] for r in picked.groupBy("toxic").agg(F.count("*")).collect()}
    texts = docs.join(F.broadcast(picked), "doc_id")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            tallies: tuple[Counter, Counter] = (Counter(), Counter())
            for t, c in zip(as_text(b.column(0)), b.column(1).to_pylist(), strict=True):
                tallies[1 if c else 0].update(features(t).keys())
            names = list(tallies[0] | tallies[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), *[pa.array([tallies[c][f] for f in names], pa.int64()) for c in (1, 0)]], ["feature", "a", "b"]
            )

    counted = texts.select("text", "toxic").mapInArrow(tally, "feature string, a long, b long")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    ours, others = n_picked.get(1, 0), n_picked.get(0, 0)
    c, d = F.greatest(F.lit(ours) - F.col("a"), F.lit(0)) + 0.5, F.greatest(F.lit(others) - F.col("b"), F.lit(0)) + 0.5
    log_odds, error = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    chosen_features = (
        counted.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter(F.col("a") >= max(5, LEAST_SHARE * ours))
        .withColumn("odds", log_odds - LIMIT * error)
        .filter((F.col("odds") > float(np.log(ODDS))) & (log_odds > SURE * error))
        .orderBy(F.col("odds").desc(), "feature").limit(FEATURES)
    )
    names = sorted(r["feature"] for r in chosen_features.select("feature").collect())
    vectorizer = Vectorizer(names)

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            counts = [[{"f": f, "n": n} for f, n in sorted(vectorizer.count(t).items())] for t in as_text(b.column(1))]
            kind = pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, kind)], ["doc_id", "features"])

    vectors = hand_off(docs.mapInArrow(reduce_texts, "doc_id long, features array<struct<f:int,n:int>>"), "tox-vectors")
    total = vectors.count()
    frequency = vectors.select(F.explode("features.f").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    idf = np.full(len(names), np.log(1 + total) + 1)
    for r in frequency:
        idf[r["f"]] = np.log((1 + total) / (1 + r["n"])) + 1
    # A row of each example; ids that repeat bring one each, of the first by contents.
    examples = vectors.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("features").alias("features"))
    examples = sorted(examples.collect(), key=lambda r: (r["features"], r["doc_id"]))
    stands_for = (n_other / max(1, others), n_toxic / max(1, ours))
    base = n_toxic / (n_toxic + n_other) if n_toxic + n_other else 0.0
    some = [r for r in examples if r["features"]]
    none = [stands_for[r["toxic"] and 1] * np.array([1, r["toxic"]]) for r in examples if not r["features"]]
    without = base
    if none:
        weight, toxic = np.sum(none, axis=0)
        without = float((toxic + base) / (weight + 1))
    model = Model(
        vectorizer, idf, BlockMaxIndex([]), np.array([r["doc_id"] for r in some], np.int64),
        np.array([stands_for[1 if r["toxic"] else 0] for r in some]), np.array([1.0 if r["toxic"] else 0.0 for r in some]), base, without,
    )
    model.index = BlockMaxIndex([model.weigh({x["f"]: x["n"] for x in r["features"]}) for r in some])
    return model, vectors


def score_documents(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", sample: tuple[int, int] = SAMPLE
) -> DataFrame:
    """One row per document: doc_id, score and evidence (ids of the nearest examples, best first)."""
    model, vectors = fit(_narrow(docs, id_col, text), labels, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            scores, evidence = [], []
            for counts in b.column(1).to_pylist():
                score, ids = model.score({x["f"]: x["n"] for x in counts})
                scores.append(score)
                evidence.append(ids)
            arrays = [b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "evidence"])

    return vectors.mapInArrow(judge, "doc_id long, score double, evidence array<long>")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", sample: tuple[int, int] = SAMPLE
) -> DataFrame:
    """``docs`` without the rows whose score reaches ``THRESHOLD``; each row is judged on its own text."""
    model, _ = fit(_narrow(docs, id_col, text), labels, sample)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(model.vectorizer.count(t))[0] for t in texts.fillna("")], dtype=float)

    return docs.filter(score(F.coalesce(F.col(f"`{text}`"), F.lit(""))) < THRESHOLD)
