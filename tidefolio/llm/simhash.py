"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: words of the A-Z lower-cased text, 3-word shingles with repeats, XXH64 (seed 42) of each; a bit is 1 if
it is set in more than half of the hashes. Distinct fingerprints only go on; copies meet again at the end.

Covering masks: bit position i gets a label of ``radius + 1`` bits, not zero; the table of a vector v keeps the
positions whose label has an odd scalar product with v. For any ``radius`` positions some v is orthogonal to all their
labels, so two fingerprints that differ in at most ``radius`` bits agree on all that this table keeps: every pair
within the radius meets in one of the ``2 ** (radius + 1) - 1`` tables, with certainty.

Buckets: a bucket of two fingerprints is decided from its minimum and maximum. In a larger one no pairs are formed:
every fingerprint is sent to itself and to its neighbours at one flipped bit outside its buckets' masks. Two
fingerprints that share such a hub differ in at most two bits, and those of one bucket that differ in no more do share
one; each hub links its members to its smallest one. Rows grow with the number of fingerprints, never with the square
of a bucket. Components come from alternating star contraction over the links, written to the shared folder after
every round.

Defined cases: null text counts as empty; a text without words has fingerprint zero and is linked like any other; one
or two words form one shingle; texts of any length are read whole; rows that repeat each get their row back; a null
doc_id gets the component of its fingerprint, whose id is the smallest one that is not null (null if there is none);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidefolio.llm.common import as_bytes, some_rows
from tidefolio.session import hand_off

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Hashes unpacked at a time.
SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, fp): the fingerprint as a signed long, and a hash that tells texts of one id apart."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some_rows(batches):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "tie", "fp"])

    body = F.col(f"`{text}`")
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tie"))
    return narrow.mapInArrow(per_batch, "doc_id long, tie long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The bits each table keeps; labels run through the non-zero vectors in turn, so the tables are even."""
    vectors = range(1, 2 ** (radius + 1))
    labels = [1 + i % len(vectors) for i in range(BITS)]
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs, a < b, that connect exactly the distinct fingerprints within ``radius`` (0, 1 or 2) bits.

    Pairs are real links; of the links inside a crowded bucket those to each hub's smallest member are given, which
    leaves the components as they are.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius is 0, 1 or 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    kept = [(F.lit(i).alias("t"), F.lit(m).cast("long")) for i, m in enumerate(masks)]
    keys = F.array(*[F.struct(t, F.col("fp").bitwiseAND(m).alias("key"), m.alias("mask")) for t, m in kept])
    rows = hand_off(fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key", "k.mask"), "simhash-keys")
    buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    twos = buckets.filter("n = 2").select("a", "b").filter(_near(F.col("a"), F.col("b"), radius))
    crowded = rows.join(buckets.filter("n > 2").select("t", "key"), ["t", "key"])
    # A fingerprint is sent out once, however many crowded buckets it is in: over all bits that some of their masks leave out.
    sent = crowded.groupBy("fp").agg(F.bit_or(F.bitwise_not("mask")).alias("open"))
    every = F.array(*[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    flips = F.filter(every, lambda bit: bit.bitwiseAND(F.col("open")) != 0)
    own = F.array(F.col("fp"))
    reach = F.concat(own, F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))) if radius else own
    hubs = sent.select("fp", F.explode(reach).alias("hub"))
    if radius == 1:  # a shared hub may stand for two bits; only hubs that are members themselves are links of one bit
        met = hubs.filter("fp != hub").join(fps.select(F.col("fp").alias("hub")), "hub")
        stars = met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    else:
        first = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
        stars = hubs.join(first.select("hub", "a"), "hub").filter("fp > a").select("a", F.col("fp").alias("b"))
    return twos.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (a, b) of longs.

    Alternates two contractions until nothing changes: larger neighbours move to the smallest neighbour, then all
    neighbours that are not larger do. Each round is a minimum per node, written to the shared folder.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = hand_off(ordered.filter("u != v").distinct(), "stars")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = others.union(least.select("u", F.col("m").alias("v")))
        pairs = hand_off(small.filter("u != v").distinct(), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
    return pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def grouped(df: DataFrame, *, id_col: str, text: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, tie, fp) of every row, and (fp, root, first_id) of every fingerprint: its component's smallest
    fingerprint and its own smallest doc_id."""
    docs = hand_off(fingerprints(df, id_col=id_col, text=text, shingle=shingle), "simhash")
    firsts = hand_off(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(firsts.select("fp"), radius))
    # A fingerprint without links is its own root.
    rooted = firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return docs, rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first_id")


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id."""
    docs, rooted = grouped(df, id_col=id_col, text=text, shingle=shingle, radius=radius)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    df: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (null last), its texts in the order of a hash."""
    docs, rooted = grouped(df, id_col=id_col, text=text, shingle=shingle, radius=radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    per_fp = docs.groupBy("fp").agg(first.alias("first"))
    kept = per_fp.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    keys = kept.select(F.struct("first.doc_id", "first.tie").alias("key"))
    own = F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"))
    rows = df.select(own.alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    # Rows equal in id and text meet in the join's own partitions, where one is left.
    single = rows.join(keys, "key", "left_semi").dropDuplicates(["key"])
    return single.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
