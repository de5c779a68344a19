"""Mixing sources to target weights, with DataFrame functions only.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share 150 % of all words; a target
stops at twice its source's words and the excess goes to the others by weight. With the sources by rising ratio of cap
to weight, the ones that stop are a prefix, so one running sum over the sources finds the level.

Blocks: the words of a source, in the order of its documents, are one stream cut into blocks of ``block_words``; the
last block is what is left. Output slots are dealt to shards of ``shard_slots``. In each shard every slot draws its
source from the targets' shares, which makes the shard's counts multinomial. Over all shards a source then has somewhat
more or fewer draws than it needs; draws beyond a source's need are handed, in order, to the sources that lack some, so
the totals are exact while each shard keeps its random mix. The j-th draw of a source is pass ``j div blocks`` and maps to
a block by that pass's own pseudorandom permutation (swap-or-not: at each round an index either keeps its place or swaps
with its mirror image, as a hash of the two says), so no block comes a third time before all came twice. The last draw
of a source takes only the words that its target still lacks. Blocks join their draws by (source, block).

Positions in a stream are running sums in two steps, inside (source, chunk of documents) and over chunks, so a source
with a third of all rows is spread over ``CHUNKS`` keys.

Defined cases: null text has no words; a document without words takes none; without any words every target and every
taken is zero; null sources form one source; rows that repeat are documents of their own; texts of any length count
whole; an empty table gives no rows; other columns may have any name, for only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidefolio.llm.common import WORD
from tidefolio.session import hand_off

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
CHUNKS = 4096
ROUNDS = 12
GRAINS = 1024


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); sources are few, one row each."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    weighed = per.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    rising = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto, rest = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    # The level if this source and all after it were below their caps.
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    stepped = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    found = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(found, F.lit(float("inf"))) * F.col("w"))
    return stepped.select("source", "source_size", target.alias("target"))


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = 1024) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before this one in ``keys`` by the long ``order`` (unique there).

    Sums run inside chunks of ``order`` and over the chunks' totals, so a key's rows are spread over many tasks.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inside = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    bases = totals.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    local = cut.withColumn("_at", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(bases, [*keys, "_chunk"]).withColumn(out, F.col("_base") + F.col("_at")).drop("_chunk", "_base", "_at")


def permuted(df: DataFrame, index: str, n: str, key: Column, out: str, inverse: bool = False) -> DataFrame:
    """Adds ``out``, the place of ``index`` under a permutation of [0, n) chosen by ``key``, or the index of a place.

    Store the result before filtering or joining on ``out``: a predicate pushed below would repeat every round's
    expression in the next.
    """
    df = df.withColumn(out, F.col(index)).withColumn("_key", key)
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        pivot = F.pmod(F.xxhash64("_key", F.lit(2 * r)), F.col(n))
        df = df.withColumn("_mirror", F.pmod(pivot + F.col(n) - F.col(out), F.col(n)))
        coin = F.xxhash64("_key", F.lit(2 * r + 1), F.greatest(out, "_mirror")).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(out, F.when(coin, F.col("_mirror")).otherwise(F.col(out)))
    return df.drop("_key", "_mirror")


def needs(goals: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Per source with a target: its number ``k``, blocks, the slots that cover its target, the range of tickets
    [first, first + slots) and, for each pass, the place at which the short last block comes.

    One slot more than the words ask for allows for that block.
    """
    size, target = F.col("source_size"), F.col("target")
    blocks = F.ceil(size / block_words).cast("long")
    full = F.floor(target / size)
    rest = target - full * size
    slots = F.least(full * blocks + F.when(rest > 0, F.ceil(rest / block_words) + 1).otherwise(0), MOST * blocks)
    order = W.orderBy(F.col("source").asc_nulls_last())
    some = (
        goals.filter("target > 0")
        .withColumn("blocks", blocks)
        .withColumn("slots", slots.cast("long"))
        .withColumn("k", F.row_number().over(order).cast("long"))
        .withColumn("first", F.coalesce(F.sum("slots").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_slots", F.sum("slots").over(W.partitionBy()))
        .withColumn("last", F.col("blocks") - 1)
    )
    for p in range(MOST):
        some = permuted(some, "last", "blocks", F.xxhash64(F.lit(seed), "k", F.lit(p).cast("long")), f"short{p}", inverse=True)
    return some.drop("last")


def _grain(at: Column, total: Column) -> Column:
    return F.floor(at / F.greatest(F.ceil(total / GRAINS), F.lit(1)))


def find_range(points: DataFrame, at: str, ranges: DataFrame, lo: str, n: str, total: str) -> DataFrame:
    """Joins each point to the range [lo, lo + n) it lies in, by equal grains of the line rather than by comparison."""
    grained = ranges.withColumn(
        "_grain", F.explode(F.sequence(_grain(F.col(lo), F.col(total)), _grain(F.col(lo) + F.col(n) - 1, F.col(total))))
    )
    return (
        points.withColumn("_grain", _grain(F.col(at), F.col(total)))
        .join(grained.drop(total), "_grain")
        .filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(lo) + F.col(n)))
        .drop("_grain")
    )


def draws(needed: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """(k, j, shard): the j-th draw of source number k and the output shard it is for."""
    spark = needed.sparkSession
    ranges = needed.select("k", "first", "slots", "all_slots")
    shards = ranges.groupBy("all_slots").agg(F.lit(0).cast("long").alias("zero")).select(
        "all_slots", F.explode(F.sequence(F.col("zero"), F.floor((F.col("all_slots") - 1) / shard_slots))).alias("shard")
    )
    spread = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    tickets = (
        spread.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shard_slots - 1).cast("long"))))
        .filter(F.col("shard") * shard_slots + F.col("i") < F.col("all_slots"))
        .withColumn("ticket", F.pmod(F.xxhash64(F.lit(seed), "shard", "i"), F.col("all_slots")))
    )
    counts = find_range(tickets, "ticket", ranges, "first", "slots", "all_slots").groupBy("k", "shard").agg(F.count("*").alias("n"))
    based = hand_off(running(counts, ["k"], "shard", "n", "base"), "mix-draws")
    totals = based.groupBy("k").agg(F.sum("n").alias("drawn"))
    # Draws beyond a need and the draws still lacking are as many; both are laid on one line and matched by place.
    balance = ranges.join(totals, "k", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    order = W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    balance = (
        balance.withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)))
        .withColumn("lack", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
        .withColumn("over_from", F.coalesce(F.sum("over").over(order), F.lit(0)))
        .withColumn("lack_from", F.coalesce(F.sum("lack").over(order), F.lit(0)))
        .withColumn("moved", F.sum("over").over(W.partitionBy()))
    )
    balance = hand_off(balance, "mix-balance")
    each = based.join(balance.select("k", "slots", "over_from", "moved"), "k").select(
        "*", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("j")
    )
    kept = each.filter("j < slots").select("k", "j", "shard")
    beyond = each.filter("j >= slots").select("shard", "moved", (F.col("over_from") + F.col("j") - F.col("slots")).alias("at"))
    lacking = balance.filter("lack > 0").select("k", "drawn", "lack", "lack_from", "moved")
    filled = find_range(beyond, "at", lacking, "lack_from", "lack", "moved")
    return kept.union(filled.select("k", (F.col("drawn") + F.col("at") - F.col("lack_from")).alias("j"), "shard"))


def block_takes(needed: DataFrame, drawn: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(k, block, pass, shard, words): the first ``words`` words of a block go to the shard."""
    passes = drawn.join(needed.drop("all_slots", "first", "slots"), "k").withColumns(
        {"pass": F.floor(F.col("j") / F.col("blocks")), "place": F.col("j") % F.col("blocks")}
    )
    mapped = permuted(passes, "place", "blocks", F.xxhash64(F.lit(seed), "k", "pass"), "block")
    size, place = F.col("source_size"), F.col("place")
    short_at = F.when(F.col("pass") == 0, F.col("short0")).otherwise(F.col("short1"))
    missing = F.col("blocks") * block_words - size
    before = F.col("pass") * size + place * block_words - F.when(short_at < place, missing).otherwise(0)
    length = F.least(F.lit(block_words), size - F.col("block") * block_words)
    words = F.least(length, F.round("target").cast("long") - before)
    stored = hand_off(mapped.select("k", "block", "pass", "shard", words.alias("words")), "mix-takes")
    return stored.filter("words > 0")


def sized(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, tie, chunk): what the mix reads of each document; ``tie`` tells texts of one id apart."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(body).alias("size"),
        F.xxhash64(body).alias("tie"),
    )
    return narrow.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(CHUNKS)))


def plan_mix(
    docs: DataFrame,
    *,
    weights=WEIGHTS,
    share: float = SHARE,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
    shard_slots: int = SHARD_SLOTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For the rows of ``sized``: placed documents (with k, target and start), block takes and the sources' goals."""
    goals = hand_off(targets(docs, weights=weights, share=share), "mix-goals")
    needed = hand_off(needs(goals, block_words, seed), "mix-needs")
    takes = block_takes(needed, draws(needed, seed, shard_slots), block_words, seed)
    numbered = goals.join(needed.select(F.col("source").alias("_s"), "k"), F.col("source").eqNullSafe(F.col("_s")), "left")
    numbered = hand_off(numbered.select(F.col("source").alias("_s"), "source_size", "target", "k"), "mix-sources")
    known = docs.join(numbered, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = W.partitionBy("k", "chunk").orderBy("doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    sums = docs.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    sums = sums.join(numbered.select("_s", "k"), F.col("source").eqNullSafe(F.col("_s"))).select("k", "chunk", "words")
    bases = running(sums.filter("k is not null"), ["k"], "chunk", "words", "base", chunk=64).drop("words")
    local = known.filter("k is not null").withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(bases, ["k", "chunk"]).withColumn("start", F.col("base") + F.col("at")).drop("base", "at")
    without = known.filter("k is null").withColumn("start", F.lit(0).cast("long"))
    return placed.unionByName(without), takes, goals


def pieces(placed: DataFrame, takes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents cut at block borders and joined to the takes of each block; lo and n are words from the document's first."""
    end = F.col("start") + F.col("size")
    cut = placed.filter("size > 0 and k is not null").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    )
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(end, F.col("block") * block_words + F.coalesce("words", F.lit(0)))
    joined = cut.join(takes, ["k", "block"], "left")
    return joined.withColumns({"lo": lo - F.col("start"), "n": F.greatest(hi - lo, F.lit(0))})


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target and taken, the words that the mix takes."""
    docs = hand_off(sized(df, id_col=id_col, text=text, source=source), "mix-sized")
    placed, takes, _ = plan_mix(docs, weights=weights, share=share, block_words=block_words, seed=seed)
    out = ["doc_id", "source", "size", "source_size", "target"]
    placed = hand_off(placed, "mix-placed")
    some = pieces(placed, takes, block_words).groupBy(*out, "k", "start").agg(F.sum("n").alias("taken")).select(*out, "taken")
    none = placed.filter("size = 0 or k is null").select(*out, F.lit(0).cast("long").alias("taken"))
    return some.union(none)


def mixed_documents(df: DataFrame, *, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix itself for a table with the columns of ``documents``: one row per document and pass with the words taken.

    The text keeps the white space before each word; a document that a pass leaves out has no row for it, and one
    without words none at all.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    twins = W.partitionBy("tie", "doc_id", "source").orderBy("_row.lang", "_row.n_chars")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(body).alias("tie"),
        word_count(body).alias("size"),
    )
    rows = hand_off(rows.withColumn("copy", F.row_number().over(twins)), "mix-rows")
    narrow = rows.select("doc_id", "source", "tie", "copy", "size")
    docs = hand_off(narrow.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(CHUNKS))), "mix-sized")
    placed, takes, _ = plan_mix(docs, block_words=block_words, seed=seed)
    taken = pieces(placed, takes, block_words).filter("n > 0")
    keys = ["doc_id", "source", "tie", "copy"]
    per = taken.groupBy(*keys, "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("parts"))
    per = per.select(F.struct(*keys).alias("key"), "parts")
    joined = rows.select("_row", F.struct(*keys).alias("key")).join(per, "key")
    words = F.regexp_extract_all("_row.text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), 1)
    chosen = F.transform("parts", lambda p: F.slice(F.col("words"), p["lo"].cast("int") + 1, p["n"].cast("int")))
    # Two uses of ``words`` keep the optimizer from putting its expression into the lambda, once for every part.
    mixed = F.when(F.size("words") > 0, F.array_join(F.flatten(chosen), ""))
    texts = joined.withColumn("words", words).withColumn("mixed", mixed)
    own = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return texts.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in df.columns])
