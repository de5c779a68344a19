"""Slots, shards and round trips of the materialised order."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidefolio.llm import queries as Q, training_order as O
from tidefolio.llm.sentencepiece_codec import load


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    f = O.Feistel(n, key=9)
    slots = f.slots(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.numbers(slots) == np.arange(n)).all()
    if n >= 64:
        assert (slots == np.arange(n)).mean() < 0.1 and (O.Feistel(n, key=10).slots(np.arange(n)) != slots).any()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.4


def rows():
    return [(i, bytes([i % 251]) * (i * 7 % 90)) for i in range(120)] + [(None, b"abcd"), (3, None), (4, b""), (500, b"zz" * 4000)] + [(7, b"same!")] * 5


@pytest.mark.parametrize("width, length", [(1, 16), (2, 8)])
def test_every_sequence_has_one_slot(spark, tmp_path, width, length):
    data = rows() if width == 1 else [(i, b and b[: len(b) // 2 * 2]) for i, b in rows()]
    df = spark.createDataFrame(data, "doc_id long, ids binary").withColumn("slot", F.lit("clash"))
    out = O.materialise(df, width=width, length=length, shard_slots=50, pad=7)
    path = str(tmp_path / "shards")
    O.write_shards(out, path)
    got = spark.read.parquet(path).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all((r.shard, r.offset) == divmod(r.slot, 50) and len(r.tokens) == width * length for r in got)
    parts = {}
    for r in got:
        body = bytes(r.tokens)
        assert body[r.n_tokens * width :] == (7).to_bytes(width, "little") * (length - r.n_tokens)
        parts.setdefault(r.doc_id, {}).setdefault(r.seq_no, []).append(body[: r.n_tokens * width])
    for i, b in data:
        if b and i != 7:
            assert b"".join(parts[i][s][0] for s in sorted(parts[i])) == b
    assert sorted(parts[7][0]) == sorted([b"same!"[: 5 // width * width]] * 5 + [b for i, b in data[:120] if i == 7 for b in [b[: width * length]]])
    # The same rows give the same order; reading on from a slot gives the rest of it.
    again = {(r.slot, bytes(r.tokens)) for r in O.materialise(df, width=width, length=length, shard_slots=50, pad=7).collect()}
    assert again == {(r.slot, bytes(r.tokens)) for r in got}
    assert sorted(r.slot for r in O.read_from(spark, path, 60, shard_slots=50).collect()) == list(range(60, len(got)))
    for together in (1, 3):
        turns = [[r.slot for r in x.collect()] for x in O.in_order(spark, path, 60, shard_slots=50, together=together)]
        assert [s for t in turns for s in t] == list(range(60, len(got))) and all(len(t) <= 50 * together for t in turns)


def test_files_hold_ranges_in_order(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(b"x" * 40).alias("ids"))
    path = str(tmp_path / "shards")
    O.write_shards(O.materialise(df, width=1, length=16, shard_slots=100), path)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n"))
    spans = sorted((r.a, r.b, r.n) for r in files.collect())
    assert all(b - a + 1 == n and a % 100 == 0 for a, b, n in spans) and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


def test_nothing_to_order(spark):
    for data in ([], [(1, None), (2, b"")]):
        assert O.materialise(spark.createDataFrame(data, "doc_id long, ids binary")).count() == 0


def test_a_file_per_shard_in_slot_order(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(b"x" * 40).alias("ids"))
    O.write_shards(O.materialise(df, width=1, length=16, shard_slots=100), str(tmp_path / "shards"))
    files = sorted((tmp_path / "shards").glob("shard=*/*.parquet"), key=lambda f: int(f.parent.name[6:]))
    got = [pq.ParquetFile(f).read(["slot"])["slot"].to_pylist() for f in files]
    assert got == [list(range(k * 100, k * 100 + 100)) for k in range(90)]
    O.write_shards(O.materialise(df.limit(0)), str(tmp_path / "none"))
    assert O.read_from(spark, str(tmp_path / "none")).count() == 0


def test_the_query_orders_piece_ids_and_reads_its_shards(spark, documents, tmp_path):
    texts = ["one river and a stone " * 900, "short", "", None, "é\U0001f600 \n x"]
    documents(texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.op4_training_order(spark, str(tmp_path))
    assert all("/shards/shard=" in f for f in out.inputFiles())
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {len(r.tokens) for r in rows} == {2 * O.LENGTH}
    codec = load(Q.tokenizer("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.seq_no)
        ids = b"".join(bytes(r.tokens)[: 2 * r.n_tokens] for r in parts)
        assert np.frombuffer(ids, "<u2").tolist() == (np.frombuffer(codec.encode([t])[0], "<i4").tolist() if t else [])


def test_each_slot_is_the_permuted_number(spark):
    df = spark.createDataFrame(rows(), "doc_id long, ids binary").repartition(5)
    cut = O.cut_sequences(df, width=1, length=16).cache()
    numbered = sorted((r.task, r.at, r.doc_id, r.seq_no, bytes(r.piece)) for r in cut.collect())
    assert len({t for t, *_ in numbered}) > 1 and all(sum(n[0] == t for n in numbered) == max(n[1] for n in numbered if n[0] == t) + 1 for t, *_ in numbered)
    slots = O.Feistel(len(numbered), 5).slots(np.arange(len(numbered)))
    want = {int(s): (n[2], n[3], n[4]) for s, n in zip(slots, numbered)}
    got = O.arrange(cut, width=1, length=16, key=5, shard_slots=50).collect()
    assert {r.slot: (r.doc_id, r.seq_no, bytes(r.tokens)[: r.n_tokens]) for r in got} == want
    held = {}
    for _, _, doc, seq, piece in numbered:
        held[doc, piece, seq] = held.get((doc, piece, seq), 0) + 1
    for i, b in rows():
        for k in range(-(-len(b or b"") // 16)):
            held[i, b[16 * k : 16 * k + 16], k] -= 1
    assert not any(held.values())


def test_ids_pass_one_shuffle_and_reads_none(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, ids binary")
    path = O.order(df, str(tmp_path), width=1, length=16, shard_slots=50)
    plan = O.arrange(spark.read.schema(O.CUT).parquet(f"{tmp_path}/cut"), width=1, length=16, shard_slots=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1
    read = O.read_from(spark, path, 60, shard_slots=50)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in read and "PartitionFilters: [isnotnull(shard" in read


def test_a_failed_write_goes_on(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, ids binary")
    common = dict(width=1, length=16, shard_slots=50)
    broken = df.withColumn("ids", F.when(F.col("doc_id") == 500, F.raise_error(F.lit("lost"))).otherwise(F.col("ids")).cast("binary"))
    with pytest.raises(Exception, match="lost"):
        O.order(broken, str(tmp_path), **common)
    path = O.order(df, str(tmp_path), **common)
    first = sorted((r.slot, bytes(r.tokens)) for r in O.read_from(spark, path, shard_slots=50).collect())
    # Everything is there: the rows are not read again.
    assert O.order(broken, str(tmp_path), **common) == path
    assert sorted((r.slot, bytes(r.tokens)) for r in O.read_from(spark, path, shard_slots=50).collect()) == first
    with pytest.raises(ValueError, match="was made with"):
        O.order(df, str(tmp_path), **{**common, "key": 1})
