"""Training-order materialisation: a keyed Feistel permutation gives every sequence a slot, range partitions write shards.

The token ids of a document (packed, ``width`` bytes each) are cut into sequences of ``length`` ids and stored once, with
their number inside the task that cut them. Sizes alone tell where each task's numbers begin, so numbering moves no ids.
A balanced Feistel network over the next even number of bits maps a number to a slot; results beyond N are mapped again
until they are inside (cycle walking), so numbers and slots are one to one for every N, and the inverse tells which sequence
a slot holds without any table. One shuffle deals slots to partitions by equal ranges that are known beforehand, so nothing
is sampled; each shard is ``shard_slots`` rows of one fixed stride, short sequences being padded.

Each shard is one file under its own folder. A read from a slot on skips the folders of all shards before it and the row
groups before the slot; it needs no shuffle: each task's rows are sorted, and ``in_order`` goes through the shards in turn.
``order`` keeps its steps in one folder: called again after a failure it goes on after the last step that was finished,
and refuses a folder made with other settings.

Numbers follow the rows as the first step reads them: the same key, settings and stored sequences give the same order.

Defined cases: null and empty ids make no sequence; texts of any length are cut whole; rows that repeat, also under one
id, are numbered apart; a null doc_id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidefolio.llm.common import slices, some_rows
from tidefolio.session import hand_off

LENGTH = 1024
SHARD_SLOTS = 8192
#: Shards a partition holds at most: about one gigabyte of two-byte ids.
SHARDS_TOGETHER = 64
#: Tasks whose first numbers (16 bytes each) are broadcast; beyond that they are joined by their task's number.
MOST_TASKS = 1 << 21
ROUNDS = 8
KEY = 20240229
PAD = 0
#: Columns of cut sequences, and of written shards, also where no rows were written; the shard is in the folder's name.
CUT = "task int, at long, doc_id long, seq_no int, n_tokens int, piece binary"
WRITTEN = "slot long, offset int, doc_id long, seq_no int, n_tokens int, tokens binary, shard long"


class Feistel:
    """A keyed permutation of [0, n) and its inverse, on arrays."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        rng = np.random.Generator(np.random.Philox(key=key))
        self.keys = [np.uint64(x) for x in rng.integers(0, 2**63, ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        """The round function: a 64-bit finalizer (fixed odd factors) of the half and the round's key."""
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        if back:
            for key in reversed(self.keys):
                left, right = right ^ self._mix(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._mix(right, key)
        return (left << shift) | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(values, np.uint64)
        limit = np.uint64(self.n)
        out = self._once(out, back)
        while (outside := out >= limit).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def cut_sequences(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    ids: str = "ids",
    width: int = 2,
    length: int = LENGTH,
    encode: Callable[[], Callable[[list[str]], list[bytes]]] | None = None,
) -> DataFrame:
    """task, at, doc_id, seq_no, n_tokens and piece: the sequences, numbered from 0 inside each task.

    ``ids`` is a binary column of little-endian integers of ``width`` bytes, or, with ``encode``, a column of texts;
    ``encode`` is called once in a task and gives the function from texts to such ids.
    """
    stride = width * length
    kind = "binary" if encode is None else "string"
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").cast(kind).alias("body"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        to_ids = encode() if encode else lambda part: part
        for b in some_rows(batches):
            rows, names = b.column(1).drop_null().to_pylist(), b.column(0).filter(b.column(1).is_valid()).to_pylist()
            done = 0
            # What comes out is bounded by the texts that go in at a time.
            for part in slices(rows):
                out: list[tuple] = []
                for name, body in zip(names[done : done + len(part)], to_ids(part), strict=True):
                    out += [(name, k, body[i : i + stride]) for k, i in enumerate(range(0, len(body), stride))]
                done += len(part)
                if out:
                    doc, seq, piece = zip(*out)
                    columns = [
                        pa.array([task] * len(out), pa.int32()), pa.array(range(at, at + len(out)), pa.int64()),
                        pa.array(doc, pa.int64()), pa.array(seq, pa.int32()),
                        pa.array([len(x) // width for x in piece], pa.int32()), pa.array(piece, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["task", "at", "doc_id", "seq_no", "n_tokens", "piece"])
                    at += len(out)

    return narrow.mapInArrow(per_task, CUT)


def arrange(
    cut: DataFrame, *, width: int = 2, length: int = LENGTH, key: int = KEY, shard_slots: int = SHARD_SLOTS, pad: int = PAD
) -> DataFrame:
    """The stored rows of ``cut_sequences`` with slot, shard, offset and padded tokens, partitions being slot ranges."""
    sums = cut.groupBy("task").agg(F.count("*").alias("sequences"))
    over = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = hand_off(sums.withColumn("base", F.coalesce(F.sum("sequences").over(over), F.lit(0))), "order-bases")
    total, tasks = bases.agg(F.coalesce(F.sum("sequences"), F.lit(0)), F.count("*")).first()
    feistel = Feistel(total, key)

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel.slots(numbers.to_numpy()))

    firsts = bases.drop("sequences")
    numbered = cut.join(F.broadcast(firsts) if tasks <= MOST_TASKS else firsts, "task")
    slotted = numbered.select(slot_of(F.col("base") + F.col("at")).alias("slot"), "doc_id", "seq_no", "n_tokens", "piece")
    # Whole shards per partition, as even as they go.
    shards = -(-total // shard_slots)
    per = min(SHARDS_TOGETHER, max(1, -(-shards // int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))))) * shard_slots
    dealt = slotted.repartitionById(max(1, -(-total // per)), F.floor(F.col("slot") / per).cast("int"))
    placed = dealt.withColumn("shard", F.floor(F.col("slot") / shard_slots)).sortWithinPartitions("shard", "slot")
    return placed.select(
        "slot",
        "shard",
        (F.col("slot") % shard_slots).cast("int").alias("offset"),
        "doc_id",
        "seq_no",
        "n_tokens",
        F.rpad("piece", width * length, F.lit(bytes(pad.to_bytes(width, "little")))).alias("tokens"),
    )


def materialise(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    ids: str = "ids",
    width: int = 2,
    length: int = LENGTH,
    key: int = KEY,
    shard_slots: int = SHARD_SLOTS,
    pad: int = PAD,
    encode: Callable | None = None,
) -> DataFrame:
    """slot, shard, offset, doc_id, seq_no, n_tokens and tokens (``length * width`` bytes), in slot order over and inside
    the partitions. ``ids`` and ``encode`` as in ``cut_sequences``."""
    cut = hand_off(cut_sequences(df, id_col=id_col, ids=ids, width=width, length=length, encode=encode), "order-cut")
    return arrange(cut, width=width, length=length, key=key, shard_slots=shard_slots, pad=pad)


def write_shards(sequences: DataFrame, path: str) -> None:
    """Writes the rows of ``materialise``: one file per shard, under ``shard=<number>``, in slot order."""
    sequences.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was finished there; what a failed job left is none."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def order(
    df: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    ids: str = "ids",
    width: int = 2,
    length: int = LENGTH,
    key: int = KEY,
    shard_slots: int = SHARD_SLOTS,
    pad: int = PAD,
    encode: Callable | None = None,
) -> str:
    """Cuts, orders and writes under ``path`` (``cut``, ``shards`` and ``manifest``) and returns the shards' folder.

    Steps that an earlier call finished there are not done again; other settings than that call's are an error.
    """
    spark = df.sparkSession
    settings = dict(width=width, length=length, key=key, shard_slots=shard_slots, pad=pad)
    manifest, cut, shards = f"{path}/manifest", f"{path}/cut", f"{path}/shards"
    if _written(spark, manifest):
        held = spark.read.json(manifest).first().asDict()
        if held != settings:
            raise ValueError(f"{path} was made with {held}")
    else:
        spark.createDataFrame([settings]).coalesce(1).write.mode("overwrite").json(manifest)
    if not _written(spark, cut):
        rows = cut_sequences(df, id_col=id_col, ids=ids, width=width, length=length, encode=encode)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(cut)
    if not _written(spark, shards):
        arranged = arrange(spark.read.schema(CUT).parquet(cut), **settings)
        arranged.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(shards)
    return shards


def read_from(spark: SparkSession, path: str, slot: int = 0, *, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The written sequences from ``slot`` on. Folders of shards before it are not listed for reading, nothing is shuffled;
    each partition is in slot order, partitions are in any."""
    rows = spark.read.schema(WRITTEN).parquet(path).filter((F.col("shard") >= slot // shard_slots) & (F.col("slot") >= slot))
    return rows.select("slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "tokens").sortWithinPartitions("slot")


def in_order(
    spark: SparkSession, path: str, slot: int = 0, *, shard_slots: int = SHARD_SLOTS, together: int = 1
) -> Iterator[DataFrame]:
    """The written sequences from ``slot`` on as one table after the other, each of ``together`` whole shards in slot order."""
    known = spark.read.schema(WRITTEN).parquet(path)
    last = known.agg(F.max("shard")).first()[0]
    for first in range(slot // shard_slots, -1 if last is None else last + 1, together):
        rows = known.filter((F.col("shard") >= first) & (F.col("shard") < first + together) & (F.col("slot") >= slot))
        yield rows.select("slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "tokens").coalesce(1).sortWithinPartitions("slot")
