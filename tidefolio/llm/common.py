"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space as in the byte class [\x20\x09-\x0D]; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a string column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(texts: list[str], size: int = 1 << 21) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together, so that what is made of them stays small; a longer text is
    a slice of its own."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in batches if b.num_rows)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
