"""Artifacts keyed by their configuration, metadata with fingerprints, and exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.panel import long_to_wide
from ..schema import one_of

# The version mixed into every key, the codec, and the digits kept of a key.
SCHEMA_VERSION = "v1"
CODEC = "zstd"
KEY_DIGITS = 16


def _plain(value):
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [_plain(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def config_key(cfg: Mapping) -> str:
    """Same settings, same key, whatever the order they are given in."""
    text = json.dumps({"schema": SCHEMA_VERSION, **_plain(cfg)}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:KEY_DIGITS]


def artifact_path(root: str, kind: str, cfg: Mapping) -> str:
    return f"{root.rstrip('/')}/{kind}_{config_key(cfg)}"


def write_artifact(df: DataFrame, root: str, kind: str, cfg: Mapping, partition_by: list[str] | None = None) -> str:
    path = artifact_path(root, kind, cfg)
    writer = df.write.mode("overwrite").option("compression", CODEC)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_artifact(spark: SparkSession, root: str, kind: str, cfg: Mapping) -> DataFrame | None:
    """The stored table, or None where nothing was written for this configuration."""
    try:
        return spark.read.parquet(artifact_path(root, kind, cfg))
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_matrix(sigma: DataFrame, root: str, kind: str, cfg: Mapping) -> str:
    """A matrix is stored as its long (i, j, value) table."""
    return write_artifact(sigma, root, kind, cfg)


read_matrix = read_artifact


def with_fingerprint(meta: DataFrame, digits: int = KEY_DIGITS, exclude: tuple[str, ...] = ("generated_at",)) -> DataFrame:
    """Add ``fingerprint``: digest of the row's JSON without the columns that change from run to run."""
    hashed = [c for c in sorted(meta.columns) if c not in exclude]
    digest = F.substring(F.sha2(F.to_json(F.struct(*hashed)), 256), 1, digits)
    return meta.withColumn("fingerprint", digest)


def write_metadata(meta: DataFrame, root: str, kind: str, cfg: Mapping, digits: int = KEY_DIGITS) -> str:
    path = artifact_path(root, kind, cfg)
    with_fingerprint(meta, digits).write.mode("overwrite").json(path)
    return path


def read_metadata(spark: SparkSession, root: str, kind: str, cfg: Mapping) -> DataFrame | None:
    try:
        return spark.read.json(artifact_path(root, kind, cfg))
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def export(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    one_of(fmt, ("parquet", "csv", "json"), "format")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.option("compression", CODEC).parquet(path)
    else:
        writer.json(path)
    return path


def export_matrix_wide(sigma: DataFrame, path: str, names: list[str] | None = None) -> str:
    """Matrix as a wide CSV, one column per name."""
    return export(long_to_wide(sigma, "value", tickers=names, index="i", columns="j"), path, "csv")
