"""Session defaults for stand-alone use; on a cluster the session comes from the caller."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Whether Spark drops the shuffle files of a statement at its end.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    cores: str = "*", app: str = "tidefolio", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEFOLIO_DRIVER_MEMORY", "12g"))
    )
    if checkpoint_dir is not None:
        builder = builder.config(CHECKPOINT_CONF, checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: dict[str, str] = {}

Store = Callable[[DataFrame, str], DataFrame]


def runs_here(master: str) -> bool:
    """Whether all tasks of a session with this master run in the driver's process."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a temporary one serves sessions whose tasks all run in this process; on a cluster, where
    executors would each write to a disk of their own, that is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not runs_here(spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="tidefolio-")
    return _fallback["dir"]


def hand_off(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used between steps whose result has several readers (a return panel, a covariance matrix): the steps before are
    computed once, lost executors cannot undo them, and file statistics let later joins pick the small side. The shuffle
    files of those steps have no reader after that and are dropped at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidefolio/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def lazily(df: DataFrame, label: str = "") -> DataFrame:
    """The other ``Store``: keep the plan, store nothing."""
    return df


def busy_partitions(df: DataFrame) -> int:
    """Partitions for steps that are small in bytes but heavy in compute: several per shuffle partition, so that
    uneven groups even out."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
