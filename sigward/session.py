"""Session settings, scratch folders and size bounds shared by all modules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast on request only below this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 128 * 1024 * 1024
# Rule strings tested as literals in one pass over the files.
LITERAL_STRINGS = 64


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on. All are runtime settings of the given session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rows go to Python in batches of so many bytes: a task holds a batch several times.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster (spark.checkpoint.dir).

    Only on one machine, as in local tests, a folder under /tmp may stand in for that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table in the scratch folder, and its folder, for tables that go before the job ends."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the scratch folder: work done once, read often, and safe from lost executors."""
    return written_at(df, name)[0]


def text_bytes(*cols: str):
    """Aggregate: bytes the named text columns take, with some room per value."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) + 16 for c in cols), F.lit(0))
    return F.coalesce(F.sum(size.cast("bigint")), F.lit(0))


def fits_broadcast(df: DataFrame, *cols: str) -> bool:
    """True when the named text columns of `df`, meant to be a small side, stay below BROADCAST_BYTES."""
    return df.agg(text_bytes(*cols).alias("b")).first()["b"] <= BROADCAST_BYTES


def shuffles(spark: SparkSession) -> int:
    """Partitions that a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SPREAD_BELOW = 32


def spread_small(df: DataFrame) -> DataFrame:
    """Redistribute a table that arrives in fewer tasks than there are cores.

    A table of one small file is read by one task, however many cores wait. Only tables of less than SPREAD_BELOW
    splits are touched; large ones arrive in many splits and are never shuffled for this.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SPREAD_BELOW) else df


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Remove folders of a table, in whatever store they are. One that is gone already is no error, so this may be repeated."""
    for folder in folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
