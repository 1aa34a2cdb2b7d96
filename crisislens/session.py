"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on.  Time buckets are built tz-free, but the
# session zone still matters for any LTZ timestamp a caller brings, so UTC.
ENGINE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "crisislens", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict[str, str] | None = None,
              local_checkpoint_dir: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine settings.

    On a cluster, leave ``master`` unset so spark-submit decides, and let the
    cluster provide ``spark.checkpoint.dir`` on shared storage.  Tests and
    single-machine runs pass ``local_checkpoint_dir``; it is used only when
    the setting is not already given.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    submitted = SparkConf().get("spark.checkpoint.dir", None)     # e.g. from spark-submit --conf
    if local_checkpoint_dir and not submitted and "spark.checkpoint.dir" not in (extra or {}):
        b = b.config("spark.checkpoint.dir", local_checkpoint_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, allow_local: bool = False) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name it (shared storage that survives executor loss).  Only
    when ``allow_local`` is set (tests, single-machine runs) and the setting is
    unset do we create a fresh folder under the system temp dir and register it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not allow_local:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
        root = tempfile.mkdtemp(prefix="crisislens-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back when it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


MAX_WRITE_BOUNDS = 4096          # range bounds that reach the driver at most
WRITE_BOUND_ERROR = 1e-3         # their relative rank error


def cluster_for_write(df: DataFrame, date_col: str, tiebreak: str, per_partition: int = 4) -> DataFrame:
    """Group rows by date ranges before a date-partitioned write.

    Range bounds come from approximate quantiles of a cheap key (date, then a
    hash of ``tiebreak``): the pass reads two narrow columns, so unlike
    ``repartitionByRange`` it does not re-run the expensive producer of
    ``df`` just to sample it.  Each bucket spans at most a couple of dates,
    a hot date is cut into many buckets, and ``per_partition`` buckets per
    shuffle partition keep task sizes even despite hash placement.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import functions as F

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(max(2, n * per_partition), MAX_WRITE_BOUNDS)
    key = (F.unix_date(F.col(date_col)).cast("long") * F.lit(1 << 32)
           + F.pmod(F.hash(F.col(tiebreak)), F.lit(1 << 32))).cast("double")
    keyed = df.withColumn("_ck", key)
    bounds = sorted(set(keyed.select("_ck").approxQuantile("_ck", [i / n_buckets for i in range(1, n_buckets)],
                                                          WRITE_BOUND_ERROR)))
    splits = [float("-inf"), *bounds, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_ck", outputCol="_cb").transform(keyed)
    return bucketed.repartition(n, "_cb").drop("_ck", "_cb")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None,
                allow_local: bool = False, cluster_tiebreak: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing
    the enrichment) and lets many downstream jobs share one scan.  With
    ``partition_by``, rows are first range-partitioned on the partition
    columns plus ``cluster_tiebreak`` (e.g. a post id): each task then
    writes one or two partition directories instead of every task writing
    to every directory (tasks x dates small files), and a hot date is still
    split over several tasks by the tie-break column.
    """
    spark = df.sparkSession
    root = checkpoint_root(spark, allow_local=allow_local)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    if partition_by and cluster_tiebreak:
        df = cluster_for_write(df, partition_by[0], cluster_tiebreak)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_released(spark):
        w.parquet(path)
    return spark.read.parquet(path)
