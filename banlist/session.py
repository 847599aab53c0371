"""Written tables in the shared folder of the cluster.

A plan that is read more than once, or whose row positions must not change
between two reads, is written as Parquet below ``spark.checkpoint.dir``. Such
a table survives the loss of executors, and unlike an RDD checkpoint it is
computed once and read with column pruning.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHARED: dict[tuple, DataFrame] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set. On a cluster it must name a folder "
                "that every executor can reach."
            )
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="run-banlist-")
            atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/banlist-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_table(
    spark: SparkSession, key: tuple, build: Callable[[], DataFrame]
) -> DataFrame:
    """Build a table on first use and hand out the same one within a session."""
    full_key = (spark.sparkContext.applicationId, *key)
    if full_key not in _SHARED:
        _SHARED[full_key] = build()
    return _SHARED[full_key]


# A scan of up to so many splits may be dealt out anew: 2 GB at Spark's defaults.
SPREAD_SPLITS = 16


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a small file scan with fewer splits than cores.

    A file of one row group cannot be split by the scan. Moving at most
    SPREAD_SPLITS splits is cheap; a larger scan is left as it is. Select the
    needed columns first.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    return scan.repartition(cores) if splits < min(cores, SPREAD_SPLITS + 1) else scan


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's written tables. DataFrames that read them
    cannot be used afterwards."""
    for key in [k for k in _SHARED if k[0] == spark.sparkContext.applicationId]:
        del _SHARED[key]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
