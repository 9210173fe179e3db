"""Tables written between the phases of a job, in the shared folder of the cluster.

A phase that is read more than once, or whose shuffles should be freed before the next
one starts, is written as Parquet under ``spark.checkpoint.dir``. That also cuts lineage:
a lost executor costs at most the phase that was running.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a staged table for which a phase made from it takes a round, and the most rounds.
ROUND, ROUNDS = 16 << 20, 4
_OWN = uuid.uuid4().hex
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="twinlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This process's folder of staged tables; it goes when the process ends."""
    path = f"{shared_dir(spark)}/twinlake/{_OWN}"
    if path not in _swept:
        _swept.add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())

        def sweep() -> None:
            try:
                files.delete(p, True)
            except Exception:  # the Java side may have ended first; then the folder stays
                pass

        atexit.register(sweep)
    return path


def _write(df: DataFrame, path: str) -> None:
    # The plan runs once, so its shuffle files can go as soon as the table is there.
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Columns keep their types; no order is kept."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._twinlake_path = path
    return back


def stage_rounds(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """One staged table of all frames, written one after another: shuffles of a round are gone before the next one starts."""
    path = None
    for i, df in enumerate(frames):
        path = path or f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        _write(df, f"{path}/{i}")
    back = df.sparkSession.read.schema(df.schema).parquet(*[f"{path}/{k}" for k in range(i + 1)])
    back._twinlake_path = path
    return back


def rounds_of(df: DataFrame) -> int:
    """How many rounds a phase takes that shuffles several times a staged table; one that isn't staged is taken whole."""
    path = getattr(df, "_twinlake_path", None)
    if not path:
        return 1
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(1, min(ROUNDS, -(-size // ROUND)))


def in_round(i: int, n: int, *columns: str) -> Column:
    """Whether a row's ``columns`` fall in round i of n; all rows do if there is one round."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)) == i if n > 1 else F.lit(True)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and let Spark drop the shuffles of finished phases."""
    for df in frames:
        path = getattr(df, "_twinlake_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    if frames:
        release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files of unreachable plans go only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
