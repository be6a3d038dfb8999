"""Session defaults and the few session-level services that operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hewn")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that ``spark.checkpoint.dir`` names; in local mode, where driver and tasks share a disk, a temporary one will do.

    On a cluster a machine-local folder would differ on every executor, so a
    session without the setting is an error there.
    """
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isEmpty():
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="hewn-checkpoint-"))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting for the length of a block; the caller's own is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where it comes in fewer: for costly expressions over small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted with its partitioning, which joins on the same key then need not make again."""
    with setting(df.sparkSession, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "false"):
        return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut(df: DataFrame, looped: bool = False) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it without its lineage.

    In a loop the written frame must not hand its plan's inferred constraints
    on, or they grow with every turn (``looped``).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not looped:
        return df.checkpoint(eager=True)
    with setting(spark, "spark.sql.constraintPropagation.enabled", "false"):
        return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame from :func:`cut` that nothing reads any more, and lets Spark clear the shuffles that only it needed: loops would pile them up."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, max_bytes: int = 16 << 20, max_rows: int = 4096) -> None:
    """Keeps Arrow batches small by bytes as well as by rows, so that very long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))
