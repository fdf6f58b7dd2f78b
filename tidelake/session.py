"""Sessions and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows one task handles without a shuffle.
SMALL_ROWS = 100_000
CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "tidelake", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    Where the machine's settings name no shared folder, it gets a temporary one.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    if not spark.conf.get(CHECKPOINT_CONF, None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidelake-"))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it, or the session's checkpoint folder."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster before the session is built")
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one; it may be deleted once the application has ended."""
    return f"{shared_root(spark)}/tidelake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the application's folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's folder. Frames and tables that still read from it can no longer be used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, gives every later branch the same
    rows, and gives the optimizer the true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str = "stage", small: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """As ``materialize``, and whether the result has at most ``small`` rows.

    Such a result comes back as one partition, on which windows and aggregates
    need no shuffle. The rows are counted while they are written.
    """
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    few = seen.get["rows"] <= small
    return (out.coalesce(1) if few else out), few
