"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tramsu")
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; set one of our own only where that is unset and
    the master is local (tests); on a cluster its absence is an error, not a folder of one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="tramsu-checkpoint-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: work already done is not
    repeated, neither by a second use nor after the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """As cut, but as a Parquet table in the shared checkpoint folder: compressed (texts by zstd take half of what they take by
    snappy), and read by column. For rows with texts. The table is removed when Python ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """df, a scan with no more than columns and rows picked, over all cores: a small table is one
    file and would be one task, however much work its rows are. Tables of enough files stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
