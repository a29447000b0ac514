"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, app: str = "pagelake", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects: UTC and AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package when it isn't installed on their path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Unset, a local master gets a folder of its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_pagelake_shared", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = sc._pagelake_shared = "file://" + tempfile.mkdtemp(prefix="pagelake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/pagelake/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is read from fewer and smaller files than there are: costly expressions follow. A
    table of many or large files is left as it is, so nothing large is shuffled for this."""
    spark = df.sparkSession
    n, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < n:
        return df
    conf = spark._jsc.hadoopConfiguration()
    size = 0
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += p.getFileSystem(conf).getFileStatus(p).getLen()
    return df.repartition(n) if size < n * (16 << 20) else df


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
