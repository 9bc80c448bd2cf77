"""Session settings, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "convoweave", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and bench use; on a cluster pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in tests, a temporary folder is set.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="convoweave-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def last_version(spark: SparkSession, folder: str) -> int:
    """The last `version=` below `folder` that Spark has committed, empty or not, by a listing of the folder; 0 before the first."""
    paths = spark._jvm.org.apache.hadoop.fs
    path = paths.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    versions = (s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("version="))
    return max((int(v.getName()[8:]) for v in versions if files.exists(paths.Path(v, "_SUCCESS"))), default=0)


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for what runs inside, restored afterwards."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
