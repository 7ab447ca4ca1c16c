"""Session helpers: a tuned local session, the shared folder and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_local_shared: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session as the tests and bench.py use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marquee")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else (tests) one of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_shared:
        _local_shared.append("file://" + tempfile.mkdtemp(prefix="marquee-shared-"))
    return _local_shared[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that cuts lineage."""
    return f"{shared_dir(spark)}/marquee/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession):
    """Shuffle files of what runs inside are deleted as soon as it has ended; for writes, whose shuffles nothing reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df, name: str):
    """df written as a table in the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, so that its functions can be loaded wherever they run; once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="marquee-ship-"), "marquee.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, f"marquee/{file.relative_to(_PACKAGE)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, directory: str, name: str):
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
