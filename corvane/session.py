"""A session with the settings this package is written for, and what queries take from theirs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC as in the SQL the queries are held against; adaptive plans size and split shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster's session is the cluster's to make."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", driver_memory)
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | {k: str(v) for k, v in more.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of `df`, from the sizes of the files that it reads: no job runs. Very large where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local session has a folder of
    its machine, as in tests; on a cluster that is an error. The session's settings stay as they are."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL_DIRS:
            _LOCAL_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        found = _LOCAL_DIRS[context.applicationId]
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings for the queries run inside (dots are written as two underscores); those before are put back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
