"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Settings that the results depend on; sizes are left to the cluster's own configuration.
FIXED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "tidewheel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the fixed settings; ``conf`` adds to or overrides them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**FIXED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a folder of this machine is made in local mode only; on a
    cluster its executors could not see it, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        set_ = sc._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            found = set_.get()
        elif not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
            sc.setCheckpointDir(found)
            found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that this session has written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Tables written inside of each open ``scratch``, the innermost last.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, but for those with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; the table, read back, and its path.

    This cuts the lineage: a lost executor costs the tasks that read, not the
    plan behind them. The table stays until an open ``scratch`` ends, or else until the
    shared folder is cleared.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The table of ``written``."""
    return written(df, name, keep)[0]


#: Spark's own sizes of an Arrow batch, and those for rows that hold whole documents.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few whole documents, on both sides of the pipe to Python.

    With Spark's own sizes each running task holds 64 MB outside of the heap, twice that
    while a buffer grows, and as much in Python. A session's own settings stay.
    """
    for key, (own, ours) in BATCHES.items():
        if spark.conf.get(key) == own:
            spark.conf.set(key, ours)
