"""Tables in the folder that driver and executors share, and the size of Python's batches."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows with texts that Spark hands to Python at once.
TEXT_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is configured, one is made for the time of a local master's process; a cluster needs one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The folder of the ``scratch`` that is open, below that of the application.
_OPEN: contextvars.ContextVar[str] = contextvars.ContextVar("open scratch", default="")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one, or that of the open ``scratch`` in it."""
    return os.path.join(shared_dir(spark), f"tables-{spark.sparkContext.applicationId}", _OPEN.get())


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Deletes all tables that this application has cut its lineage with; call it when their results are stored."""
    drop_folder(spark, run_folder(spark))


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """For jobs that store their result: the tables that lineage is cut with inside are deleted at the end, after a failure too."""
    name = os.path.join(_OPEN.get(), f"job-{uuid.uuid4().hex}")
    token = _OPEN.set(name)
    try:
        yield
    finally:
        drop_written(spark)
        _OPEN.reset(token)


def batch_rows(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the rows of an Arrow batch to what texts allow, which bounds memory on both sides. Nothing raises it again, so jobs do not depend on which was planned last."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A name for a new folder in the shared one."""
    return os.path.join(run_folder(spark), f"{kind}-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder and reads it back."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
