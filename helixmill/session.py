"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='helixmill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Written tables that go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame | None, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` after a round trip through Parquet in the shared folder: short lineage, computed once."""
        path = shared_path(self.spark, "table")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, or all, through Spark's own file system layer."""
        gone = [path for table, path in self.held if not tables or any(table is x for x in tables)]
        self.held = [(table, path) for table, path in self.held if path not in gone]
        jvm = self.spark.sparkContext._jvm
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Tables that results still read; they go when the interpreter ends, or by ``release`` once results have been taken.
RESULTS: list[Scratch] = []


def _results(spark: SparkSession) -> Scratch:
    if not RESULTS or RESULTS[-1].spark is not spark:
        RESULTS.append(Scratch(spark))
    return RESULTS[-1]


def written(df: DataFrame) -> DataFrame:
    """Like ``Scratch.write``, for tables that a result reads."""
    return _results(df.sparkSession).write(df)


def result_path(spark: SparkSession, name: str) -> str:
    """A new shared path for files that a result reads; they go like the tables of ``written``."""
    path = shared_path(spark, name)
    _results(spark).held.append((None, path))
    return path


def release() -> None:
    """Deletes the tables and files behind all results so far, which can't be read any more, except of stopped sessions."""
    while RESULTS:
        scratch = RESULTS.pop()
        if scratch.spark.sparkContext._jsc is not None:
            scratch.drop()


@atexit.register
def _release_at_exit() -> None:
    with contextlib.suppress(Py4JError):  # the JVM may be gone already
        release()
