"""Parquet storage of matrices, counts, lengths, simulations and runs, under paths made from their settings."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


#: A hidden file beside a bucketed table's, which tells its layout.
LAYOUT = "_layout.json"


@dataclass(frozen=True)
class Problem:
    """Settings of an estimation problem."""

    filename: str
    N: int = 1000
    K: int = 15
    L: int = 100
    alpha: float = 0.1


@dataclass(frozen=True)
class ModelSettings:
    """Settings of a model and its solver."""

    model_type: str = "simplex"
    solver_name: str = "mg"
    beta: float = 1.0
    lrs: Any = None
    init_iterates: str = "uniform"


def config_hash(settings: dict) -> str:
    """md5 over key_value_ in key order, nested settings first hashed themselves."""
    text = "".join(f"{k}_{config_hash(v) if isinstance(v, dict) else v}_" for k, v in sorted(settings.items()))
    return hashlib.md5(text.encode()).hexdigest()


def merged(left: dict, right: dict) -> dict:
    """Both, the right one winning."""
    return {**left, **right}


class Store:
    """Tables below a root folder; any path that Spark writes will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, *settings: Any) -> str:
        """Where a table of these settings is."""
        parts = merged({}, {type(s).__name__: asdict(s) if not isinstance(s, dict) else s for s in settings})
        return f"{self.root}/{kind}/{config_hash(parts)}"

    def title(self, problem: Problem, model: ModelSettings) -> str:
        """A title for reports."""
        return f"{problem.filename} N{problem.N} K{problem.K} L{problem.L} alpha{problem.alpha} {model.model_type} {model.solver_name} beta{model.beta} {model.init_iterates}"

    def exists(self, path: str) -> bool:
        """Whether a table is complete there."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return bool(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at))

    def save(self, table: DataFrame, kind: str, *settings: Any, cluster: str | None = None) -> str:
        """Writes over what is there; ``cluster`` orders rows by a column inside ranges of it."""
        path = self.path(kind, *settings)
        laid = table.repartitionByRange(cluster).sortWithinPartitions(cluster) if cluster else table
        laid.write.mode("overwrite").parquet(path)
        return path

    def save_bucketed(self, table: DataFrame, kind: str, *settings: Any, by: str, buckets: int) -> str:
        """Writes over what is there, rows with one value of ``by`` in one bucket and in order inside each of its files.

        Tables with as many buckets by a column join and aggregate on it without an exchange. The layout lies beside the
        files, so that ``load`` knows it in any session.
        """
        path = self.path(kind, *settings)
        name = self._table(path)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        # Few buckets, or few values, would make few tasks that sort all rows: adaptive execution joins and cuts tasks by
        # their bytes instead, so that a large bucket is several files.
        table.hint("rebalance", by).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
        layout = json.dumps({"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema), "by": by, "buckets": buckets})
        at, store = self._at(f"{path}/{LAYOUT}")
        out = store.create(at, True)
        out.write(layout.encode())
        out.close()
        return path

    @staticmethod
    def _table(path: str) -> str:
        return f"store_{hashlib.md5(path.encode()).hexdigest()}"

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self, kind: str, *settings: Any) -> DataFrame:
        """The stored table, with its buckets if it has some."""
        path = self.path(kind, *settings)
        at, store = self._at(f"{path}/{LAYOUT}")
        if not store.exists(at):
            return self.spark.read.parquet(path)
        name = self._table(path)
        if not self.spark.catalog.tableExists(name):
            stream = store.open(at)  # Spark's own readers pass hidden files by
            layout = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.spark.sql(f"CREATE TABLE {name} ({layout['schema']}) USING parquet CLUSTERED BY (`{layout['by']}`) SORTED BY (`{layout['by']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def cached(self, build, kind: str, *settings: Any, force_repeat: bool = False, cluster: str | None = None) -> DataFrame:
        """The stored table, built first if it isn't there or ``force_repeat``."""
        if force_repeat or not self.exists(self.path(kind, *settings)):
            self.save(build(), kind, *settings, cluster=cluster)
        return self.load(kind, *settings)


def write_csv(table: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header line."""
    table.write.mode(mode).csv(path, header=True)
