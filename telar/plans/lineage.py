"""Cutting a plan's lineage through a table in the cluster's shared folder.

Iterative operators write each round to a Parquet table under ``spark.checkpoint.dir`` and read it back.  A written table
survives the loss of any executor, is columnar and compressed, and can be deleted as soon as the next round has been written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, but on a local master only."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="telar-")
    return f"file://{_own[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already: nothing is left to do then
        pass


_open: set[tuple[str, str]] = set()


def close(spark: SparkSession) -> int:
    """Delete the tables of all operators run in a session so far, for sessions that run many; their results must have been written."""
    mine = [(app, root) for app, root in _open if app == spark.sparkContext.applicationId]
    for app, root in mine:
        _delete(spark, root)
        _open.discard((app, root))
    return len(mine)


class Scratch:
    """Tables of one run of an operator; the folder is deleted by ``close`` or when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/telar-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _open.add((spark.sparkContext.applicationId, self.root))
        atexit.register(_delete, spark, self.root)

    def cut_counted(self, df: DataFrame, tag: str, *metrics: Column) -> tuple[DataFrame, dict[str, object]]:
        """``cut`` with aggregates over the written rows, observed while they are written.

        A stage that is run again after the loss of an executor may count rows twice: for tests of change, not for results.
        """
        seen = Observation()
        out = self.cut(df.observe(seen, *metrics), tag)
        return out, seen.get

    def cut(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{tag}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._telar_path = path
        return out

    def discard(self, df: DataFrame | None) -> None:
        """Delete a table made by ``cut`` that no plan will read again."""
        path = getattr(df, "_telar_path", None)
        if path:
            _delete(self.spark, path)
