"""Session-level services: the shared folder, lineage cuts and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (local tests) is a folder of this process made and removed at exit.
    """
    global _OWN
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="quarrymill-")
        atexit.register(shutil.rmtree, _OWN, True)
    return "file://" + _OWN


class Workspace:
    """Named intermediate tables of one operator run, written as Parquet to the shared folder.

    Reading a written table cuts the lineage: a lost executor costs only the tasks it ran, never the
    stages before the table. ``drop`` frees tables that later steps no longer need.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quarrymill/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._last: dict[str, str] = {}

    def cut(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the written table; an older table of this name stays readable until ``drop``."""
        path = f"{self.root}/{name}-{self._n}"
        self._n += 1
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        self._last[name] = path
        return self.spark.read.schema(self.spark.read.parquet(path).schema).parquet(path)

    def path(self, name: str) -> str:
        return self._last[name]

    def drop(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """``cut`` that replaces the table of the step before: for iterations that read only their last state."""
        before = self._last.get(name)
        out = self.cut(df, name)
        if before:
            self.drop(before)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(df: DataFrame, **exprs) -> dict:
    """One row of aggregates as a dict: the only kind of result operators bring to the driver."""
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict()


def local_session(app: str = "quarrymill", cores: int | str = "*", **conf) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRYMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


__all__ = ["DataFrame", "F", "SparkSession", "Workspace", "fold", "local_session", "shared_folder", "table"]
