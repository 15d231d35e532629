"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared checkpoint folder: they cut lineage and survive lost executors.

    The folder is that of spark.checkpoint.dir.  Only a local master, whose one machine is all there is, may go
    without: its tables then lie beside the warehouse.  All tables go when the session's JVM ends, or with drop().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch/{spark.sparkContext.applicationId}"
        self.base = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}
        self.written = 0
        path, fs = self._fs(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.base}/{name}-{self.written}"
        with settings(self.spark, {_CLEAN: "true", _BATCH: str(16 << 20)}):
            df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, keep: int = 0) -> None:
        """Delete tables that nothing reads any more: those of the names, but for the last `keep`."""
        for name in names:
            held = self.paths.pop(name, [])
            self.paths[name] = held[len(held) - keep :]
            for old in held[: len(held) - keep]:
                path, fs = self._fs(old)
                fs.delete(path, True)
