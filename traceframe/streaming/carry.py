"""Rows handed from one micro-batch to the next, as a versioned table on shared storage.

``foreachBatch`` gives every micro-batch to the batch operators, which split busy keys over tasks. What they
must remember (open tracebacks, the context ring, recent events, counts) is a small table written
under the batch's id. A replayed batch reads the version before it and overwrites its own, so a restart
or a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Carry:
    """Versioned carry table at ``path`` (a folder next to the query's checkpoint)."""

    def __init__(self, path: str, keep: int = 3):
        self.path, self.keep = path.rstrip("/"), keep

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Rows left by the previous batch, None for the first."""
        if batch_id == 0:
            return None
        return spark.read.parquet(self._folder(batch_id - 1))

    def save(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(batch_id))
        if batch_id >= self.keep:
            self._forget(rows.sparkSession, batch_id - self.keep)

    def _forget(self, spark: SparkSession, version: int) -> None:
        jvm = spark._jvm
        old = jvm.org.apache.hadoop.fs.Path(self._folder(version))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
