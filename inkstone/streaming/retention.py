"""The newest rows of an append-only table, by a bound that only moves up.

Every file has a line with its least and greatest order and its number of rows. If
the files that lie above some bound hold ``cap`` rows, nothing below that bound can
be among the newest ``cap``: such files are never read again and may be deleted. The
exact bound is looked up in the files that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import nth_greatest

STATS = "file string, least {t}, greatest {t}, n long, batch_id long"


class Retained:
    """A table below a folder that all executors share; ``order`` is a column of numbers that grows with arrival."""

    def __init__(self, spark: SparkSession, path: str, order: str) -> None:
        self.spark, self.path, self.order = spark, path.rstrip("/"), order
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._fs.delete(self._jvm.Path(path), True)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write one batch; a batch that is run again replaces its own files."""
        to = f"{self.path}/rows/batch_id={batch_id}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(to)
        own = self.spark.read.schema(rows.schema).parquet(to)
        own.groupBy(F.input_file_name().alias("file")).agg(
            F.min(self.order).alias("least"), F.max(self.order).alias("greatest"), F.count("*").alias("n")
        ).write.mode("overwrite").parquet(f"{self.path}/stats/batch_id={batch_id}")

    def stats(self, before: int | None = None) -> DataFrame | None:
        """One line per file of batches below ``before``."""
        if not self._fs.exists(self._jvm.Path(f"{self.path}/stats")):
            return None
        lines = self.spark.read.parquet(f"{self.path}/stats")
        return lines if before is None else lines.filter(F.col("batch_id") < before)

    def bound(self, stats: DataFrame, cap: int):  # noqa: ANN201
        """The greatest least of a file such that files from there on hold ``cap`` rows; None if all files together do not."""
        upto = Window.orderBy(F.desc("least")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return stats.withColumn("above", F.sum("n").over(upto)).filter(F.col("above") >= cap).agg(F.max("least")).first()[0]

    def forget(self, cap: int, before: int) -> None:
        """Delete the files of batches below ``before`` that lie below the bound these batches give."""
        stats = self.stats(before)
        if stats is None:
            return
        edge = self.bound(stats, cap)
        if edge is None:
            return
        gone = stats.filter(F.col("greatest") < edge)
        whole = stats.groupBy("batch_id").agg(F.max("greatest").alias("g")).filter(F.col("g") < edge)
        for row in gone.join(whole, "batch_id", "left_anti").select("file").toLocalIterator():
            self._delete(row["file"])
        for row in whole.toLocalIterator():
            self._delete(f"{self.path}/rows/batch_id={row['batch_id']}")
            self._delete(f"{self.path}/stats/batch_id={row['batch_id']}")

    def newest(self, cap: int) -> DataFrame:
        """The newest ``cap`` rows (all with the least kept order, should several have it)."""
        stats = self.stats()
        if stats is None:
            raise ValueError(f"nothing has been appended to {self.path}")
        edge = self.bound(stats, cap)
        files = stats if edge is None else stats.filter(F.col("greatest") >= edge)
        rows = self.spark.read.parquet(*[r["file"] for r in files.select("file").toLocalIterator()])
        if edge is None:
            return rows
        return rows.filter(F.col(self.order) >= nth_greatest(rows, self.order, cap))
