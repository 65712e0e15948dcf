"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables written so far, oldest first: (folder, application id).
_written: list[tuple[str, str]] = []


def build_session(app: str = "inkstone", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans are written for.

    On a cluster leave ``master`` unset and let spark-submit decide; shuffle
    partitions then come from AQE coalescing a high initial number. Name the
    shared scratch folder in ``spark.checkpoint.dir``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset a folder of this machine is made, but only if the session
    runs on this machine alone (master ``local``); elsewhere executors would
    not see each other's files, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder."""
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((path, spark.sparkContext.applicationId))
    return path


def scratch_tables(spark: SparkSession) -> list[str]:
    """This application's scratch folders that have not been dropped, oldest first."""
    return [path for path, app in _written if app == spark.sparkContext.applicationId]


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch folders (all of this application by default).

    Call it when the results that read them have been written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in scratch_tables(spark) if paths is None else list(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    gone = set(scratch_tables(spark) if paths is None else paths)
    _written[:] = [x for x in _written if x[0] not in gone]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches of a plan: lineage is cut, a
    lost executor re-reads files, and the reader sees real column statistics.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
