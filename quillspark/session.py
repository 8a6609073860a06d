"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillspark", cpus: str = "*") -> SparkSession:
    """A local session with the settings the operators expect."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("QUILL_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}  # of each application, its own folder within the shared one


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``), removed when the driver ends.

    Only in local mode, where the setting is absent (tests, notebooks), a local folder is used; a cluster without it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-shared")
            os.makedirs(base[7:], exist_ok=True)
        _FOLDERS[app] = f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return f"{_FOLDERS[app]}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives the loss of executors.

    With ``by`` (its last columns), in folders of their values. Columnar and compressed, so it costs less disk than ``checkpoint()``.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for this frame; nothing may read it any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished work now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Use all cores for Python-heavy stages over few, small files.

    Large inputs already have more partitions than cores and stay as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *cols)
