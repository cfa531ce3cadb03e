"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where that is unset (tests): elsewhere no executor would see it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_gaugework_folder", None):
        sc._gaugework_folder = tempfile.mkdtemp(prefix="gaugework-")
        atexit.register(shutil.rmtree, sc._gaugework_folder, True)
    return f"file://{sc._gaugework_folder}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs nothing that was written.

    The files stay until the session ends, since frames that are still lazy may read them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugework-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes to; none is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a frame that written() gave and that nothing reads any more, before the session ends."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop(df.sparkSession, folder)


def drop_at_end(spark: SparkSession, path: str) -> None:
    def last() -> None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone first: the cluster's own clean-up of that folder remains
            pass

    atexit.register(last)
