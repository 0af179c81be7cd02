"""Session helpers: table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame; columns are pruned by the caller's select."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for costly work behind the scan of a few small files.

    A scan with at least half as many partitions as cores, which any large
    input has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() * 2 < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Only a local session without it (tests) gets
    a temporary folder; a cluster without it is an error, since a machine-local
    folder can't be read by the other executors.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="prosemill-checkpoint-")
    sc.setCheckpointDir(path)
    return path


_written: list[tuple[SparkSession, str]] = []


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; it outlives any executor.

    Unlike an RDD checkpoint it is compressed and later readers prune columns.
    The tables of a session are removed when its process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/prosemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            sc = spark.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, wherever it was imported from."""
    sc = spark.sparkContext
    if _shipped.get("app") == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="prosemill-code-"), "prosemill_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _shipped["app"] = sc.applicationId


_shipped: dict[str, str] = {}
