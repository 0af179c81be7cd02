"""Append-only logs as streams: tail, resume, ratchet, few-shot pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from prosemill.operators.relational import first_per


def tail(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A JSON-lines log as a stream; each file is read once, also after a restart."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def drain(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Append everything the log holds now to a Parquet table, then stop; the checkpoint makes it resume."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(stream: DataFrame, time: str, group: str, value: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, group, n, mean) over event time; rows later than the watermark are left out by the stream."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


COMPACT_EVERY = 20  # batches


def merge_best(stream: DataFrame, to: str, checkpoint: str, key: str, order: list[str], compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the best row per key: each batch writes only its own best rows, and now and then all are folded into one table.

    ``to`` holds v=<batch> folders with the best rows of a batch and base=<batch>
    folders with the best of all up to that batch. So a batch costs what it
    holds, not what the table holds. A batch that is repeated after a failure
    overwrites its own folders, so the result is the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first_per(batch, [key], order).select(*batch.columns).write.mode("overwrite").parquet(f"{to}/v={number}")
        if number % compact_every == compact_every - 1:
            both = _stored(spark, to, number)
            first_per(both, [key], order).select(*batch.columns).write.mode("overwrite").parquet(f"{to}/base={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, to: str) -> dict[str, list[int]]:
    """Numbers of the complete v and base folders."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(to)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"v": [], "base": []}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return found


def _stored(spark: SparkSession, to: str, below: int | None = None) -> DataFrame | None:
    """Rows of the newest base (older than batch ``below``) and of the batches behind it."""
    found = _complete(spark, to)
    base = max([n for n in found["base"] if below is None or n < below], default=-1)
    parts = [f"{to}/base={base}"] * (base >= 0) + [f"{to}/v={n}" for n in sorted(found["v"]) if n > base]
    return spark.read.parquet(*parts) if parts else None


def ratchet_table(spark: SparkSession, to: str, key: str, order: list[str]) -> DataFrame | None:
    """The merged table as it stands, or None before the first batch."""
    rows = _stored(spark, to)
    return None if rows is None else first_per(rows, [key], order).select(*rows.columns)
