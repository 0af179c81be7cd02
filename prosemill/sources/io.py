"""Reading and writing JSON lines, CSV, text, manifests, fingerprints and reports."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosemill.functions import text as X


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = True) -> DataFrame:
    """JSON lines with a declared schema; a missing file is an empty table unless missing_ok is false."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """CSV with a header, all columns strings; quoted values may span lines. Missing required columns raise."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lacking = [c for c in required or [] if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_clean_lines(spark: SparkSession, path: str, least_words: int = 1) -> DataFrame:
    """(line): trimmed lines of text files with at least least_words words."""
    t = spark.read.text(path).select(X.strip(F.col("value")).alias("line"))
    return t.filter(X.word_count(F.col("line")) >= least_words)


def text_column(df: DataFrame, preferred: list[str]) -> str:
    """The first preferred column that df has, else its first column."""
    return next((c for c in preferred if c in df.columns), df.columns[0])


def read_keywords(spark: SparkSession, path: str, most_chars: int = 40) -> DataFrame:
    """(keyword): distinct lower-case lines of lexicon files without comments, shorter than most_chars."""
    t = spark.read.text(path).select(F.lower(F.trim("value")).alias("keyword"))
    return t.filter((F.col("keyword") != "") & ~F.col("keyword").startswith("#") & (F.length("keyword") < most_chars)).distinct()


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, position) of a topics file: a YAML list of '- topic' items, or plain lines without comments."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    item = r"^\s*-\s+[\"']?(.*?)[\"']?\s*$"
    items = F.transform(F.filter("lines", lambda x: x.rlike(item)), lambda x: F.regexp_extract(x, item, 1))
    plain = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return text.select(F.posexplode(F.when(F.size(items) > 0, items).otherwise(plain)).alias("position", "topic")).select("topic", "position")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if it doesn't exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def latest_run(spark: SparkSession, folder: str, pattern: str = r".*") -> str | None:
    """The greatest name that matches in a folder, or None."""
    names = [n for n in _names(spark, folder) if re.fullmatch(pattern, n)]
    return f"{folder.rstrip('/')}/{max(names)}" if names else None


def latest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The checkpoint with the greatest step number, or None."""
    steps = [(int(m.group(1)), n) for n in _names(spark, folder) if (m := re.search(r"(\d+)$", n))]
    return f"{folder.rstrip('/')}/{max(steps)[1]}" if steps else None


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the given columns in their order; others are ignored."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON document; gives it back."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a manifest is one row")
    made = rows[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f, indent=2, default=str, ensure_ascii=False)
    return made


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest_matches(spark: SparkSession, manifest: dict, path: str, field: str = "source_sha256") -> bool:
    """Whether the manifest was made from the file as it is now."""
    return manifest.get(field) == fingerprints(spark, path).select("sha256").first()[0]


def markdown_table(df: DataFrame, decimals: dict[str, int] | None = None, most_rows: int = 1000) -> str:
    """A small result as a Markdown table; more than most_rows rows are an error."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a report")
    show = lambda c, v: "" if v is None else f"{v:.{decimals[c]}f}" if decimals and c in decimals else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in rows)])
