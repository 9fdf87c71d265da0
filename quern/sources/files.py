"""Readers and writers: JSON lines, site lists, CSV, whole texts, run logs."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "content_type", "language_hint", "text")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects of a line-delimited JSON file; blank lines are skipped, anything else that isn't an object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_object(path: str) -> dict:
    """The one JSON object of a small file on the driver; anything else is a TypeError."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise TypeError(f"no JSON object: {path}")
    return value


def read_stream(spark: SparkSession, stream: IO[str]) -> DataFrame:
    """A whole text stream, such as standard input, as one row (path, text, sha256)."""
    text = stream.read()
    return spark.createDataFrame([("-", text)], "path string, text string").withColumn("sha256", F.sha2("text", 256))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an evidence log; missing fields are empty."""
    return read_jsonl(spark, path, EVIDENCE).na.fill("")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, url) of a JSON array of sites; the place in the array is the order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<struct<name:string,url:string>>", {"mode": "FAILFAST"})))
    return rows.select(F.col("pos").alias("ordinal"), "col.name", "col.url")


def read_scores(spark: SparkSession, path: str, required: list[str], delimiter: str = ",") -> DataFrame:
    """A CSV with a header, byte order mark or not; missing columns are named in the error."""
    df = spark.read.csv(path, header=True, sep=delimiter, encoding="utf-8")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha256) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the bytes of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows appended to a folder of JSON lines."""
    df.write.mode("append").json(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A table under one folder for each value of `by`, so that readers prune it."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_pointer(data: dict, path: str) -> None:
    """A small JSON object, put in place in one step; NaN is an error."""
    text = json.dumps(data, ensure_ascii=False, sort_keys=True, allow_nan=False)
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def export_csv(rows: DataFrame, path: str, mark: bool = True) -> int:
    """A report as one CSV with byte order mark and CRLF, streamed row by row through the driver; the number of rows."""
    n, target = 0, Path(path)
    fd, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w", encoding="utf-8-sig" if mark else "utf-8", newline="") as f:
        writer = csv.writer(f, lineterminator="\r\n")
        writer.writerow(rows.columns)
        for row in rows.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    os.replace(name, target)
    return n
