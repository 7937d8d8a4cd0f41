"""Sources and sinks besides Parquet tables: CSV in several ways, listings of files, JSON settings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.cleaning import filled, finite


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as the text that was written; empty fields are empty texts."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="\0", emptyValue="")


def clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types inferred; blank texts, NaN and infinities are null."""
    df = csv(spark, path)
    one = {"string": filled, "double": finite, "float": finite}
    return df.select(*[one[kind](F.col(f"`{c}`")).alias(c) if kind in one else F.col(f"`{c}`") for c, kind in df.dtypes])


def header(spark: SparkSession, path: str) -> list[str]:
    """Names of a CSV table's columns; its rows are not read."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def some_rows(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys``; the others' values are dropped where they are scanned if the keys are few."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def listing(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """path and length of the files below a folder whose names end in one of the suffixes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.where(F.lower(F.regexp_extract("path", "\\.[^./]*$", 0)).isin([s.lower() for s in suffixes]))


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON object, read through Spark so that any store will do; an error if it is none or empty."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    got = json.loads(text)
    if not isinstance(got, dict) or not got:
        raise ValueError(f"{path} must hold an object that is not empty")
    return got


def replaced(spark: SparkSession, path: str, write) -> None:
    """``write`` a table beside the one at ``path``, then put it in its place: a reader finds the old one until the new one is whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    write(new)
    at = hadoop(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at):
        fs.rename(at, hadoop(old))
    fs.rename(hadoop(new), at)
    fs.delete(hadoop(old), True)


def write_csv(df: DataFrame, path: str, replace: bool = False) -> None:
    """One folder of CSV files with headers; a table that is there is an error unless it is to be replaced, which happens at the end."""
    write = lambda to: df.write.csv(to, header=True, mode="errorifexists", emptyValue="")
    replaced(df.sparkSession, path, write) if replace else write(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="append", emptyValue="")


def write_parquet(df: DataFrame, path: str, replace: bool = False, by: list[str] | None = None) -> None:
    write = lambda to: df.write.partitionBy(*by or []).mode("errorifexists").parquet(to)
    replaced(df.sparkSession, path, write) if replace else write(path)
