"""Helpers shared by the text operators: reading, scratch tables in the shared folder, splitting, mixing of hashes, names of columns."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import settings

#: What holds while a table is written: shuffle files go when the query ends, and Python gets few rows at a time, which may be long.
WRITING = {"spark_sql_classic_shuffleDependency_fileCleanup_enabled": "true", "spark_sql_execution_arrow_maxRecordsPerBatch": "1000"}
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local one is set only in local mode (tests), where there is none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            at = jsc.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            at = os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a Parquet table in the shared folder and read it back: lineage ends there and no column is computed twice.

    The table survives the loss of executors. Columns keep names and order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    with settings(spark, **WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def spent(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote and that nothing will read again."""
    for table in tables:
        path = getattr(table, "_lodestone_path", None)
        if path is not None:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, made longer where a column in ``taken`` has the name already (in whatever case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def once(name: str, make: Callable) -> object:
    """What ``make`` gives, made once a process: the tasks that a worker runs one after the other share it."""
    store = sys.modules.setdefault("_lodestone_once", types.ModuleType("_lodestone_once")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def bounded(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """Consecutive parts of about ``most`` characters, one text at least."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], spread, salts: int = 64) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for their ``keys`` (no nulls in them), however many rows share a key.

    ``spread`` deals a key's rows to ``salts`` parts. Each part of a key that occurs has its own row to meet, at most ``salts`` a key, so
    no task gets all rows of a key and nothing is broadcast.
    """
    (salt,) = fresh([*rows.columns, *groups.columns], "salt")
    dealt = rows.withColumn(salt, F.pmod(spread, F.lit(salts)).cast("int"))
    parts = dealt.select(*keys, salt).distinct().join(groups, keys)
    return dealt.join(parts, [*keys, salt], "left").drop(salt)
