"""Tables that end a lineage: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names; a local folder only in local mode, where it is unset."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.gettempdir()
    path = f"{at.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again; others are left alone."""
    for table in tables:
        path = getattr(table, "_lodestone_scratch", None)
        if path is not None:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Within it, these settings (with _ for .) hold."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
