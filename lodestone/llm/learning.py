"""What the two classifiers share: the split of labelled rows, a training sample of bounded rows and bytes, and scoring of all rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, settings, text_or_empty

#: Labelled rows that a model is fitted on, about, and characters of them; chosen by a hash of doc_id.
SAMPLE, SAMPLE_CHARS = 12_000, 64_000_000


def remainder(mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def fit(docs: DataFrame, labels: DataFrame, target: str, mod: int, held: int, train: Callable, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> object | None:
    """``train(rows)`` in one task, over at most about ``sample`` labelled (text, target) that are not held out; None without such rows.

    Rows with a null id or label are left out. Labels are joined to documents by id, so several labels of one id all count. Texts come in
    the order of a hash of their id, and one that would take the sample past ``chars`` characters is passed over.
    """
    usable = labels.select("doc_id", F.col(target).cast("int").alias("target")).where((remainder(mod) != held) & F.col("target").isNotNull())
    place = F.xxhash64(F.lit("sample"), "doc_id")
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def chosen(batches: Iterator) -> Iterator:
        left = chars
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                if len(text) <= left:
                    left -= len(text)
                    yield text, y

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = chosen(batches)
        first = next(rows, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(chain([first], rows)))], pa.binary())], ["model"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(usable), "doc_id")  # the sample's size is set above
    one = rows.repartition(1).sortWithinPartitions(place, "doc_id", "text", "target")
    with settings(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch="500"):
        made = one.select("text", "target").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def scored(spark: SparkSession, model: object | None, scorer: Callable) -> Callable:
    """A column function from texts to scores. ``scorer(model)`` gives a function from texts to scores for one task."""
    import pandas as pd

    shared = spark.sparkContext.broadcast(model)  # of bounded size, as the sample is

    def run(batches):
        scores = scorer(shared.value) if shared.value is not None else lambda texts: [0.5] * len(texts)
        for batch in batches:
            yield pd.Series([x for part in bounded(batch.tolist(), 1 << 20) for x in scores(part)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def score(spark: SparkSession, docs: DataFrame, model: object | None, scorer: Callable, mod: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = docs.select("doc_id", F.coalesce(remainder(mod) == held, F.lit(False)).alias("held_out"), scored(spark, model, scorer)(text_or_empty()).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
