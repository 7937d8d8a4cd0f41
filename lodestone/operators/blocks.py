"""Feature blocks: named Python functions of a row, run batch by batch, whose failures are told and never lose a row."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Registered blocks by name.
REGISTRY: dict = {}


class TooLong(Exception):
    pass


@dataclass(frozen=True)
class Block:
    """A function of a row (a dict) and of parameters that gives a dict of numbers, and the names that it can give."""

    name: str
    function: Callable[..., dict[str, float]]
    gives: tuple[str, ...]
    parameters: dict = field(default_factory=dict)


def block(name: str, *gives: str, **parameters):
    """Registers a function as a block; a name can be taken once."""

    def add(f: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"there is a block {name} already")
        REGISTRY[name] = Block(name, f, gives, parameters)
        return f

    return add


def chosen(names: list[str], overrides: dict[str, dict] | None = None) -> list[Block]:
    """Registered blocks by name, with parameters overridden; an error for unknown blocks and parameters."""
    for name, p in {**dict.fromkeys(names, {}), **(overrides or {})}.items():
        if name not in REGISTRY:
            raise ValueError(f"no block {name}")
        if odd := set(p) - set(REGISTRY[name].parameters):
            raise ValueError(f"block {name} has no parameter {', '.join(sorted(odd))}")
    return [replace(REGISTRY[n], parameters={**REGISTRY[n].parameters, **(overrides or {}).get(n, {})}) for n in names]


def featurized(df: DataFrame, blocks: list[Block], seconds: float | None = None) -> DataFrame:
    """``df`` with <block>__<name> for all that the blocks give, <block>__status (ok, failed or timeout) and <block>__error (null if ok).

    A block that fails for a row, or takes longer than ``seconds``, gives nulls there and says why; the other blocks and rows go on. What a
    block gives beyond its names is an error of that row, and a name that it leaves out is null.
    """
    names = [f"{b.name}__{n}" for b in blocks for n in b.gives]
    told = [f"{b.name}__{n}" for b in blocks for n in ("status", "error")]
    if clash := set(df.columns) & {*names, *told}:
        raise ValueError(f"columns {', '.join(sorted(clash))} are there already")
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names], *[StructField(n, StringType()) for n in told]])

    def limited(b: Block, row: dict) -> dict:
        if seconds is None:
            return b.function(row, **b.parameters)

        def stop(*_) -> None:
            raise TooLong

        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return b.function(row, **b.parameters)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made: dict[str, list] = {n: [] for n in [*names, *told]}
            for row in batch.to_pylist():
                for b in blocks:
                    status, error, got = "ok", None, {}
                    try:
                        got = dict(limited(b, row))
                        if odd := set(got) - set(b.gives):
                            raise ValueError(f"gives {', '.join(sorted(odd))} too")
                        got = {k: None if v is None else float(v) for k, v in got.items()}
                    except TooLong:
                        status, error, got = "timeout", f"more than {seconds} s", {}
                    except Exception as e:  # a row's failure is its result
                        status, error, got = "failed", f"{type(e).__name__}: {e}", {}
                    for n in b.gives:
                        made[f"{b.name}__{n}"].append(got.get(n))
                    made[f"{b.name}__status"].append(status)
                    made[f"{b.name}__error"].append(error)
            columns = [pa.array(v, pa.string() if n in told else pa.float64()) for n, v in made.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *made])

    return df.mapInArrow(run, schema)


def error_counts(df: DataFrame, blocks: list[Block]) -> DataFrame:
    """block, status and n of a table that featurized() made."""
    from pyspark.sql import functions as F

    each = F.explode(F.array(*[F.struct(F.lit(b.name).alias("block"), F.col(f"{b.name}__status").alias("status")) for b in blocks])).alias("x")
    return df.select(each).select("x.*").groupBy("block", "status").agg(F.count(F.lit(1)).alias("n"))
