"""Helpers that shape the plan, not the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, *names: str) -> DataFrame:
    """Makes sure the named columns are computed once per row.

    A filter on a computed column is pushed below the projection and evaluates
    the expression again, once per mention. A one-element explode stops that:
    predicates on a generator's output stay above it. It is an outer one: for a plain
    explode Spark infers a filter on the array's size, which below nested pruning
    holds the whole expression, and pushes that down to the input.
    """
    others = [c for c in df.columns if c not in names]
    packed = F.array(F.struct(*names))
    held = df.select(*others, F.explode_outer(packed).alias("_held"))
    return held.select(*others, *[F.col(f"_held.{n}").alias(n) for n in names])


def micros(time: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    col = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Uses all cores for a CPU-heavy projection over an input of few splits.

    Large inputs have more splits than cores and pass through unchanged, so no
    shuffle is added where it would cost something.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


ROWS_A_TASK = 100_000


def in_tasks(df: DataFrame, rows: int, *keys: str, a_task: int = ROWS_A_TASK) -> DataFrame:
    """Rows by key in as many tasks as ``rows`` need at ``a_task`` rows each, one per core at least.

    Splits follow bytes, and adaptive execution merges by bytes too; where a few bytes a row
    become many in memory, a task's work and memory would grow with the input. ``rows``: the
    number that is brought here, or of the input that it comes from (Parquet footers have it).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // a_task)), *keys)
