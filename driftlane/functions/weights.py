"""Numeric expressions: weights, shares, decay, entropy, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlane.functions import fixed


def lookup(col: Column, table: dict, default) -> Column:
    """Value of a small fixed table; one CASE expression, no join."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def rank_weight(position: Column) -> Column:
    return 1.0 / F.log2(F.greatest(F.lit(1), F.coalesce(position, F.lit(1))) + 1.0)


def confidence_weight(confidence: Column) -> Column:
    return lookup(confidence, fixed.CONFIDENCE_WEIGHT, fixed.OTHER_CONFIDENCE_WEIGHT)


def round_even(col: Column, digits: int) -> Column:
    """Half-even rounding, used where a rounded value feeds a later step."""
    return F.bround(col, digits)


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def bounded_number(col: Column) -> Column:
    """Number clamped to [0, 1]; junk and null count as 0."""
    return clamp(F.coalesce(col.try_cast("double"), F.lit(0.0)))


def or_default(col: Column, default) -> Column:
    """Null and zero both fall back to the default."""
    return F.when(col.isNull() | (col == 0), F.lit(default)).otherwise(col)


def demand_signal(views: Column, age_hours: Column) -> Column:
    per_day = views / (F.greatest(F.lit(1.0), age_hours) / 24.0)
    return F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1.0), per_day + 1.0)) / 6.0)


def freshness(age_days: Column) -> Column:
    age = F.greatest(F.lit(0.0), age_days)
    return F.when(age_days.isNull(), 0.30).otherwise(clamp(1.0 / (1.0 + F.log10(1.0 + age)), 0.15, 1.0))


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def in_window(age: Column, name: str) -> Column:
    oldest, _, keep_today = fixed.WINDOWS[name]
    cond = age >= (0 if keep_today else 1)
    return cond if oldest is None else cond & (age <= oldest)


def decayed_sum(weight: Column, age: Column, name: str) -> Column:
    """Aggregate: decayed sum over one look-back window."""
    return F.coalesce(
        F.sum(F.when(in_window(age, name), weight * decay(age, fixed.WINDOWS[name][1]))), F.lit(0.0)
    )


def entropy(share: Column, count: Column) -> Column:
    """Aggregate: normalised Shannon entropy; 0 for one value or none."""
    return F.when(
        count > 1, -F.sum(F.when(share > 0, share * F.ln(share))) / F.ln(count)
    ).otherwise(0.0)


def share_in_group(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Share of the group's positive total, by window.

    Only for rows already aggregated to (group, key) where the number of keys
    is bounded by a dictionary or a cap: one task sees one whole group.
    """
    total = F.sum(value).over(W.partitionBy(*group))
    return df.filter(F.col(value) > 0).withColumn(out, F.col(value) / total)


def share_in_open_group(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Share of the group's positive total for groups of any size.

    Totals come from a partial + final aggregate and are joined back, so a hot
    group is never held by one task; adaptive execution splits its join part.
    """
    rows = df.filter(F.col(value) > 0)
    totals = rows.groupBy(*group).agg(F.sum(value).alias("_total"))
    return rows.join(totals, group).withColumn(out, F.col(value) / F.col("_total")).drop("_total")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First k rows per group. ``row_number() <= k`` lets Spark cut every map
    partition to k rows per group before the shuffle, so hot groups stay small."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def zone(rank: Column, share: Column, top: Column, core: tuple, adjacent: tuple) -> Column:
    """core / adjacent / exploration; ``core`` and ``adjacent`` are (floor, factor)."""
    return (
        F.when((rank == 1) | (share >= F.greatest(F.lit(core[0]), top * core[1])), "core")
        .when(share >= F.greatest(F.lit(adjacent[0]), top * adjacent[1]), "adjacent")
        .otherwise("exploration")
    )


SESSION_ZONES = ((0.18, 0.55), (0.065, 0.22))
SNAPSHOT_ZONES = ((0.20, 0.55), (0.07, 0.22))
