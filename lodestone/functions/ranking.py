"""Ranks and scalings over a partition; ties go by the given columns, never by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, k: int | None, keys: list[str], *order, name: str = "rank") -> DataFrame:
    """Rows with a dense rank from 1 within keys; all of them if k is None."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)


def by_score(score: str, *ties: str) -> list[Column]:
    """Score down at six decimals, then the ties up."""
    return [F.round(F.col(score), 6).desc(), *[F.col(t).asc() for t in ties]]


def min_max(score: Column, keys: list[str]) -> Column:
    """(s - min) / (max - min) within keys; 1 where all are equal or there is one."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def min_max_or_same(score: Column, keys: list[str]) -> Column:
    """(s - min) / (max - min + 1e-8) within keys; unchanged where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, score).otherwise((score - low) / (high - low + 1e-8))


def keep_best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by the order."""
    return top_k(df, 1, keys, *order, name="_best").drop("_best")
