"""Exact duplicates: keep the first row per key, in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from litsieve.operators.skew import lookup_by_key
from litsieve.session import durable


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def drop_duplicates(
    df: DataFrame, key: str | Sequence[str] = "title", order: str | Sequence[str] = "ord"
) -> DataFrame:
    """First row per key. Null keys are equal to each other.

    The rank filter is applied before the shuffle too (WindowGroupLimit), so
    each map task sends at most one row per key and a hot key stays small.
    """
    first = Window.partitionBy(*_names(key)).orderBy(*_names(order))
    return (
        df.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def keepers(
    df: DataFrame, key: str | Sequence[str] = "title", order: str = "ord"
) -> DataFrame:
    """One line per key: ``kept_ord`` and ``n_rows``. Combines map-side."""
    return df.groupBy(*_names(key)).agg(
        F.min(order).alias("kept_ord"), F.count("*").alias("n_rows")
    )


def mark_duplicates(
    df: DataFrame, key: str | Sequence[str] = "title", order: str = "ord", **skew
) -> DataFrame:
    """Every row with ``kept_ord`` and ``is_duplicate``."""
    # Written once: the lookup and its hot keys are read from it.
    lines = durable(keepers(df, key, order), "keepers")
    found = lookup_by_key(df, lines, _names(key), order, **skew)
    return found.withColumn("is_duplicate", F.col(order) != F.col("kept_ord"))


def duplicate_report(
    df: DataFrame, key: str | Sequence[str] = "title", order: str = "ord", **skew
) -> DataFrame:
    """Removed rows only: order, key, and the row that was kept instead."""
    marked = mark_duplicates(df.select(order, *_names(key)), key, order, **skew)
    return marked.filter("is_duplicate").drop("is_duplicate")


def dedup_stats(
    df: DataFrame, key: str | Sequence[str] = "title", by: str | None = None
) -> DataFrame:
    """``total``, ``removed``, ``kept``; per value of ``by`` when given."""
    group = [by] if by else []
    per_key = df.groupBy(*group, *_names(key)).agg(F.count("*").alias("n"))
    return per_key.groupBy(*group).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
        F.count("*").alias("kept"),
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; ``file_rank`` is the place in the list."""
    ranked = [f.withColumn("file_rank", F.lit(i)) for i, f in enumerate(frames)]
    out = ranked[0]
    for f in ranked[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_dedup(
    frames: Sequence[DataFrame], key: str = "title", order: str = "ord"
) -> DataFrame:
    """Dedup inside each frame, union, dedup across frames; earlier frames win.

    The first row per (frame, key) followed by the first per key is the first
    per key in (frame, order), so one window does the work of both stages.
    """
    return drop_duplicates(union_by_name(frames), key, ["file_rank", order])
