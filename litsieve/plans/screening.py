"""The screening flow: union, exact dedup, near-duplicate dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from litsieve.operators.dedup import union_dedup
from litsieve.operators.fuzzy import LENGTH_BAND, comparison_count, fuzzy_dedup, fuzzy_matches
from litsieve.session import durable


def screen(
    frames: Sequence[DataFrame],
    key: str = "title",
    order: str = "ord",
    threshold: float = 0.85,
    **options,
) -> DataFrame:
    """Exact dedup within and across frames, then the near duplicates.

    Rows rank by frame, then by ``order``, so frames may number their rows alike.
    """
    exact = durable(union_dedup(frames, key, order), "exact")
    placed = exact.select(
        *exact.columns, F.struct("file_rank", F.col(order).alias("in_frame")).alias("_place")
    ).repartitionByRange("_place").sortWithinPartitions("_place")
    ranked = durable(placed.withColumn("_rank", F.monotonically_increasing_id()), "ranked")
    return fuzzy_dedup(ranked, key, "_rank", threshold=threshold, numbered=True, **options).select(exact.columns)


def fuzzy_report(df: DataFrame, key: str = "title", order: str = "ord", **options) -> DataFrame:
    """One line: total, comparisons (as the one-by-one procedure makes them),
    removed, kept, leaders, skipped (leaders and members)."""
    hits = durable(fuzzy_matches(df, key, order, **options), "matches")
    compared = comparison_count(df, hits, key, order, options.get("band", LENGTH_BAND))
    removed = hits.agg(
        F.count("*").alias("removed"), F.countDistinct("leader").alias("leaders")
    )
    total = df.agg(F.count("*").alias("total"))
    # Three one-line tables, joined on a constant.
    parts = [t.withColumn("_one", F.lit(1)) for t in (total, removed, compared)]
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").select(
        "total",
        "comparisons",
        "removed",
        (F.col("total") - F.col("removed")).alias("kept"),
        "leaders",
        (F.col("leaders") + F.col("removed")).alias("skipped"),
    )


def score_histogram(matches: DataFrame, steps: int = 20) -> DataFrame:
    """Number of matches per score step."""
    return matches.groupBy(F.floor(F.col("similarity") * steps).alias("step")).agg(
        F.count("*").alias("pairs")
    )
