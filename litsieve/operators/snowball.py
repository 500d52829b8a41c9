"""Expansion of seed articles over citation links ``edges(src, dst)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from litsieve.functions.similarity import MEASURES
from litsieve.functions.text import normalise_title
from litsieve.operators.fuzzy import LENGTH_BAND, edges_between, representatives
from litsieve.session import durable

DIRECTIONS = ("cited_by", "references", "related")


def resolve_seeds(
    seeds: DataFrame, articles: DataFrame, title: str = "title", order: str = "ord"
) -> DataFrame:
    """(seed_title, seed): the first article with the same normalised title.

    Seeds nothing matches are absent.
    """
    wanted = seeds.select(
        F.col(title).alias("seed_title"), normalise_title(F.col(title)).alias("_norm")
    ).distinct()
    # Articles shrink to one line per title before the join.
    known = (
        articles.select(normalise_title(F.col(title)).alias("_norm"), F.col(order).alias("seed"))
        .filter(F.col("_norm") != "")
        .groupBy("_norm")
        .agg(F.min("seed").alias("seed"))
    )
    return wanted.join(known, "_norm").select("seed_title", "seed")


def resolve_seeds_by_score(
    seeds: DataFrame,
    articles: DataFrame,
    title: str = "title",
    order: str = "ord",
    threshold: float = 0.85,
    metric: str = "ratcliff",
    band: int = LENGTH_BAND,
    **sizes,
) -> DataFrame:
    """(seed_title, seed, similarity): the equal title as ``resolve_seeds`` has it, else
    the article with the best score from ``threshold`` on, the first among equals.

    Seeds that nothing is similar to are absent. Only seeds without an equal title
    are compared, by the same join as near duplicates are.
    """
    equal = durable(resolve_seeds(seeds, articles, title, order), "equal")
    names = seeds.select(F.col(title).alias("seed_title")).distinct()
    # Numbered above all articles, which is the order the join of two tables expects.
    number = F.lit(1 << 62) + F.pmod(F.xxhash64("seed_title"), F.lit(1 << 61))
    left = durable(
        names.join(equal.select("seed_title"), "seed_title", "left_anti").withColumn("_ord", number), "left"
    )
    measure = MEASURES[metric](threshold)
    rest = durable(representatives(left, "seed_title", "_ord", measure, band), "seed-titles")
    kept = durable(representatives(articles, title, order, measure, band), "article-titles")
    pairs = edges_between(kept, rest, kept.count() + rest.count(), threshold, band, measure, **sizes)
    best = pairs.groupBy("hi").agg(
        F.max_by("lo", F.struct("similarity", -F.col("lo"))).alias("seed"), F.max("similarity").alias("similarity")
    )
    norm = normalise_title(F.col("seed_title"))
    scored = left.withColumn("_norm", norm).join(rest.select(F.col("norm").alias("_norm"), F.col("ord").alias("hi")), "_norm")
    return equal.withColumn("similarity", F.lit(1.0)).unionByName(
        scored.join(best, "hi").select("seed_title", "seed", "similarity")
    )


def cited_by(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, found, score): articles that cite the seed."""
    return _one_hop(seeds, edges, "dst", "src")


def references(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, found, score): articles the seed cites."""
    return _one_hop(seeds, edges, "src", "dst")


def _one_hop(seeds: DataFrame, edges: DataFrame, near: str, far: str) -> DataFrame:
    """One pass over the links; the engine splits the task of a seed with very many."""
    links = edges.select(F.col(near).alias("seed"), F.col(far).alias("found"))
    return (
        links.join(seeds.select("seed").distinct(), "seed")
        .filter(F.col("found") != F.col("seed"))
        .distinct()
        .withColumn("score", F.lit(1).cast("bigint"))
    )


def related(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, found, score): articles that share references, and how many.

    The references of the seeds alone are matched with the links, and the
    counts combine map-side, so a much-cited article adds one line per citing
    article and seed that cites it, never all pairs of its citing articles.
    """
    links = edges.select(F.col("src").alias("found"), "dst").distinct()
    mine = seeds.select("seed").distinct().join(links.withColumnRenamed("found", "seed"), "seed")
    return (
        links.join(mine, "dst")
        .filter(F.col("found") != F.col("seed"))
        .groupBy("seed", "found")
        .agg(F.count("*").alias("score"))
    )


def capped(found: DataFrame, n: int) -> DataFrame:
    """At most ``n`` per seed and direction, best score first, then by id."""
    best = Window.partitionBy("seed", "direction").orderBy(F.desc("score"), F.asc("found"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def snowball(
    edges: DataFrame,
    seeds: DataFrame,
    directions: Sequence[str] = DIRECTIONS,
    cap: int = 50,
) -> DataFrame:
    """(seed, direction, found, score, rank). A direction without links is empty."""
    seeds = durable(seeds.select("seed").distinct(), "seeds")
    step = {"cited_by": cited_by, "references": references, "related": related}
    parts = [
        capped(step[d](seeds, edges).withColumn("direction", F.lit(d)), cap) for d in directions
    ]
    return reduce(DataFrame.unionByName, parts).select("seed", "direction", "found", "score", "rank")


def merged(found: DataFrame) -> DataFrame:
    """One line per seed and article, with the directions that led to it."""
    return found.groupBy("seed", "found").agg(
        F.array_join(F.array_sort(F.collect_set("direction")), ",").alias("directions")
    )
