"""Mixing sources to target weights, in DataFrame operations only.

A source's budget of words is met in two steps: as many whole epochs as fit, then
a weighted sample without replacement for the rest. The sample follows Efraimidis
and Spirakis: each document draws an exponential key divided by its quality weight,
documents are taken in the order of the keys, and a prefix sum over their sizes
says where the budget ends. The draw is a digest of the document's id (of its text,
where it has none), so that every run, and every retried task, takes the same documents.

A prefix sum over a source that holds a third of all rows doesn't fit into one
task. The keys are cut into ``bins`` ranges first; sums per range say in which
range the budget ends, and only that range's rows (1 of ``bins``) are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from litsieve.llm.common import read, unused, word_count
from litsieve.session import durable

BINS = 4096
#: Characters that count against a document's quality weight.
NOISE = "#*$%&|<>!0123456789"


def draw(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key over weight; the smallest keys are taken first."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(2.0**48)
    return -F.log(u) / weight


def source_targets(
    sources: DataFrame, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight), one per source.

    The targets share ``share`` times the sum of the sizes by weight; none exceeds
    ``most`` times its source's size, and what is above goes to the others by
    weight, until none is above. That is the level at which water stands in vessels
    of those widths: sorted by size over weight, the full vessels come first. The
    window runs over one short line per source. Sources without words get 0.
    """
    cap = F.col("source_size") * F.lit(float(most))
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy(F.lit(0))
    level = (F.col("_all") * F.lit(float(share)) - F.coalesce(F.col("_full"), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.col("_gone"), F.lit(0.0))
    )
    return (
        sources.withColumns(
            {
                "_all": F.sum(F.col("source_size").cast("double")).over(everyone),
                "_weights": F.sum(F.col("weight").cast("double")).over(everyone),
                "_full": F.sum(cap).over(upto),
                "_gone": F.sum(F.col("weight").cast("double")).over(upto),
                "_place": F.row_number().over(order),
            }
        )
        .withColumn("_level", level)
        # The first vessel that isn't filled sets the level of all that follow.
        .withColumn(
            "_level",
            F.min(
                F.when(F.col("_level") * F.col("weight") <= cap, F.struct("_place", "_level"))
            ).over(everyone)["_level"],
        )
        .withColumn("target", F.coalesce(F.least(cap, F.col("_level") * F.col("weight")), cap))
        .drop("_all", "_weights", "_full", "_gone", "_level", "_place")
    )


def by_code_point(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Repeating weights for sources in code point order, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.withColumn("weight", F.get(table, (place % len(weights)).cast("int")))


def mix(
    docs: DataFrame, targets: DataFrame, seed: str = "mix", bins: int = BINS, mark: str = "doc_id"
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs``: doc_id, source, size, quality (above 0), ``mark``, of which the draw is made,
    and what else is to be kept.
    ``targets``: source, source_size, target. Adds ``source_size``, ``target`` and
    ``taken``: whole epochs times size, plus the size of a document the sample
    takes; the document at which the budget ends is taken in part, from its start,
    so that a source's words come to its target, rounded down. Null sources form a
    source; rows without words take 0; repeated rows are documents of their own,
    and rows with equal keys are told apart by size. Columns whose names begin with
    ``_mix`` are overwritten.
    """
    keyed = docs.withColumn("_mix_key", draw(F.col(mark), F.col("quality"), seed))
    keyed = keyed.withColumn(
        "_mix_bin", F.least(F.lit(bins - 1), F.floor((1 - F.exp(-F.col("_mix_key"))) * bins)).cast("int")
    )
    goal = targets.select(
        F.col("source").alias("_mix_source"), "source_size", "target",
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).alias("_mix_epochs"),
    ).withColumn(
        "_mix_rest", F.floor(F.col("target") - F.col("_mix_epochs") * F.col("source_size")).cast("long")
    )
    running = W.partitionBy("source").orderBy("_mix_bin").rowsBetween(W.unboundedPreceding, -1)
    lines = (
        keyed.groupBy("source", "_mix_bin").agg(F.sum("size").alias("_mix_sum"))
        .withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(running), F.lit(0)))
        .join(goal, F.col("source").eqNullSafe(F.col("_mix_source")))
        .select("_mix_source", F.col("_mix_bin").alias("_mix_at"), "_mix_before", "_mix_sum", "source_size", "target", "_mix_epochs", "_mix_rest")
    )
    clash = [c for c in docs.columns if c in ("source_size", "target", "taken")]
    # Rows meet their range's line, so a large source is spread over its ranges.
    placed = keyed.drop(*clash).join(
        lines, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bin") == F.col("_mix_at"))
    )
    whole = F.col("_mix_epochs") * F.col("size")
    inside = F.col("_mix_before") + F.col("_mix_sum") <= F.col("_mix_rest")
    beyond = F.col("_mix_before") >= F.col("_mix_rest")
    apart = placed.filter(inside | beyond).withColumn("taken", whole + F.when(inside, F.col("size")).otherwise(0))
    order = (
        W.partitionBy("source", "_mix_bin")
        .orderBy("_mix_key", "doc_id", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    left = F.col("_mix_rest") - F.col("_mix_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    at_cut = placed.filter(~inside & ~beyond).withColumn(
        "taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), left))
    )
    kept = [c for c in docs.columns if c not in clash]
    return apart.unionByName(at_cut).select(
        *kept, "source_size", "target", F.col("taken").cast("long").alias("taken")
    )


def quality_weight(text: Column) -> Column:
    """0.5 to 1.5 by the share of characters that aren't noise; 0.5 without text."""
    kept = F.length(F.translate(text, NOISE, ""))
    return F.lit(0.5) + F.coalesce(F.try_divide(kept, F.length(text)), F.lit(0.0))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, quality and mark of documents, written once, with the columns
    ``more``. The mark tells documents apart: the id, else a digest of the text."""
    mark = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("none"))
    return durable(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            quality_weight(F.col("text")).alias("quality"), mark.alias("mark"), *more,
        ),
        "sized",
    )


def mixed_documents(sizes: DataFrame) -> DataFrame:
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mix(sizes, source_targets(by_code_point(totals)), mark="mark").drop("mark")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 3 : 1 : 2 by source."""
    return mixed_documents(sized(read(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: one row per time a document is taken, the last one cut to the
    words the budget leaves. Columns as in ``docs``. Every row is a document of its own,
    also those without an id or with a repeated one; null sources form a source; rows
    without words are not taken."""
    row, taker, size, taken, n = (unused(docs, f"_mix_{x}") for x in ("row", "taker", "size", "taken", "words"))
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    takes = mixed_documents(sized(rows, row)).filter("taken > 0").select(
        F.col(row).alias(taker), F.col("size").alias(size), F.col("taken").alias(taken)
    )
    spans = f"transform(sequence(0, cast(ceil({taken} / {size}) as int) - 1), i -> least({size}, {taken} - i * {size}))"
    out = rows.join(takes, F.col(row) == F.col(taker)).withColumn(n, F.explode(F.expr(spans)))
    pieces = F.regexp_extract_all("text", F.lit(rf"({WORD_AND_GAP})"), F.lit(1))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(n).cast("int")), "")
    return out.withColumn("text", F.when(F.col(n) < F.col(size), cut).otherwise(F.col("text"))).select(*docs.columns)


#: Leading white space belongs to the first word.
WORD_AND_GAP = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"

DOC_SQL = rf"""
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS size,
           0.5 + CASE WHEN coalesce(length(text), 0) > 0
                      THEN length(translate(text, '{NOISE}', '')) / length(text) ELSE 0.0 END AS quality,
           (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0 AS u
    FROM {{docs}}"""

MIX_SQL = """
    d AS ({doc_sql}),
    s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
                     WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
                  source_size * 2.0::DOUBLE AS cap FROM s0),
    s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
                      - coalesce(sum(cap) OVER below, 0.0::DOUBLE))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0.0::DOUBLE)) AS lvl,
                  row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS place
           FROM s1 WINDOW below AS (ORDER BY cap / weight, source ASC NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s3 AS (SELECT *, (min(CASE WHEN lvl * weight <= cap THEN {{'place': place, 'lvl': lvl}} END) OVER ()).lvl AS level FROM s2),
    s4 AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM s3),
    s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM s4),
    r AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.epochs, d.source,
                 floor(s5.target - s5.epochs * s5.source_size)::BIGINT AS rest,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id, d.size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
    mixed AS (SELECT doc_id, size, source_size, target,
                     (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source FROM r)"""

SQL = "WITH " + MIX_SQL.format(doc_sql=DOC_SQL.format(docs="documents")) + " SELECT * FROM mixed"
