"""Keyword frequencies of one text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from litsieve.functions.text import STOP_WORDS, noun_candidates, tag_class, word_tokens
from litsieve.session import durable


def token_rows(df: DataFrame, column: str = "title", order: str = "ord") -> DataFrame:
    """One row per token: order, pos, word. Null text yields no rows."""
    return df.select(
        order, F.posexplode(word_tokens(F.col(column).cast("string"))).alias("pos", "word")
    )


def _seen_at(rows: DataFrame, order: str) -> Column:
    """Place of a token in reading order, as one value.

    Whole-number orders pack into a decimal, which a hash aggregate can hold;
    a struct would force a sort of every token.
    """
    if isinstance(rows.schema[order].dataType, (T.LongType, T.IntegerType)):
        return F.col(order).cast("decimal(19,0)") * F.lit(10_000_000_000).cast(
            "decimal(11,0)"
        ) + F.col("pos").cast("decimal(10,0)")
    return F.struct(order, "pos")


def vocabulary(df: DataFrame, column: str = "title", order: str = "ord") -> DataFrame:
    """Distinct tokens: word, freq, first_seen. Combines map-side."""
    rows = token_rows(df, column, order).filter(F.length("word") > 2)
    return rows.groupBy("word").agg(
        F.count("*").alias("freq"), F.min(_seen_at(rows, order)).alias("first_seen")
    )


def is_keyword(word: Column, stop_words: Sequence[str]) -> Column:
    return ~word.isin(list(stop_words)) & (F.length(word) > 2)


def noun_lemmas(words: DataFrame) -> DataFrame:
    """(word, lemma) for words whose singular form is itself in ``words``.

    Works on distinct words, so its size is the vocabulary, not the corpus.
    The shortest form found wins, then rule order.
    """
    forms = words.select("word", F.posexplode(noun_candidates(F.col("word"))).alias("rule", "lemma"))
    known = words.select(F.col("word").alias("lemma"))
    best = F.min(F.struct(F.length("lemma").alias("n"), "rule", "lemma"))
    return (
        forms.join(known, "lemma")
        .groupBy("word")
        .agg(best.alias("best"))
        .select("word", F.col("best.lemma").alias("lemma"))
    )


def with_lexicon(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Nouns and adjectives of ``lexicon(token, tag, lemma)``, with their lemma."""
    tagged = lexicon.filter(F.col("tag").rlike("^(NN|JJ)")).select(
        F.col("token").alias("word"),
        F.col("lemma").alias("_lemma"),
        tag_class(F.col("tag")).alias("word_class"),
    )
    return words.join(tagged, "word").withColumn("lemma", F.coalesce("_lemma", "word")).drop("_lemma")


#: Letters of the longest ending that tags are learned for.
LONGEST_SUFFIX = 5


def suffix_tags(lexicon: DataFrame, longest: int = LONGEST_SUFFIX) -> DataFrame:
    """(suffix, tag, n, total): the most frequent tag of the lexicon's tokens that end in
    the suffix, the least of several, and its share. As large as the lexicon."""
    ends = F.transform(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(longest))), lambda n: F.right("token", n))
    known = lexicon.filter("token <> '' AND tag IS NOT NULL").select("token", "tag").distinct()
    counted = known.select("tag", F.explode(ends).alias("suffix")).groupBy("suffix", "tag").agg(F.count("*").alias("n"))
    best = F.min_by("tag", F.struct(-F.col("n"), "tag"))
    return counted.groupBy("suffix").agg(best.alias("tag"), F.max("n").alias("n"), F.sum("n").alias("total"))


def tag_words(words: DataFrame, lexicon: DataFrame, longest: int = LONGEST_SUFFIX) -> DataFrame:
    """``words`` (word, ..) with ``tag`` and ``by``: every word has a tag.

    A word of the lexicon has its (least) tag, ``by`` is "lexicon"; any other has the tag
    that the longest of its endings mostly has there, ``by`` is that ending; a word whose
    last letter ends no token of the lexicon has the tag "none" and no ``by``. Meant for
    distinct words: each is joined once per ending.
    """
    known = lexicon.filter("token <> ''").groupBy(F.col("token").alias("word")).agg(F.min("tag").alias("_tag"))
    rows = words.join(known, "word", "left")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest))), lambda n: F.right("word", n))
    open_ = rows.filter("_tag IS NULL AND word <> ''").select("word").distinct()
    learned = (
        open_.select("word", F.explode(ends).alias("suffix"))
        .join(suffix_tags(lexicon, longest).select("suffix", "tag"), "suffix")
        .groupBy("word")
        .agg(F.max_by(F.struct("tag", "suffix"), F.length("suffix")).alias("_learned"))
    )
    return rows.join(learned, "word", "left").select(
        *words.columns,
        F.coalesce("_tag", "_learned.tag", F.lit("none")).alias("tag"),
        F.when(F.col("_tag").isNotNull(), "lexicon").otherwise(F.col("_learned.suffix")).alias("by"),
    )


def keyword_counts(
    df: DataFrame,
    column: str = "title",
    order: str = "ord",
    stop_words: Sequence[str] = tuple(STOP_WORDS),
    lexicon: DataFrame | None = None,
    lemmas: bool = True,
) -> DataFrame:
    """All keywords: word, freq, first_seen.

    With a lexicon its tags filter and its lemmas apply; without one there is
    no part-of-speech filter and plurals fold by suffix rules.
    """
    words = vocabulary(df, column, order)
    if lexicon is None and lemmas:
        # Used three times below; one line per distinct word.
        words = durable(words, "vocabulary")
    if lexicon is not None:
        found = with_lexicon(words.filter(is_keyword(F.col("word"), stop_words)), lexicon)
    elif lemmas:
        found = (
            words.filter(is_keyword(F.col("word"), stop_words))
            .join(noun_lemmas(words), "word", "left")
            .withColumn("lemma", F.coalesce("lemma", "word"))
        )
    else:
        found = words.withColumn("lemma", F.col("word"))
    return (
        found.filter(is_keyword(F.col("lemma"), stop_words) & F.col("lemma").rlike("^[a-z]+$"))
        .groupBy(F.col("lemma").alias("word"))
        .agg(F.sum("freq").alias("freq"), F.min("first_seen").alias("first_seen"))
    )


def top_keywords(
    df: DataFrame, column: str = "title", order: str = "ord", n: int = 30, **options
) -> DataFrame:
    """The ``n`` most frequent keywords: rank, word, freq; ties by first use."""
    best = [F.desc("freq"), F.asc("first_seen")]
    top = keyword_counts(df, column, order, **options).orderBy(*best).limit(n)
    # One partition of at most n rows.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*best)))
    return ranked.select("rank", "word", "freq")
