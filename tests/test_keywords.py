from collections import Counter

from pyspark.sql import functions as F

from litsieve.functions.text import STOP_WORDS, tag_class, word_tokens
from litsieve.operators import keywords as K

ROWS = [
    (2, "Designs and the design of buses: data-driven methods"),
    (1, "The designer's bus didn't stop -- 'quoted' methods cannot fail in 2024"),
    (3, None),
    (4, "Boxes, box; stories story ... women woman"),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "ord long, title string").repartition(3)


def test_tokens(spark):
    df = spark.createDataFrame([("It's the designer's data-driven 'end' -- cannot gonna",), (None,)], "t string")
    got = [r.w for r in df.select(word_tokens(F.col("t")).alias("w")).collect()]
    assert got == [["it", "the", "designer", "data-driven", "end", "can", "not", "gon", "na"], []]


def test_counts_follow_a_plain_model(spark):
    got = {r.word: r.freq for r in K.keyword_counts(frame(spark), lemmas=False).collect()}
    want = Counter()
    for _, t in ROWS:
        for w in (t or "").lower().replace("'s", " ").replace("n't", " ").replace("'", " ").replace(":", " ") \
                .replace(",", " ").replace(";", " ").replace("cannot", "can not").split():
            if w.isalpha() and len(w) > 2 and w not in STOP_WORDS:
                want[w] += 1
    assert got == dict(want)


def test_lemmas_need_the_singular_in_the_corpus(spark):
    got = {r.word: r.freq for r in K.keyword_counts(frame(spark)).collect()}
    assert got["design"] == 2 and got["bus"] == 2 and got["box"] == 2 and got["story"] == 2
    assert got["methods"] == 2 and got["woman"] == 2 and "buses" not in got


def test_ties_by_first_appearance_and_rank(spark):
    df = spark.createDataFrame([(2, "zeta alpha"), (1, "mid zeta"), (3, "alpha mid")], "ord long, title string")
    got = [(r["rank"], r.word, r.freq) for r in K.top_keywords(df, n=2).collect()]
    assert got == [(1, "mid", 2), (2, "zeta", 2)]
    named = df.withColumn("ord", F.concat(F.lit("k"), "ord"))
    assert [r.word for r in K.top_keywords(named, n=3).collect()] == ["mid", "zeta", "alpha"]


def test_lexicon_keeps_nouns_and_adjectives(spark):
    lexicon = spark.createDataFrame(
        [("designs", "NNS", "design"), ("methods", "NNS", "method"), ("fail", "VB", "fail"), ("quoted", "JJ", None)],
        "token string, tag string, lemma string",
    )
    got = {r.word: r.freq for r in K.keyword_counts(frame(spark), lexicon=lexicon).collect()}
    assert got == {"design": 1, "method": 2, "quoted": 1}


def test_tag_class_and_empty(spark):
    df = spark.createDataFrame([("JJR",), ("VBD",), ("NNS",), ("RB",), ("XX",)], "t string")
    assert [r.c for r in df.select(tag_class(F.col("t")).alias("c")).collect()] == ["a", "v", "n", "r", "n"]
    assert K.top_keywords(frame(spark).filter("false")).count() == 0


def test_every_word_gets_a_tag(spark):
    lexicon = [("running", "VBG"), ("eating", "VBG"), ("king", "NN"), ("ring", "NN"), ("thing", "NN"), ("red", "JJ"), ("red", "NN"), (None, "X"), ("", "Y"), ("zed", None)]
    words = ["running", "going", "bring", "red", "bed", "xyz", "g", "", None, "being"]
    lex = spark.createDataFrame([(t, g, t) for t, g in lexicon], "token string, tag string, lemma string")
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n int")
    got = {r.n: (r.tag, r.by) for r in K.tag_words(rows, lex).collect()}

    def brute(word):
        known = [g for t, g in lexicon if t and t == word and g]
        if known:
            return min(known), "lexicon"
        for n in range(min(5, len(word or "")), 0, -1):
            tags = Counter(g for t, g in set(lexicon) if t and g and t.endswith(word[-n:]) and len(t) >= n)
            if tags:
                return min(tags, key=lambda g: (-tags[g], g)), word[-n:]
        return "none", None

    assert got == {i: brute(w) for i, w in enumerate(words)}
