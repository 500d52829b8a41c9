"""Text expressions: title normalisation and keyword tokens. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English stop words of the common public list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Fixed values: (suffix, replacement) rules for English noun plurals.
NOUN_SUFFIXES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]


def normalise_title(c: Column) -> Column:
    """Lower case, every run of non-word characters one blank; null gives ''."""
    blanked = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")
    return F.coalesce(F.trim(blanked), F.lit(""))


def clean_text(c: Column) -> Column:
    """Lower case, keep letters a-z, digits, hyphen and apostrophe."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9'\-]+", " ")


def word_tokens(c: Column) -> Column:
    """English word tokens as an array; null or blank text gives no tokens.

    Clitics (n't, 's, 'll, ...) and outer quotes are cut off the word, fused
    pairs such as "cannot" are split, hyphen compounds stay whole.
    """
    t = F.regexp_replace(clean_text(c), "--+", " ")
    t = F.regexp_replace(t, r"\b(can)(not)\b|\b(gim|lem)(me)\b", "$1$3 $2$4")
    t = F.regexp_replace(t, r"\b(gon|wan)(na)\b|\b(got)(ta)\b", "$1$3 $2$4")
    t = F.regexp_replace(t, r"'t(is|was)\b", " $1")
    t = F.regexp_replace(t, r"n't\b|'(s|m|d|ll|re|ve)\b", " ")
    t = F.regexp_replace(t, r"(^|\s)'+|'+(\s|$)", " ")
    words = F.filter(F.split(t, " +"), lambda w: w != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def tag_class(tag: Column) -> Column:
    """Treebank tag to the word class used for lemmas; noun by default."""
    head = F.substring(tag, 1, 1)
    return (
        F.when(head == "J", "a").when(head == "V", "v").when(head == "R", "r").otherwise("n")
    )


def noun_candidates(word: Column) -> Column:
    """Possible singular forms of ``word``, in rule order."""
    return F.array_compact(
        F.array(
            *[
                F.when(word.endswith(end), F.regexp_replace(word, f"{end}$", repl))
                for end, repl in NOUN_SUFFIXES
            ]
        )
    )
