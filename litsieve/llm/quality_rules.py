"""Quality rules as a short-circuit cascade.

``measure`` counts what every document needs. On top of it, ``cascade`` evaluates
rules that can each reject a document; a document that one rule has rejected is
not shown to the later ones. The order comes from a bounded sample: each rule's
seconds a character and share of rejections are measured there, and the rules with
the most rejections per second go first. The order changes the work, never the
verdict: a document is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.llm.common import Words, chunks, cover, mixed, read, run_hash, small_batches

WINDOW = 8
BLANKS = " \t\n\r\x0b\x0c"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF5)]] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[range(0x41, 0x5B)] = 1
_START = np.ones(256, np.int64)
_START[0x80:0xC0] = 0

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def per_text(w: Words, table: np.ndarray) -> np.ndarray:
    """Sum of ``table`` over each text's bytes."""
    return np.add.reduceat(table[w.data], w.at[:-1])


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def repeated_words(w: Words, k: int = WINDOW) -> np.ndarray:
    """Words in windows of ``k`` that the same text has twice or more."""
    keys = run_hash(w.hashes(), k)
    at = np.flatnonzero(w.whole(k))
    keys = keys[at] ^ mixed(w.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = cover(len(w.doc), at[twice], at[twice] + k)
    return np.bincount(w.doc[covered], minlength=len(w.n))


def measured(texts: Sequence[str | None]) -> pd.DataFrame:
    out = []
    for at, part in chunks(texts):
        w = Words(part)
        lengths = np.concatenate([[0], np.cumsum(_START[w.data])])
        word_chars = np.bincount(w.doc, lengths[w.end] - lengths[w.start], minlength=len(part))
        out.append(
            pd.DataFrame(
                {
                    "n_words": w.n,
                    "word_chars": word_chars.astype(np.int64),
                    "n_symbols": per_text(w, _SYMBOL),
                    "n_dup_lines": [duplicate_lines(texts[at + i] or "") for i in range(len(part))],
                    "n_repeat_words": repeated_words(w),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets texts and their measures and says which texts fail."""

    name: str
    rejects: Callable[[list[str], pd.DataFrame], np.ndarray]


def _each(texts: list[str], f: Callable[[Words], np.ndarray]) -> np.ndarray:
    return np.concatenate([f(Words(part)) for _, part in chunks(texts)])


def _capitals(texts: list[str], m: pd.DataFrame) -> np.ndarray:
    return 2 * _each(texts, lambda w: per_text(w, _CAPITAL)) > _each(texts, lambda w: per_text(w, _LETTER))


def _wordless(texts: list[str], m: pd.DataFrame) -> np.ndarray:
    def lettered(w: Words) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
        return np.bincount(w.doc, sums[w.end] > sums[w.start], minlength=len(w.n)).astype(np.int64)

    return 2 * _each(texts, lettered) < m["n_words"].to_numpy()


def _stuttering(texts: list[str], m: pd.DataFrame) -> np.ndarray:
    """More than 3 of 10 words equal the word before."""

    def again(w: Words) -> np.ndarray:
        h = w.hashes()
        return np.bincount(w.doc[1:], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]), minlength=len(w.n)).astype(np.int64)

    return 10 * _each(texts, again) > 3 * m["n_words"].to_numpy()


def _marks(texts: list[str], m: pd.DataFrame) -> np.ndarray:
    return np.array([2 * (t.count("!") + t.count("?")) for t in texts], np.int64) > m["n_words"].to_numpy()


RULES = (
    Rule("symbols", lambda t, m: (10 * m["n_symbols"] > 3 * m["n_words"]).to_numpy()),
    Rule("duplicate lines", lambda t, m: (m["n_dup_lines"] * 100 > 50 * np.array([x.count("\n") + 1 for x in t])).to_numpy()),
    Rule("word length", lambda t, m: ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])).to_numpy()),
    Rule("capitals", _capitals),
    Rule("marks", _marks),
    Rule("few letters", _wordless),
    Rule("stutter", _stuttering),
)


def cascade(texts: list[str], m: pd.DataFrame, rules: Sequence[Rule]) -> np.ndarray:
    """Index of the first rule, in the order given, that rejects each text; else -1."""
    first = np.full(len(texts), -1)
    left = np.arange(len(texts))
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = np.asarray(rule.rejects([texts[i] for i in left], m.iloc[left].reset_index(drop=True)), bool)
        first[left[bad]] = k
        left = left[~bad]
    return first


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """Rules by rejections per second, as measured on ``sample_rows`` documents at
    most (those with the smallest digests of their ids). One line per rule and task
    comes to the driver."""

    def trial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x or "" for x in batch["text"]]
            m = measured(texts)
            rows = []
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                bad = int(np.sum(rule.rejects(texts, m)))
                rows.append((k, time.perf_counter() - began, bad))
            yield pd.DataFrame(rows, columns=["rule", "s", "bad"])

    chosen = docs.select(F.xxhash64("doc_id").alias("_draw")).orderBy("_draw").limit(sample_rows).distinct()
    drawn = docs.select(F.xxhash64("doc_id").alias("_draw"), "text")
    # An id may stand in any number of rows.
    sample = drawn.join(F.broadcast(chosen), "_draw", "left_semi").select("text").limit(sample_rows)
    found = (
        small_batches(sample).mapInPandas(trial, "rule int, s double, bad long")
        .groupBy("rule").agg(F.sum("s").alias("s"), F.sum("bad").alias("bad")).collect()
    )
    worth = {r["rule"]: r["bad"] / (r["s"] + 1e-9) for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth.get(k, 0.0))]


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and ``failed_rule`` (the first in this
    run's order; null where kept or where the base rules failed).

    Null texts are empty and fail the base rules. Repeated rows are judged each on
    their own; an empty table gives an empty result; other columns are ignored.
    """
    chosen = list(order or cascade_order(docs, rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [x or "" for x in batch.column("text").to_pylist()]
            m = measured(texts)
            bad = ((m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])).to_numpy()
            ok = np.flatnonzero(~bad)
            first = np.full(len(texts), -1)
            first[ok] = cascade([texts[i] for i in ok], m.iloc[ok].reset_index(drop=True), chosen)
            failed = [chosen[k].name if k >= 0 else None for k in first]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(m[c].to_numpy(np.int64)) for c in m.columns),
                    pa.array(bad), pa.array(~bad & (first < 0)), pa.array(failed, pa.string()),
                ],
                ["doc_id", *m.columns, "base_failed", "kept", "failed_rule"],
            )

    schema = f"doc_id long, {MEASURES}, base_failed boolean, kept boolean, failed_rule string"
    return small_batches(docs.select("doc_id", "text")).mapInArrow(judge, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; without the rule's name, which depends on the measured order."""
    return apply_rules(read(spark, sf_dir, "documents")).drop("failed_rule")


SQL = r"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words FROM documents),
    spots AS (SELECT doc_id, unnest(range(len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
    win AS (SELECT doc_id, i, list_aggregate(words[i + 1 : i + 8], 'string_agg', ' ') AS g FROM spots),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
    dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines
            WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY 1),
    m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
                 (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                 coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
                 length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
                 length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{10FFFF}]', '', 'g')) AS letters,
                 length(text) - length(translate(text, '!?', '')) AS marks,
                 len([x FOR x IN words IF regexp_matches(x, '[A-Za-z\x{00C0}-\x{10FFFF}]')]) AS lettered,
                 len([1 FOR i IN range(2, len(words) + 1) IF words[i] = words[i - 1]]) AS again
          FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR n_dup_lines * 100 > 50 * n_lines
               OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * capitals > letters
               OR 2 * marks > n_words OR 2 * lettered < n_words OR 10 * again > 3 * n_words) AS kept FROM b"""
