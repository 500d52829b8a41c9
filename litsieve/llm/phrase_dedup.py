"""Substring dedup with repeated-phrase automata.

A word is removed when a window of ``length`` words that covers it also stands
earlier (a smaller doc_id, or earlier in the same document; see ``anchors.keyed``). Segments meet through
their anchors (see ``anchors``). In shards of bounded size

* recurring passages are confirmed: windows whose digest the shard has twice, or
  that another shard may have (of an anchor that is dealt to several);
* an Aho-Corasick automaton is compiled from them, over word numbers, so that a match
  is one of whole words and exact;
* the segments are streamed through it, which locates every occurrence; all but the
  earliest are removed.

Equal segments are streamed once: of their copies all but the first are removed.
Where an anchor spreads over several shards, the shards' earliest places are
compared by an aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.llm import anchors as A
from litsieve.llm.common import mixed, read, run_hash, small_batches
from litsieve.session import durable

LENGTH = 20
GRAM = 4
#: Bytes of content in a shard.
SHARD_BYTES = 400_000


def occurrences(segments: list[list[str]], length: int, edge: np.ndarray) -> dict[tuple[int, ...], list[tuple[int, int]]]:
    """For windows that recur, or stand in an ``edge`` segment: all (segment, offset)."""
    numbers: dict[str, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words in segments]
    flat = np.concatenate([np.array(c, np.int64) for c in coded])
    owner = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    windows = run_hash(mixed(flat.astype(np.uint64)), length)
    at = np.flatnonzero(owner[: len(windows)] == owner[length - 1 :])
    _, which, count = np.unique(windows[at], return_inverse=True, return_counts=True)
    confirmed = at[(count[which] > 1) | edge[owner[at]]]
    base = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    passages = set()
    for p in confirmed:
        o = int(p - base[owner[p]])
        passages.add(tuple(coded[owner[p]][o : o + length]))
    for passage in passages:
        automaton.add_word(passage, passage)
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    if passages:
        automaton.make_automaton()
        for s, words in enumerate(coded):
            for end, passage in automaton.iter(tuple(words)):
                found.setdefault(passage, []).append((s, end - length + 1))
    return found


def word_digest(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


FOUND = "doc_id long, lo int, hi int, digest long"


def _in_shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in A.batches_of(batches, shard_bytes):
            doc, lo = shard["doc_id"].tolist(), shard["lo"].tolist()
            segments = [c.decode("utf-8", "surrogatepass").split(" ") for c in shard["content"]]
            edge = shard["edge"]
            later, first = [], []
            for places in occurrences(segments, length, edge).values():
                order = sorted((doc[s], lo[s] + o, s, o) for s, o in places)
                later += [(d, p, p, None) for d, p, _, _ in order[1:]]
                if any(edge[s] for s, _ in places):
                    d, p, s, o = order[0]
                    first.append((d, p, p, word_digest(segments[s][o : o + length])))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "lo", "hi", "digest"), r, strict=True)) for r in later + first], schema=ARROW
            )

    return run


ARROW = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("digest", pa.int64())])


def later_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_kinds: int = A.HOT_KINDS) -> DataFrame:
    """doc_id, lo, hi: runs of first words of windows that also stand earlier."""
    found = A.repeats(docs, A.word_segments, length, gram)
    content = A.with_content(found.firsts, docs, length, gram, of_words=True, hot_kinds=hot_kinds)
    inside = durable(small_batches(A.shards(content), 2000).mapInArrow(_in_shards(length, shard_bytes), FOUND), "shards")
    firsts = inside.filter("digest IS NOT NULL")
    place = F.struct("doc_id", "lo")
    # A row per shard and window; the least place of each digest stays.
    least = firsts.groupBy("digest").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1")
    across = firsts.join(least, "digest").filter(place != F.col("least"))
    return (
        inside.filter("digest IS NULL").select("doc_id", "lo", "hi")
        .unionByName(across.select("doc_id", "lo", "hi"))
        .unionByName(content.filter("content IS NULL").select("doc_id", "lo", "hi"))
        .unionByName(found.copies)
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_kinds: int = A.HOT_KINDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (first and end word of what is cut).

    Null texts have no words; documents with fewer than ``length`` words keep all.
    Rows that share a doc_id, or have none, are documents of their own: null ids come
    before all others, rows of one id stand in the order of a digest of their texts.
    Empty tables give an empty result; other columns are ignored.
    """

    def each(text: bytes, runs: list[tuple[int, int]]) -> dict:
        words = text.split()
        spans = A.merged_spans([(lo, min(hi + length, len(words))) for lo, hi in runs if lo < len(words)])
        kept, at = [], 0
        for a, b in spans:
            kept += words[at:a]
            at = b
        kept += words[at:]
        return {
            "n_words": len(words), "n_removed": len(words) - len(kept),
            "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
            "spans": [{"start": a, "end": b} for a, b in spans],
        }

    rows = A.keyed(docs, ordered=True)
    return A.apply_covers(
        rows, later_windows(rows, length, gram, shard_bytes, hot_kinds), each,
        "n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>",
    )


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")
