"""Substring dedup with suffix arrays.

A byte is removed when a string of ``length`` bytes that covers it also starts
somewhere else. Documents meet through their anchors (see ``anchors``); segments
whose anchor is contested go to shards of bounded size, in which

* the suffix array is built by Larsson-Sadakane refinement: suffixes are ranked by
  their first 7 bytes, then groups of equal rank, and only those, are sorted by the
  rank of the suffix 7, 14, 28 ... bytes on;
* common prefixes follow Kasai: a suffix's prefix with its neighbour is that of the
  suffix one byte before, less one, unless their preceding bytes differ; only there
  are bytes compared;
* strings that stand in one shard twice are found from the prefixes.

An anchor that fills more than one shard is merged across shards: each shard gives
its strings' fingerprints once, they meet in sorted order, and binary search counts
how often each occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from litsieve.llm import anchors as A
from litsieve.llm.common import prefix_hash, read, small_batches, span_hash
from litsieve.session import durable

LENGTH = 200
GRAM = 32
#: Bytes of content in a shard.
SHARD_BYTES = 1_500_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``; where one ends, it sorts before longer ones."""
    n = len(text)
    # Seven bytes to a key, 9 bits each, so that the end is below every byte.
    values = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    first = np.zeros(n, np.uint64)
    for k in range(7):
        first = (first << np.uint64(9)) | values[k : k + n]
    order = np.argsort(first)
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = starts[group]
    left = np.flatnonzero(np.diff(np.append(starts, n))[group] > 1)
    depth = 7
    while len(left):
        suffix = order[left]
        ahead = suffix + depth
        later = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + later
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[left] = suffix
        new = np.ones(len(left), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        rank[suffix] = left[new][group]
        left = left[np.bincount(group)[group] > 1]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    fresh = np.ones(n, bool)
    inner = np.flatnonzero((i > 0) & (before > 0))
    fresh[inner] = text[inner - 1] != text[before[inner] - 1]
    at = np.flatnonzero(fresh & (before >= 0))
    other = before[at]
    bound = n - np.maximum(at, other)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    # Eight bytes at a time, by those that are still equal.
    found = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x = words[at[live] + found[live]] ^ words[other[live] + found[live]]
        apart = x != 0
        low = x[apart] & (~x[apart] + np.uint64(1))
        found[live[apart]] += np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~apart]
        found[live] += 8
        live = live[found[live] < bound[live]]
    # Kasai: what is known one byte earlier, less one.
    reach = np.where(fresh, i, 0)
    reach[at] += np.minimum(found, bound)
    length = np.maximum(np.maximum.accumulate(reach) - i, 0)
    length[before < 0] = 0
    return length[order]


def shard_repeats(shard: dict, length: int):
    """(segment, offset) of strings of ``length`` bytes that the shard has twice or more,
    in ascending order, and (segment, offset, fingerprint) of one of each string that
    another shard may have."""
    sizes = np.array([len(c) + 1 for c in shard["content"]], np.int64)
    text = np.frombuffer(b"\xff".join(shard["content"]) + b"\xff", np.uint8)
    at = np.cumsum(sizes) - sizes
    segment = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(text)) - at[segment]
    starts = offset <= (sizes - 1 - length)[segment]
    order = suffix_array(text)
    string = np.empty(len(text), np.int64)
    string[order] = np.cumsum(common_prefixes(text, order) < length)
    count = np.bincount(string[starts], minlength=int(string.max()) + 1)
    twice = np.flatnonzero(starts & (count[string] > 1))
    edge = np.flatnonzero(starts & shard["edge"][segment])
    edge = edge[np.unique(string[edge], return_index=True)[1]]
    prints = span_hash(prefix_hash(text), edge, edge + length)
    return (segment[twice], offset[twice]), (segment[edge], offset[edge], prints)


FOUND = "doc_id long, lo int, hi int, fingerprint long"


def _in_shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in A.batches_of(batches, shard_bytes):
            doc, lo = shard["doc_id"], shard["lo"].astype(np.int64)
            (s, o), (es, eo, prints) = shard_repeats(shard, length)
            # Runs of neighbouring starts of one segment.
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
            last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1) if len(s) else np.zeros(0, np.int64)
            yield _found(doc[s[new]], lo[s[new]] + o[new], lo[s[new]] + o[last], None)
            yield _found(doc[es], lo[es] + eo, lo[es] + eo, prints)

    return run


def _found(doc, lo, hi, prints) -> pa.RecordBatch:
    marks = pa.nulls(len(doc), pa.int64()) if prints is None else pa.array(prints.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), marks],
        ["doc_id", "lo", "hi", "fingerprint"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fingerprint: those whose fingerprint occurs twice or more. The
    last fingerprint of a batch waits for the next one; it has a row per shard at most."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        if not t.num_rows:
            continue
        t = t.to_batches()[0]
        prints = t.column("fingerprint").to_numpy()
        cut = int(np.searchsorted(prints, prints[-1], side="left"))
        held = t.slice(cut)
        yield _more_than_once(t.slice(0, cut), prints[:cut])
    if held is not None:
        yield _more_than_once(held, held.column("fingerprint").to_numpy())


def _more_than_once(b: pa.RecordBatch, prints: np.ndarray) -> pa.RecordBatch:
    n = np.searchsorted(prints, prints, side="right") - np.searchsorted(prints, prints, side="left")
    return b.filter(pa.array(n > 1))


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_kinds: int = A.HOT_KINDS) -> DataFrame:
    """doc_id, lo, hi: runs of first bytes of strings that start elsewhere, too."""
    found = A.repeats(docs, A.byte_segments, length, gram)

    content = A.with_content(found.firsts, docs, length, gram, of_words=False, hot_kinds=hot_kinds)
    inside = durable(small_batches(A.shards(content), 2000).mapInArrow(_in_shards(length, shard_bytes), FOUND), "shards")
    edges = inside.filter("fingerprint IS NOT NULL")
    across = small_batches(
        edges.repartition("fingerprint").sortWithinPartitions("fingerprint"), 5000
    ).mapInArrow(_merge, FOUND)
    spots = inside.filter("fingerprint IS NULL").unionByName(across).select("doc_id", "lo", "hi")
    known = content.filter("content IS NULL OR n > 1").select("doc_id", "lo", "hi")
    return spots.unionByName(known).unionByName(found.copies).unionByName(found.repeated)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_kinds: int = A.HOT_KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes,
    of what is cut).

    Null texts are empty; texts shorter than ``length`` keep all; the first occurrence
    goes like all others. Rows that share a doc_id, or have none, are documents of their
    own. Empty tables give an empty result; other columns are ignored.
    """

    def each(text: bytes, runs: list[tuple[int, int]]) -> dict:
        spans = A.merged_spans([(lo, min(hi + length, len(text))) for lo, hi in runs if lo < len(text)])
        kept, at = [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        left = b"".join([*kept, text[at:]])
        return {
            "n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(spans),
            "kept_sha256": hashlib.sha256(left).hexdigest(),
            "spans": [{"start": a, "end": b} for a, b in spans],
        }

    rows = A.keyed(docs)
    return A.apply_covers(
        rows, repeated_strings(rows, length, gram, shard_bytes, hot_kinds), each,
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>",
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")
