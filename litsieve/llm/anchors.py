"""Where equal windows can meet: content-defined anchors.

To find windows of ``length`` values (bytes or words) that occur more than once,
each window gets the least hash of its ``gram``-value parts as its anchor. Equal
windows have equal anchors, wherever they stand. Successive windows of a text with
one anchor form a segment [lo, hi + length), about one per (length - gram) / 2
values, so the anchors of a corpus are a small table. Only segments whose anchor
occurs twice or more can hold a repeated window; only those are looked at again.

Segments that are equal as a whole are told apart from the others by a digest.
Copies of a segment need no comparison (all their windows repeat, and the first
copy has each of them first); an anchor with several different segments is
``contested`` and its distinct segments, once each, must be compared by content; so
must a segment in which its own anchor comes again.

Here ``doc_id`` is the number that ``keyed`` gives each row, so rows that share an id, or
have none, stay apart; the ids come back at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from litsieve.llm.common import Words, chunks, powers, prefix_hash, run_hash, small_batches, span_hash
from litsieve.session import durable

#: An anchor with more distinct segments is told apart by more than itself.
HOT_KINDS = 500
#: A name with more segments than this is dealt to several shards.
SPLIT_KINDS = 3000
SEGMENTS = "anchor long, digest long, doc_id long, lo int, hi int, again int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` successive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(grams: np.ndarray, valid: np.ndarray, owner: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, again) of maximal runs of windows.

    ``valid``: which windows lie in one text; ``owner``: each window's text. ``again``
    is 1 where a run goes on after its anchor has left the window: it has the anchor
    twice, as in text of a short period, and may hold a window twice.
    """
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    low = sliding_min(grams, w)
    at = np.flatnonzero(valid)
    new = np.ones(len(at), bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = at[new]
    last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1:])
    on = ~new & (grams[np.maximum(at - 1, 0)] == low[at])
    again = np.maximum.reduceat(on.astype(np.int32), np.flatnonzero(new))
    return low[first], first, last, again


def byte_segments(part: list[bytes], length: int, gram: int):
    """anchor, digest, text, lo, hi of all segments of bytes."""
    data = np.frombuffer(b"".join(part), np.uint8)
    ends = np.cumsum([len(t) for t in part])
    n = len(data) - length + 1
    if n <= 0:
        return None
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    owner = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
    anchor, first, last, again = runs(grams, owner[:n] == owner[length - 1 :], owner, length - gram + 1)
    text = owner[first]
    base = ends[text] - np.array([len(t) for t in part])[text]
    return anchor, span_hash(prefix, first, last + length), text, first - base, last - base, again


def word_segments(part: list[bytes], length: int, gram: int):
    """The same for words; lo and hi count words."""
    w = Words(part)
    if len(w.doc) < length:
        return None
    h = w.hashes()
    anchor, first, last, again = runs(run_hash(h, gram), w.whole(length), w.doc, length - gram + 1)
    # A hash over the words' hashes, not over the bytes: white space between words is no content.
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h) + 1)[0][:-1], dtype=np.uint64)])
    digest = span_hash(prefix, first, last + length)
    text = w.doc[first]
    return anchor, digest, text, first - w.first[text], last - w.first[text], again


@dataclass(frozen=True)
class Repeats:
    """Tables about anchors that occur twice or more.

    copies: doc_id, lo, hi of segments of which an equal one stands earlier.
    firsts: anchor, digest, doc_id, lo, hi, n, kinds of the first of each distinct segment,
    for contested anchors only; n counts equal segments, kinds the anchor's distinct ones.
    repeated: the first of each segment that has copies: doc_id, lo, hi.
    """

    copies: DataFrame
    firsts: DataFrame
    repeated: DataFrame


def repeats(docs: DataFrame, cut: Callable, length: int, gram: int) -> Repeats:
    """``cut`` is ``byte_segments`` or ``word_segments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for at, part in chunks(texts):
                found = cut(part, length, gram)
                if found is None:
                    continue
                anchor, digest, text, lo, hi, again = found
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)),
                        pa.array(ids[at + text], pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                        pa.array(again, pa.int32()),
                    ],
                    ["anchor", "digest", "doc_id", "lo", "hi", "again"],
                )

    segments = small_batches(docs.select("doc_id", "text")).mapInArrow(run, SEGMENTS)
    # Written on its own, so that the join below has two plain sides, of which the
    # engine can split a hot one.
    twice = durable(
        segments.groupBy("anchor").agg(F.sum(1 + F.col("again")).alias("n")).filter("n > 1").select("anchor"), "anchors"
    )
    held = durable(segments.join(twice, "anchor", "left_semi"), "segments")
    place = F.struct("doc_id", "lo", "hi")
    distinct = held.groupBy("anchor", "digest").agg(
        F.min(place).alias("at"), F.count("*").alias("n"), F.max("again").alias("again")
    )
    distinct = durable(distinct.select("anchor", "digest", "at.doc_id", "at.lo", "at.hi", "n", "again"), "distinct")
    contested = distinct.groupBy("anchor").agg(F.sum(1 + F.col("again")).alias("kinds")).filter("kinds > 1")
    several = distinct.filter("n > 1").select(
        "anchor", "digest", F.col("doc_id").alias("first_doc"), F.col("lo").alias("first_lo")
    )
    copies = held.join(several, ["anchor", "digest"]).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("lo") == F.col("first_lo")))
    )
    return Repeats(
        copies.select("doc_id", "lo", "hi"),
        distinct.join(durable(contested, "contested"), "anchor"),
        distinct.filter("n > 1").select("doc_id", "lo", "hi"),
    )


def refined(segment: dict, grams: np.ndarray, units: Sequence, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, name) of a segment's parts by what stands beside the anchor.

    A window reaches at least half of its other values to the left or to the right of
    its first anchor; equal windows do so alike. Its part is named by the anchor and
    that half, so windows meet only where they share more than half their length.
    """
    lo, hi, half = segment["lo"], segment["hi"], (length - gram) // 2
    anchor = np.array([segment["anchor"]], np.int64).view(np.uint64)[0]
    before = lo - 1
    for a in (lo + np.flatnonzero(grams[lo : hi + length - gram + 1] == anchor)).tolist():
        first, last = before + 1, min(a, hi)
        before = a
        for p, q, beside in (
            (first, min(last, a - half), units[a - half : a + gram] if a >= half else None),
            (max(first, a - half + 1), last, units[a : a + gram + half]),
        ):
            if p <= q:
                yield p, q, name_of(beside)


def name_of(units: Sequence) -> int:
    data = units if isinstance(units, bytes) else b" ".join(units)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def with_content(
    firsts: DataFrame, docs: DataFrame, length: int, gram: int, of_words: bool, hot_kinds: int = HOT_KINDS
) -> DataFrame:
    """``firsts`` with ``content``: the bytes, or the words joined by blanks.

    A document's segments are brought together first (as many as its length
    allows), so its text travels once. Segments of an anchor with more than
    ``hot_kinds`` distinct ones are cut into parts with finer names (see ``refined``).
    Rows without content are later copies of a part in the same segment.
    """
    per_doc = firsts.groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "digest", "lo", "hi", "n", "kinds")).alias("segments")
    )
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(per_doc, F.col("doc_id") == F.col("_id"))

    def of_text(doc_id: int, text: bytes, segments: list[dict]) -> Iterator[dict]:
        units = text.split() if of_words else text
        grams = None
        for s in segments:
            if s["kinds"] <= hot_kinds:
                cut = units[s["lo"] : s["hi"] + length]
                yield s | {"doc_id": doc_id, "content": b" ".join(cut) if of_words else cut}
                continue
            if grams is None:
                grams = grams_of(text, gram, of_words)
            parts: dict[tuple[int, bytes], dict] = {}
            for lo, hi, name in refined(s, grams, units, length, gram):
                cut = units[lo : hi + length]
                cut = b" ".join(cut) if of_words else cut
                row = s | {"doc_id": doc_id, "anchor": name, "digest": name_of(cut), "lo": lo, "hi": hi, "content": cut}
                known = parts.setdefault((name, cut), row)
                if known is not row:
                    known["n"] += 1
                    yield row | {"content": None}
            yield from parts.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "segments")), strict=True):
                found = list(of_text(row[0], (row[1] or "").encode("utf-8", "surrogatepass"), row[2]))
                yield pa.RecordBatch.from_pylist(found, schema=CONTENT)

    out = small_batches(rows.select("doc_id", "text", "segments"), 128).mapInArrow(
        run, "anchor long, digest long, doc_id long, lo int, hi int, n long, content binary"
    )
    return durable(out, "content")


def grams_of(text: bytes, gram: int, of_words: bool) -> np.ndarray:
    """Hashes of all grams of one text, as ``repeats`` has them."""
    if of_words:
        return run_hash(Words([text]).hashes(), gram)
    data = np.frombuffer(text, np.uint8)
    at = np.arange(max(0, len(data) - gram + 1))
    return span_hash(prefix_hash(data), at, at + gram)


CONTENT = pa.schema(
    [
        ("anchor", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()),
        ("hi", pa.int32()), ("n", pa.int64()), ("content", pa.binary()),
    ]
)


def shards(segments: DataFrame) -> DataFrame:
    """Segments dealt to tasks by (anchor, salt), which come together there.

    A name with more than ``SPLIT_KINDS`` segments is salted over as many tasks as it
    has times that many; its rows are marked ``edge``, as only they can have equals in
    another task."""
    rows = segments.filter("content IS NOT NULL")
    large = durable(
        rows.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > SPLIT_KINDS), "large"
    )
    salts = F.coalesce(F.ceil(F.col("_n") / SPLIT_KINDS), F.lit(1))
    dealt = rows.join(large, "anchor", "left").select(
        *rows.columns,
        F.pmod(F.xxhash64("digest"), salts).cast("int").alias("salt"),
        F.col("_n").isNotNull().alias("edge"),
    )
    return dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of stretches [start, end), ascending."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def keyed(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """A written table of doc_id, the row's own number; id, the table's doc_id; and text.

    Rows with null or repeated ids have numbers of their own. ``ordered``: by id (null
    first), then by a digest of the text; only equal rows have no order of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if ordered:
        # The last column only spreads equal rows.
        place = ["id", "_digest", "_n"]
        rows = rows.withColumns({"_digest": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
        rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    return durable(rows.select(F.monotonically_increasing_id().alias("doc_id"), "id", "text"), "rows")


def batches_of(segments: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict[str, Sequence]]:
    """A task's segments as columns, in shards of about ``limit`` bytes of content. Rows
    of one (anchor, salt), SPLIT_KINDS or so at most, stay together."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in segments:
        keys = list(zip(b.column("anchor").to_pylist(), b.column("salt").to_pylist(), strict=True))
        sizes = pc.binary_length(b.column("content")).to_pylist()
        start = 0
        for i, key in enumerate(keys):
            if size >= limit and key != last:
                held.append(b.slice(start, i - start))
                yield _columns(held)
                held, size, start = [], 0, i
            size += sizes[i]
            last = key
        held.append(b.slice(start))
    if size:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> dict[str, Sequence]:
    t = pa.Table.from_batches(parts)
    return {c: t.column(c).to_pylist() if c == "content" else t.column(c).to_numpy() for c in t.column_names}


def apply_covers(docs: DataFrame, covers: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Per row of ``keyed`` its id as doc_id and ``each(text, stretches)``, where ``covers``
    has doc_id, lo, hi of runs of windows. A row has at most as many runs as its length
    allows."""
    per_doc = covers.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(per_doc.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, spans in zip(
                b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True
            ):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out.append({"doc_id": doc_id} | each(raw, [(s["lo"], s["hi"]) for s in spans or []]))
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    arrow_schema = to_arrow_schema(docs.sparkSession.createDataFrame([], f"doc_id long, {schema}").schema)
    return small_batches(rows.select("id", "text", "spans"), 128).mapInArrow(run, f"doc_id long, {schema}")
