"""Benchmark decontamination by q-gram counting and banded alignment.

Texts are compared in a plain form: ASCII and Latin-1 letters in lower case, every
run of other ASCII characters one blank. Benchmark items are cut into units of at
most ``unit`` bytes that overlap by half; a unit of m bytes may differ from the document
by ``e = rate * m`` edits. Besides, ``PART`` successive words of an item count as they are,
so a verbatim part of an item is found from that many words on. Items whose plain form
has under ``LEAST`` bytes are found where it stands whole and without edits, between blanks.

* q-gram lemma: a region within e edits shares at least ``m - q + 1 - q * e`` q-grams
  with the unit, on diagonals (document position minus unit position) that lie in a
  stretch of e. Shared q-grams are counted in diagonal bands of width 2(e + 1) that
  overlap by half, so every such stretch lies whole in some band.
* Bands with that many are verified by an alignment that is confined to the band
  and may begin and end anywhere in the document.

The benchmark is the stated query set. It is worked off in blocks of bounded size, each
broadcast to the tasks; ``PASS_BLOCKS`` of them meet the documents in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.llm.common import chunks, mixed, prefix_hash, read, small_batches, span_hash

Q = 10
RATE = 0.08
UNIT = 160
#: Shorter plain forms are searched as they are, without edits.
LEAST = 40
#: Successive words of an item that count without edits.
PART = 13
BLOCK_UNITS = 20_000
#: Blocks that a task holds at once.
PASS_BLOCKS = 3
FILTER_BITS = 22
#: Added to diagonals, so that none is negative.
SHIFT = 4 * UNIT

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 0x20
for _a in (*range(0x30, 0x3A), *range(0x61, 0x7B)):
    _PLAIN[_a] = _a
for _a in range(0x41, 0x5B):
    _PLAIN[_a] = _a + 0x20
_PLAIN[0xFF] = 0xFF  # between texts; no byte of UTF-8


def plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain form of UTF-8 bytes, and where each of its bytes came from."""
    out = _PLAIN[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[capital] += 0x20
    blank = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (out[:-1] == 0xFF)))
    at = np.flatnonzero(keep)
    return out[at], at


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit values of all q-grams; q from 8 to 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(eight[q - 8 : q - 8 + n]))


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Block:
    """Units of some items and the places of their q-grams."""

    item: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    text: np.ndarray  # units x longest unit
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each distinct q-gram in unit and place
    unit: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    short: dict[int, tuple[np.ndarray, dict[bytes, list[int]]]]  # by length: sorted hashes, items of each form
    part_hashes: np.ndarray  # sorted, of PART successive words
    parts: dict[bytes, list[int]]

    @staticmethod
    def of(
        units: list[tuple[int, bytes]], rate: float, short: list[tuple[int, bytes]] = (), whole: list[tuple[int, bytes]] = ()
    ) -> Block:
        size = np.array([len(u) for _, u in units], np.int64)
        budget = np.minimum(np.floor(rate * size), (size - Q) // Q).astype(np.int64)
        text = np.zeros((len(units), size.max(initial=0)), np.uint8)
        grams, unit, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (_, u) in enumerate(units):
            text[i, : len(u)] = np.frombuffer(u, np.uint8)
            g = qgrams(text[i, : len(u)])
            grams.append(g)
            unit.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        distinct, first = np.unique(g[order], return_index=True)
        marks = np.zeros(1 << FILTER_BITS, bool)
        marks[slots(distinct)] = True
        return Block(
            np.array([i for i, _ in units]), size, budget, text, distinct, np.append(first, len(g)),
            np.concatenate(unit)[order], np.concatenate(place)[order], marks, _by_length(short), *_parts(whole),
        )


def _parts(whole: list[tuple[int, bytes]]) -> tuple[np.ndarray, dict[bytes, list[int]]]:
    out: dict[bytes, list[int]] = {}
    for item, p in whole:
        words = p.split(b" ")
        for i in range(len(words) - PART + 1):
            items = out.setdefault(b" ".join(words[i : i + PART]), [])
            if item not in items[-1:]:
                items.append(item)
    at = np.cumsum([0, *map(len, out)])
    hashes = span_hash(prefix_hash(np.frombuffer(b"".join(out), np.uint8)), at[:-1], at[1:])
    return np.sort(hashes), out


def _by_length(short: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, dict[bytes, list[int]]]]:
    forms: dict[int, dict[bytes, list[int]]] = {}
    for item, p in short:
        forms.setdefault(len(p), {}).setdefault(p, []).append(item)
    out = {}
    for n, items in forms.items():
        at = np.arange(len(items)) * n
        prefix = prefix_hash(np.frombuffer(b"".join(items), np.uint8))
        out[n] = np.sort(span_hash(prefix, at, at + n)), items
    return out


def plain_form(text: str | None) -> bytes:
    return plain(np.frombuffer((text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8))[0].tobytes().strip()


def units_of(item_id: int, text: str | None, unit: int = UNIT) -> list[tuple[int, bytes]]:
    """The overlapping units of one item; none when it is short."""
    p = plain_form(text)
    if len(p) < LEAST:
        return []
    starts = list(range(0, max(1, len(p) - unit), unit // 2))
    if starts[-1] + unit < len(p):
        starts.append(len(p) - unit)
    return [(item_id, p[s : s + unit]) for s in starts]


def align(block: Block, unit: np.ndarray, low: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each unit and a region on the diagonals from ``low`` on, and
    the region's end. All candidates are aligned at once, row by row of the units."""
    width = int(2 * (block.budget[unit].max() + 1) + 1)
    m = block.size[unit]
    k = np.arange(width)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    far = np.int32(1 << 20)
    d = np.zeros((len(unit), width), np.int32)
    best = np.full(len(unit), far)
    end = np.zeros(len(unit), np.int64)
    for i in range(int(m.max())):
        at = low[:, None] + i + k
        inside = (at >= 0) & (at < len(data))
        seen = padded[np.where(inside, at, len(data))]
        cost = d + (seen != block.text[unit, i][:, None])
        cost[~inside] = far
        cost[:, :-1] = np.minimum(cost[:, :-1], d[:, 1:] + 1)
        d = np.minimum.accumulate(cost - k, axis=1).astype(np.int32) + k.astype(np.int32)
        done = m == i + 1
        if done.any():
            where = d[done].argmin(1)
            best[done] = d[done, where]
            end[done] = low[done] + i + where + 1
    return best, end


def short_hits(data: np.ndarray, block: Block) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end) in the plain form ``data`` of short items that stand there whole."""
    if not block.short:
        return
    gap = (data == 0x20) | (data == 0xFF)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    prefix = prefix_hash(data)
    for n, (hashes, items) in block.short.items():
        at = starts[starts + n < len(data)]  # a separator ends the data
        at = at[gap[at + n]]
        for p in at[np.isin(span_hash(prefix, at, at + n), hashes)].tolist():
            for item in items.get(data[p : p + n].tobytes(), ()):
                yield item, p, p + n


def part_hits(data: np.ndarray, block: Block) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end) of the stretches of ``data`` whose every PART words stand in one
    item; those that touch are one."""
    if not block.parts:
        return
    gap = (data == 0x20) | (data == 0xFF)
    edge = np.diff(np.concatenate([[True], gap]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    text = np.searchsorted(np.flatnonzero(data == 0xFF), starts)
    n = len(starts) - PART + 1
    if n <= 0:
        return
    one = text[:n] == text[PART - 1 :]
    hashes = span_hash(prefix_hash(data), starts[:n], ends[PART - 1 :])
    where = np.searchsorted(block.part_hashes, hashes)
    where[where == len(block.part_hashes)] = 0
    open_: dict[int, tuple[int, int, int]] = {}  # item: first window, last window, text
    for w in np.flatnonzero(one & (block.part_hashes[where] == hashes)).tolist():
        form = data[starts[w] : ends[w + PART - 1]].tobytes()
        for item in block.parts.get(form, ()):
            first, last, doc = open_.get(item, (w, w, text[w]))
            if doc != text[w] or w > last + 1:
                yield item, int(starts[first]), int(ends[last + PART - 1])
                first = w
            open_[item] = (first, w, text[w])
    for item, (first, last, _) in open_.items():
        yield item, int(starts[first]), int(ends[last + PART - 1])


def find(texts: list[str | None], block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of all leaks; offsets in code points."""
    for at, part in chunks(texts):
        joined = np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8)
        data, origin = plain(joined)
        ends = np.flatnonzero(data == 0xFF)
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        for item, begin, stop in (*short_hits(data, block), *part_hits(data, block)):
            doc = int(np.searchsorted(ends, stop - 1))
            a, b = (int(origin[x]) - starts[doc] for x in (begin, stop - 1))
            yield (
                at + doc, item, len(part[doc][:a].decode("utf-8", "ignore")),
                len(part[doc][: b + 1].decode("utf-8", "ignore")), 0,
            )
        grams = qgrams(data)
        hit = np.flatnonzero(block.filter[slots(grams)])
        where = np.searchsorted(block.grams, grams[hit])
        where[where == len(block.grams)] = 0
        same = block.grams[where] == grams[hit]
        hit, where = hit[same], where[same]
        n = block.first[where + 1] - block.first[where]
        entry = np.repeat(block.first[where] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        position, unit = np.repeat(hit, n), block.unit[entry]
        diagonal = position - block.place[entry] + SHIFT
        step = block.budget[unit] + 1
        band = diagonal // step
        # Each hit counts for the band that begins here and the one that began before.
        key = np.concatenate([unit * (1 << 40) + band, unit * (1 << 40) + band - 1])
        keys, counts = np.unique(key, return_counts=True)
        unit, band = keys >> 40, keys & ((1 << 40) - 1)
        least = block.size[unit] - Q + 1 - Q * block.budget[unit]
        enough = counts >= least
        unit, band = unit[enough], band[enough]
        if not len(unit):
            continue
        low = band * (block.budget[unit] + 1) - SHIFT
        for i in range(0, len(unit), 4096):
            u, lo = unit[i : i + 4096], low[i : i + 4096]
            edits, end = align(block, u, lo, data)
            for j in np.flatnonzero(edits <= block.budget[u]):
                stop = int(min(end[j], len(data)))
                begin = max(0, stop - int(block.size[u[j]]))
                doc = int(np.searchsorted(ends, stop - 1))
                begin = max(begin, int(ends[doc - 1]) + 1 if doc else 0)
                a, b = (int(origin[x]) - starts[doc] for x in (begin, stop - 1))
                yield (
                    at + doc, int(block.item[u[j]]), len(part[doc][:a].decode("utf-8", "ignore")),
                    len(part[doc][: b + 1].decode("utf-8", "ignore")), int(edits[j]),
                )


def blocks_of(benchmark: DataFrame, rate: float, block_units: int) -> Iterator[Block]:
    """Blocks of about ``block_units`` units; one block of items is on the driver at a time."""
    held: list[tuple[int, bytes]] = []
    short: list[tuple[int, bytes]] = []
    whole: list[tuple[int, bytes]] = []
    for row in benchmark.select("item_id", "text").dropDuplicates().toLocalIterator():
        held += units_of(row["item_id"], row["text"])
        p = plain_form(row["text"])
        if 0 < len(p) < LEAST:
            short.append((row["item_id"], p))
        elif p:
            whole.append((row["item_id"], p))
        if len(held) + len(short) >= block_units:
            yield Block.of(held, rate, short, whole)
            held, short, whole = [], [], []
    if held or short:
        yield Block.of(held, rate, short, whole)


def passes_of(spark: SparkSession, benchmark: DataFrame, rate: float, block_units: int) -> Iterator[list]:
    """Broadcast blocks, PASS_BLOCKS at a time."""
    held = []
    for block in blocks_of(benchmark, rate, block_units):
        held.append(spark.sparkContext.broadcast(block))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


LEAKS = "doc_id long, item_id long, start long, end long, edits int"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_units: int = BLOCK_UNITS) -> DataFrame:
    """Places where a document has a benchmark unit within its edit budget, or PART words
    of an item: doc_id, item_id, start, end (code points), edits. Overlapping units of one
    item give a row each, repeated rows of documents likewise, whatever their ids.

    Null texts are empty; items whose plain form is under 40 bytes are found where it
    stands whole, without edits; those without a letter or digit have none. Empty tables
    give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], LEAKS)
    for held in passes_of(spark, benchmark, rate, block_units):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("text").to_pylist()
                rows = sorted({r for block in held for r in find(texts, block.value)}, key=repr)
                at, item, start, end, edits = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()),
                        pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32()),
                    ],
                    ["doc_id", "item_id", "start", "end", "edits"],
                )

        found = found.unionByName(small_batches(docs.select("doc_id", "text")).mapInArrow(run, LEAKS))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_units: int = BLOCK_UNITS) -> DataFrame:
    """The rows of ``docs`` that no leak was found in, with all their columns.

    Each row is judged by its own text, so null and repeated ids are no matter; null
    texts stay; without a benchmark all rows do.
    """
    for held in passes_of(docs.sparkSession, benchmark, rate, block_units):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                texts = b.column("text").to_pylist()
                for block in held:
                    keep[np.array([r[0] for r in find(texts, block.value)], np.int64)] = False
                yield b.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and item: number of places, least edits, first start, last end."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.min("edits").alias("edits"),
        F.min("start").alias("start"), F.max("end").alias("end"),
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak, row by row: see ``without_leaks``."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))
