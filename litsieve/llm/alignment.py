"""Alignment of two tokenizers' tokens over the same text.

Each distinct text is tokenised and aligned once: texts are shuffled whole, equal ones
become one row with its number of copies, which weighs the counts of id pairs.

Both vocabularies begin a new piece at a blank that no blank precedes and a visible
character follows, so a text falls into units there, every unit's end is an end of a
token on both sides, and a unit's groups are the same wherever it stands. A task
therefore works on chunks of some megabytes of text and encodes each distinct unit of
a chunk once; a chunk is written as one row that holds its id pairs and, packed, its
units' links and its texts' units. Counts of pairs come back per chunk, not per text.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from litsieve.llm.common import read, small_batches
from litsieve.operators.skew import lookup_by_key
from litsieve.session import durable

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that make a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1_500_000
#: Groups of more links than this are counted by distinct ids before they are expanded.
WIDE = 256
#: Bytes that a worker's memory of units takes, about.
MEMO_BYTES = 20_000_000
_JOINED = 64
_BLANK = 0x20
# Bytes that surely begin a visible character; the lead bytes left out also begin
# Unicode spaces, at which a text is simply not cut.
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = VISIBLE[0xC3:0xE1] = VISIBLE[0xE4:0xF5] = True


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches [start, start + size), one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class Side:
    """One tokenizer: ids of texts, and the bytes each id stands for."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode = encode
        self.pieces = pieces
        self.n_bytes = np.array([len(p) for p in pieces], np.int64)
        shown = [str(i).encode() for i in range(len(pieces))]
        self.n_digits = np.array([len(d) for d in shown], np.int64)
        self.digits = np.frombuffer(b"".join(shown), np.uint8)
        self.digits_at = np.cumsum(self.n_digits) - self.n_digits

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def coded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids per unit, which units are given back byte by byte).

        Units that may stand after one another are encoded joined, some dozens at a
        time, and told apart by the bytes of their ids.
        """
        joint = [i for i, u in enumerate(units) if len(u) > 1 and VISIBLE[u[1]] and u[-1] != _BLANK]
        whole = [b"".join([units[i] for i in joint[k : k + _JOINED]]) for k in range(0, len(joint), _JOINED)]
        parts = [np.zeros(0, np.int32)]
        for k in range(0, len(whole), _JOINED):  # some thousand units at a time
            some = whole[k : k + _JOINED]
            coded = list(chain.from_iterable(self.encode([w[1:].decode() for w in some])))
            if self.bytes_of(coded) != b"".join(some):
                joint, parts = [], parts[:1]  # one of them isn't given back: each on its own
                break
            parts.append(np.array(coded, np.int32))
        ids = np.concatenate(parts).astype(np.int64)
        sizes = np.fromiter((len(units[i]) for i in joint), np.int64, len(joint))
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1
        n, good = np.zeros(len(units), np.int64), np.ones(len(units), bool)
        n[joint] = np.diff(ends, prepend=0)
        done = set(joint)
        alone = [i for i in range(len(units)) if i not in done]
        if not alone:
            return ids, n, good
        rest = self.encode([units[i][1:].decode() for i in alone])
        for i, x in zip(alone, rest, strict=True):
            n[i], good[i] = len(x), self.bytes_of(x) == units[i]
        order = np.array([*joint, *alone], np.int64)
        both = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.int64)])
        start = np.zeros(len(units), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return both[ranges(start, n)], n, good


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def side_a(path: str | None) -> Side:
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path(FILE_A))
    t.encode_special_tokens = True
    alphabet = _byte_of_char()
    vocabulary = t.get_vocab()
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        pieces[i] = bytes(alphabet[c] for c in token if c in alphabet)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]

    return Side(encode, pieces)


@cache
def side_b(path: str | None) -> Side:
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(FILE_B))
    pieces = []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        pieces.append(bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode())
    return Side(lambda texts: m.encode(texts, num_threads=1), pieces)


class Units:
    """Some distinct units, aligned.

    Per unit: ``good`` (both sides give it back), ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_shown`` (bytes of ``shown`` that are its: its groups, every one ended
    by a semicolon), ``lines``: how many of the link lines are its. Per link line: ``pair``
    (a << 32 | b), ``times``.
    """

    def __init__(self, units: list[bytes], a: Side, b: Side):
        n = len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        ids_a, self.n_a, good_a = a.coded(units)
        ids_b, self.n_b, good_b = b.coded(units)
        self.good = good_a & good_b
        if not self.good.all():
            ids_a, ids_b = ids_a[np.repeat(self.good, self.n_a)], ids_b[np.repeat(self.good, self.n_b)]
        # All good units stand one after another, so a place tells a unit and an offset.
        end_a, end_b = np.cumsum(a.n_bytes[ids_a]), np.cumsum(b.n_bytes[ids_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        unit = np.searchsorted(np.cumsum(np.where(self.good, size, 0)), ends)
        self.n_groups = np.bincount(unit, minlength=n)
        links = in_a * in_b
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, unit, links)
        self._link(ids_a, ids_b, in_a, in_b, links, unit, n)
        self._show(a, b, ids_a, ids_b, group_a, group_b, in_a, in_b, unit, n)

    def _link(self, ids_a, ids_b, in_a, in_b, links, unit, n) -> None:
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        each = np.repeat(np.arange(len(links)), np.where(links <= WIDE, links, 0))
        k = ranges(np.zeros(len(links), np.int64), np.where(links <= WIDE, links, 0))
        owner = [unit[each]]
        pairs = [ids_a[at_a[each] + k // in_b[each]] << 32 | ids_b[at_b[each] + k % in_b[each]]]
        times = [np.ones(len(each), np.int64)]
        wide = np.flatnonzero(links > WIDE)
        for g in wide.tolist():
            x, nx = np.unique(ids_a[at_a[g] : at_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(ids_b[at_b[g] : at_b[g] + in_b[g]], return_counts=True)
            owner.append(np.full(len(x) * len(y), unit[g]))
            pairs.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append(np.outer(nx, ny).ravel())
        owner, self.pair, self.times = map(np.concatenate, (owner, pairs, times))
        if len(wide):
            order = np.argsort(owner, kind="stable")
            owner, self.pair, self.times = owner[order], self.pair[order], self.times[order]
        self.lines = np.bincount(owner, minlength=n)

    def _show(self, a, b, ids_a, ids_b, group_a, group_b, in_a, in_b, unit, n) -> None:
        end_a, end_b = np.full(len(ids_a), ord(",")), np.full(len(ids_b), ord(","))
        end_a[np.cumsum(in_a) - 1], end_b[np.cumsum(in_b) - 1] = ord("|"), ord(";")
        # Tokens in the order they are shown in: a group's a, then its b.
        at_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
        size, start, end = (np.zeros(len(ids_a) + len(ids_b), np.int64) for _ in range(3))
        digits = np.concatenate([a.digits, b.digits])
        size[at_a], size[at_b] = a.n_digits[ids_a], b.n_digits[ids_b]
        start[at_a], start[at_b] = a.digits_at[ids_a], b.digits_at[ids_b] + len(a.digits)
        end[at_a], end[at_b] = end_a, end_b
        out = np.zeros(int(size.sum()) + len(size), np.uint8)
        stops = np.cumsum(size + 1) - 1
        out[stops] = end
        shown = np.ones(len(out), bool)
        shown[stops] = False
        out[shown] = digits[ranges(start, size)]
        tokens = np.zeros(n, np.int64)
        np.add.at(tokens, unit, in_a + in_b)
        cuts = np.concatenate([[0], stops + 1])[np.concatenate([[0], np.cumsum(tokens)])]
        self.shown = out.tobytes()
        self.n_shown = np.diff(cuts)


class Memo:
    """Units met before, forgotten all at once when they take more than ``MEMO_BYTES``."""

    ARRAYS = ("good", "n_a", "n_b", "n_groups", "n_links", "lines", "pair", "times", "n_shown")

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.known = Units([], *self.sides)
        self.held = 0

    def slots(self, units: pa.Array) -> np.ndarray:
        """Places of distinct ``units`` in ``known``."""
        if self.held > MEMO_BYTES:
            self._forget()
        found = pc.index_in(units, value_set=self.units)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = units.filter(found.is_null())
            k, more = self.known, Units(new.to_pylist(), *self.sides)
            at[at < 0] = np.arange(len(k.lines), len(k.lines) + len(new))
            for name in self.ARRAYS:
                setattr(k, name, np.append(getattr(k, name), getattr(more, name)))
            k.shown += more.shown
            self.units = pa.concat_arrays([self.units, new])
            self.held = self.units.nbytes + len(k.shown) + sum(getattr(k, name).nbytes for name in self.ARRAYS)
            self.line_at, self.shown_at = np.cumsum(k.lines) - k.lines, np.cumsum(k.n_shown) - k.n_shown
        return at

    def shown(self, slots: np.ndarray) -> list[bytes]:
        at, text = self.shown_at[slots], self.known.shown
        return [text[i:j] for i, j in zip(at.tolist(), (at + self.known.n_shown[slots]).tolist(), strict=True)]


@cache
def memo(path_a: str | None, path_b: str | None) -> Memo:
    return Memo(side_a(path_a), side_b(path_b))


def split(texts: list[bytes], lead: bytes = b" ") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct units, each occurrence's unit, index of each text's first occurrence
    with one more at the end) of texts after the byte ``lead``."""
    data = b"".join([lead + t for t in texts])
    raw = np.frombuffer(data, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    opens = np.cumsum(sizes) - sizes
    at = np.flatnonzero(raw == _BLANK)
    inner = at[(at > 0) & (at < len(raw) - 1)]
    inner = inner[(raw[inner - 1] != _BLANK) & VISIBLE[raw[inner + 1]]]
    cut = np.zeros(len(raw), bool)
    cut[inner] = cut[opens] = True
    start = np.flatnonzero(cut)
    offsets = np.append(start, len(raw)).astype(np.int64)
    spans = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    ).dictionary_encode()
    return spans.dictionary, spans.indices.to_numpy(), np.searchsorted(start, np.append(opens, len(raw)))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, groups: the alignment of each text as ``a1,a2|b1;a3|b2,b3``.

    Empty where a text has no tokens: null, empty, or not given back byte by byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(path_a, path_b)
        for batch in batches:
            texts, out = _texts(batch.column("text")), []
            units, words, first = split(texts)
            slot = known.slots(units)
            shown, good = known.shown(slot), known.known.good[slot]
            for t, (i, j) in zip(texts, pairwise(first.tolist()), strict=True):
                whole = b"".join(map(shown.__getitem__, words[i:j].tolist()))[:-1]
                out.append(whole.decode() if t and good[words[i:j]].all() else "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "groups"])

    return small_batches(docs.select("doc_id", "text"), 256).mapInArrow(run, "doc_id long, groups string")


#: ``data``: the arrays of ``_chunk`` but for pairs and docs, packed; only tasks unpack them.
CHUNKS = "chunk long, pairs array<long>, docs array<long>, data binary"


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, each in the fewest bytes that hold its numbers."""
    out = io.BytesIO()
    np.savez(out, **{name: x.astype(np.min_scalar_type(x.max(initial=0))) if x.dtype.kind == "i" else x for name, x in arrays.items()})
    return zstandard.compress(out.getvalue(), 1)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(data))) as f:
        return {name: f[name].astype(np.int64) if f[name].dtype.kind == "u" else f[name] for name in f.files}


def _chunk(texts: list[bytes], copies: np.ndarray, known: Memo) -> dict:
    """One chunk's row: per text its measures, per unit its links, per pair the number
    of documents here that hold it."""
    units, words, first = split(texts)
    slot = known.slots(units)
    u = known.known
    good = u.good[slot]
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    bad = np.bincount(doc, ~good[words], len(texts)) > 0
    shown, digests = known.shown(slot), []
    listed = words.tolist()
    for skip, (s, e) in zip(bad.tolist(), pairwise(first.tolist()), strict=True):
        text = b"" if skip else b"".join([shown[w] for w in listed[s:e]])[:-1]
        digests.append(hashlib.sha256(text).hexdigest() if text else "")

    held = np.sort((doc * len(units) + words)[~bad[doc]])
    starts = np.flatnonzero(np.diff(held, prepend=-1))
    times = np.diff(starts, append=len(held))
    text, unit = np.divmod(held[starts], len(units))

    def summed(per_unit: np.ndarray) -> np.ndarray:
        return _per_text(text, times * per_unit[slot][unit], len(texts))

    lines = u.lines[slot]
    line = ranges(known.line_at[slot], lines)
    pairs, link_pair = np.unique(u.pair[line], return_inverse=True)
    n_pairs = max(len(pairs), 1)
    of_text = ranges((np.cumsum(lines) - lines)[unit], lines[unit])
    seen = np.sort(np.repeat(text * n_pairs, lines[unit]) + link_pair[of_text])
    seen = seen[np.diff(seen, prepend=-1) > 0]
    docs = np.bincount(seen % n_pairs, copies[seen // n_pairs], len(pairs)).astype(np.int64)
    return {
        "keys": np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), "V32"),
        "n_a": summed(u.n_a), "n_b": summed(u.n_b), "n_groups": summed(u.n_groups), "n_links": summed(u.n_links),
        "digests": np.array(digests, "U64"), "copies": copies, "pairs": pairs, "docs": docs, "unit_links": lines,
        "link_pairs": link_pair, "link_times": u.times[line],
        "text_units": np.bincount(text, minlength=len(texts)), "units": unit, "unit_times": times,
    }


def _per_text(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``text``, which is in ascending order."""
    running = np.concatenate([[0], np.cumsum(values)])
    edges = np.searchsorted(text, np.arange(n + 1))
    return running[edges[1:]] - running[edges[:-1]]


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The distinct non-empty texts of ``docs``, aligned in chunks: a written table of
    ``CHUNKS``, one row per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        held: list[bytes] = []
        copies: list[int] = []
        size = 0

        def row() -> pa.RecordBatch:
            got = _chunk(held, np.array(copies, np.int64), known)
            lists = [pa.array([got.pop(name)], pa.list_(pa.int64())) for name in ("pairs", "docs")]
            columns = [pa.array([number], pa.int64()), *lists, pa.array([_packed(got)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "pairs", "docs", "data"])

        for batch in batches:
            for t, n in zip(_texts(batch.column("text")), batch.column("copies").to_pylist(), strict=True):
                held.append(t)
                copies.append(n)
                size += len(t)
                if size >= chunk_bytes:
                    yield row()
                    held, copies, size, number = [], [], 0, number + 1
        if held:
            yield row()

    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return durable(small_batches(distinct).mapInArrow(run, CHUNKS), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (a << 32 | b), docs: documents that hold the pair linked, best: whether no
    pair of the same a has more."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    summed = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("docs"))
    # Partners of one id: as many as the other vocabulary has, at most.
    most = F.max("docs").over(W.partitionBy(F.shiftright("pair", 32)))
    return summed.withColumn("best", F.col("docs") == most)


TEXTS = (
    "key binary, n_rows long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            get = _unpacked(batch.column("data")[i].as_py())
            # In the order of the chunk's pairs: twice the documents, odd where best.
            value = batch.column("counts")[i].values.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(get["unit_links"])])
            text = np.repeat(np.arange(len(get["copies"])), get["text_units"])

            def summed(per_pair: np.ndarray) -> np.ndarray:
                running = np.concatenate([[0], np.cumsum(per_pair[get["link_pairs"]] * get["link_times"])])
                per_unit = running[ends[1:]] - running[ends[:-1]]
                return _per_text(text, per_unit[get["units"]] * get["unit_times"], len(get["copies"]))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k.tobytes() for k in get["keys"]], pa.binary()), pa.array(get["copies"]),
                    *(pa.array(get[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(summed(value & 1)), pa.array(summed(value >> 1)), pa.array(get["digests"].tolist(), pa.string()),
                ],
                [x.split()[0] for x in TEXTS.split(", ")],
            )


def measures(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every row is a document of its own, whatever its id; null and empty texts and
    texts that a side doesn't give back have zeros and an empty digest; other columns
    are ignored; no rows give no rows.
    """
    chunks = aligned(docs, path_a, path_b, chunk_bytes)
    counts = pair_counts(chunks)
    asked = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    # A chunk's own pairs, bounded by its bytes.
    answers = (
        asked.join(counts, "pair")
        .select("chunk", F.struct("pos", (F.col("docs") * 2 + F.col("best").cast("long")).alias("v")).alias("s"))
        .groupBy("chunk")
        .agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("counts"))
    )
    used = chunks.select("chunk", "data").join(answers, "chunk", "left").withColumn(
        "counts", F.coalesce("counts", F.array().cast("array<long>"))
    )
    per_text = durable(small_batches(used, 2).mapInArrow(_measured, TEXTS), "measured")
    rows = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("key"))
    full = rows.filter("key IS NOT NULL").withColumn("_spread", F.monotonically_increasing_id())
    names = [x.split()[0] for x in TEXTS.split(", ")][2:]
    found = lookup_by_key(full, per_text, ["key"], "_spread").select("doc_id", *names)
    zeros = [F.lit(0).cast("long").alias(c) for c in names[:-1]]
    return found.unionByName(rows.filter("key IS NULL").select("doc_id", *zeros, F.lit("").alias("groups_sha256")))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(read(spark, sf_dir, "documents"))
