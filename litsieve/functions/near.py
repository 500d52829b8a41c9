"""Similar titles of two blocks, compared a tile of pairs at a time.

Three tests in turn, none of which rejects a pair that reaches the threshold: the letters
that both have, the runs of ``LONG_GRAM`` letters that both have, and their longest common
subsequence; then the score. The first looks at every pair of the length band, so it is done on whole
tiles; the others look at what the one before has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from litsieve.functions.similarity import LONG_GRAM, NEVER, Bounds, gram_bits, gram_values, subsequences_reach

# Classes of characters: a-z, blank, and all others by their number.
CLASSES = 32
# Letters that are read in one go, about.
LETTERS_AT_ONCE = 1 << 17
# Rows of a tile on either side.
TILE = (128, 1024)
# Bits of a title's runs per letter, and words of them at most.
BITS_PER_LETTER = 4
MOST_WORDS = 1024
# Words of runs that are compared in one go.
WORDS_AT_ONCE = 1 << 16
# Cells of a table of titles and characters.
CELLS = 1 << 22
# Pairs whose common subsequences are looked for in one go.
PAIRS_AT_ONCE = 1 << 14


class Side:
    """Titles of one block, the shortest first."""

    def __init__(self, texts: list[str], rank: np.ndarray):
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(length, kind="stable")
        self.texts = [texts[i] for i in self.order]
        self.length, self.rank = length[self.order], rank[self.order]

    def parts(self, letters: int) -> Iterator[slice]:
        """Stretches of about so many letters."""
        part = np.cumsum(self.length) // letters
        at = [0, *(np.flatnonzero(np.diff(part)) + 1), len(self.texts)]
        return (slice(x, y) for x, y in zip(at, at[1:], strict=False) if x < y)

    def count(self) -> None:
        """``classes``: letters by class; ``seeds``: characters that may begin a block."""
        n = len(self.texts)
        self.classes = np.zeros((CLASSES, n), np.int16 if not n or self.length[-1] < 1 << 15 else np.int32)
        self.seeds = np.full(n, NEVER)
        for part in self.parts(LETTERS_AT_ONCE):
            codes = np.frombuffer("".join(self.texts[part]).encode("utf-32-le", "surrogatepass"), "<u4")
            there = np.zeros(int(codes.max(initial=0)) + 1, bool)
            there[codes] = True
            kinds = np.flatnonzero(there)
            number = np.cumsum(there) - 1
            of = np.where((kinds >= 97) & (kinds < 123), kinds - 97, np.where(kinds == 32, 26, 27 + kinds % (CLASSES - 27)))
            length = self.length[part]
            ends = np.cumsum(length)
            step = max(CELLS // max(len(kinds), 1), 1)
            for x in range(0, len(length), step):
                some = length[x : x + step]
                owner = np.repeat(np.arange(len(some)), some)
                mine = number[codes[ends[x] - some[0] : ends[x + len(some) - 1]]]
                counts = np.bincount(owner * len(kinds) + mine, minlength=len(some) * len(kinds)).reshape(len(some), -1)
                here = slice(part.start + x, part.start + x + len(some))
                for k, c in enumerate(of):
                    self.classes[c, here] += counts[:, k].astype(self.classes.dtype)
                rare = np.where(counts <= some[:, None] // 100 + 1, counts, 0).sum(1)
                self.seeds[here] = np.where(some >= 200, rare, NEVER)

    def mark(self, words: int) -> None:
        """``codes``: the runs of letters, equal ones told apart, from ``at`` on for each title;
        ``runs``: bits of them, and ``n_runs`` the number of those."""
        codes, runs = [np.zeros(0, np.uint16)], [np.zeros((0, words), np.uint64)]
        for part in self.parts(LETTERS_AT_ONCE):
            owner, value = gram_values(self.texts[part], LONG_GRAM)
            codes.append((value >> np.uint64(48)).astype(np.uint16))
            runs.append(gram_bits(owner, value, part.stop - part.start, words).view(np.uint64))
        self.codes, self.runs = np.concatenate(codes), np.concatenate(runs)
        self.at = np.concatenate([[0], np.cumsum(np.maximum(self.length - LONG_GRAM + 1, 0))])
        self.n_runs = np.bitwise_count(self.runs).sum(1, dtype=np.int64)


def near_pairs(left: Side, right: Side, bounds: Bounds, band: int | None, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the left, of the right block, similarity) of similar rows; with ``same`` those
    blocks are one and the earlier row is the left one."""
    if not len(left.texts) or not len(right.texts):
        return
    left.count()
    right.count()
    words = min(BITS_PER_LETTER * int(max(left.length[-1], right.length[-1])) // 64 + 2, MOST_WORDS)
    left.mark(words)
    right.mark(words)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in _tiles(left, right, bounds, band):
        i, j = _letters_reach(left, right, x, y, bounds, band, same)
        if not len(i):
            continue
        held.append(_runs_reach(left, right, i, j, bounds, words))
        if sum(len(i) for i, _ in held) >= PAIRS_AT_ONCE:
            yield _scored(left, right, bounds, held)
            held = []
    if held:
        yield _scored(left, right, bounds, held)


def _tiles(left: Side, right: Side, bounds: Bounds, band: int | None) -> Iterator[tuple[slice, slice]]:
    """Tiles with a pair of allowed lengths."""
    for x in range(0, len(left.texts), TILE[0]):
        mine = left.length[x : x + TILE[0]]
        there = np.unique(right.length)
        ok = _least(np.unique(mine)[:, None], there, bounds, band).min(0) < NEVER
        if not ok.any():
            continue
        start = np.searchsorted(right.length, there[ok][0], "left")
        end = np.searchsorted(right.length, there[ok][-1], "right")
        for y in range(start, end, TILE[1]):
            yield slice(x, x + len(mine)), slice(y, min(y + TILE[1], end))


def _least(x: np.ndarray, y: np.ndarray, bounds: Bounds, band: int | None) -> np.ndarray:
    """Letters of a common subsequence; ``NEVER`` for lengths that aren't compared."""
    need = bounds.common(x, y)
    never = need > np.minimum(x, y)
    if band is not None:
        never |= np.abs(x - y) > band
    return np.where(never, NEVER, need)


def _letters_reach(left: Side, right: Side, x: slice, y: slice, bounds: Bounds, band: int | None, same: bool) -> tuple[np.ndarray, np.ndarray]:
    kind = np.promote_types(left.classes.dtype, right.classes.dtype)
    mine, theirs = left.classes[:, x].astype(kind, copy=False), right.classes[:, y].astype(kind, copy=False)
    shared, both = np.zeros((mine.shape[1], theirs.shape[1]), kind), np.empty((mine.shape[1], theirs.shape[1]), kind)
    for a, b in zip(mine, theirs, strict=True):
        if a.any() and b.any():
            shared += np.minimum(a[:, None], b, out=both)
    lx, ix = np.unique(left.length[x], return_inverse=True)
    ly, iy = np.unique(right.length[y], return_inverse=True)
    need = np.minimum(_least(lx[:, None], ly, bounds, band), np.iinfo(kind).max).astype(kind)
    ok = shared >= need[ix][:, iy]
    if same:
        ok &= left.rank[x][:, None] < right.rank[y]
    i, j = np.nonzero(ok)
    return i + x.start, j + y.start


def _runs_reach(left: Side, right: Side, i: np.ndarray, j: np.ndarray, bounds: Bounds, words: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.where(left.rank[i] > right.rank[j], left.seeds[i], right.seeds[j]) if bounds.junk else np.full(len(i), NEVER)
    least = bounds.runs(left.length[i], right.length[j], seeds)
    # Two runs of a title may have one bit, so what counts are bits that the other lacks.
    need = np.maximum(left.n_runs[i] - left.length[i], right.n_runs[j] - right.length[j]) + LONG_GRAM - 1 + least
    ok, told, ones = least <= 0, np.flatnonzero(least > 0), np.ones(words, np.float32)
    step = max(WORDS_AT_ONCE // words, 1)
    for at in range(0, len(told), step):
        some = told[at : at + step]
        both = np.bitwise_count(left.runs[i[some]] & right.runs[j[some]])
        ok[some] = both.astype(np.float32) @ ones >= need[some]
    # What is left by 16 bits of each run: one title of the left block with all of the right one.
    told = told[ok[told]]
    there = np.zeros(1 << 16, bool)
    for some in np.split(told, np.flatnonzero(np.diff(i[told])) + 1) if len(told) else ():
        mine = left.codes[left.at[i[some[0]]] : left.at[i[some[0]] + 1]]
        there[mine] = True
        start, end = right.at[j[some]], right.at[j[some] + 1]
        hits = there[np.concatenate([right.codes[x:y] for x, y in zip(start, end, strict=True)])]
        # A title with a bound above 0 has runs, so no stretch is empty.
        ok[some] = np.add.reduceat(hits, np.cumsum(end - start) - (end - start), dtype=np.int64) >= least[some]
        there[mine] = False
    return i[ok], j[ok]


def _scored(left: Side, right: Side, bounds: Bounds, held: list) -> tuple[np.ndarray, ...]:
    i, j = map(np.concatenate, zip(*held, strict=True))
    need = bounds.common(left.length[i], right.length[j])
    ok = subsequences_reach([left.texts[k] for k in i], [right.texts[k] for k in j], need)
    i, j = i[ok], j[ok]
    first = left.rank[i] < right.rank[j]
    pairs = [(left.texts[x], right.texts[y])[:: 1 if f else -1] for x, y, f in zip(i, j, first, strict=True)]
    found = bounds.score(*(list(side) for side in zip(*pairs, strict=True))) if pairs else np.zeros(0)
    return i[found >= 0], j[found >= 0], found[found >= 0]


def similar_rows(bounds: Bounds, band: int | None, at: list[str], self_join: bool):
    """For ``mapInArrow`` over copies of rows (place ``at``, left, ord, norm), sorted by place:
    the similar pairs (lo, hi, similarity) of each place. In a self-join a place whose two
    halves are equal is a block that meets itself. One place is held at a time."""
    half = len(at) // 2

    def pairs(place: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.filter(pc.is_valid(rows.column("ord")))
        rank = pc.rank(rows.column("ord"), tiebreaker="dense").to_numpy().astype(np.int64)
        left = rows.column("left").to_numpy(zero_copy_only=False)
        texts = rows.column("norm").to_pylist()
        sides, places = [], []
        for mine in (np.flatnonzero(left), np.flatnonzero(~left)):
            sides.append(Side([texts[k] for k in mine], rank[mine]))
            places.append(mine[sides[-1].order])
        for i, j, similarity in near_pairs(*sides, bounds, band, self_join and place[:half] == place[half:]):
            i, j = places[0][i], places[1][j]
            first = rank[i] < rank[j]
            lo, hi = np.where(first, i, j), np.where(first, j, i)
            found = pa.table([rows.column("ord").take(lo), rows.column("ord").take(hi), similarity], ["lo", "hi", "similarity"])
            yield from found.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in at])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for x, y in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                place = tuple(keys[:, x].tolist())
                if place != now and held:
                    yield from pairs(now, held)
                    held = []
                now = place
                held.append(b.slice(x, y - x))
        if held:
            yield from pairs(now, held)

    return run
