"""Similarity measures: pair score, size bound, and class profiles.

Each measure sees a normalised title as a multiset (its letters, its words) and
gives its ``size``, a bit ``profile`` of it, and for a pair the least overlap the
two must have to reach the threshold. A profile bit one title has and the other
lacks stands for at least one element outside the overlap, so counting such bits
never rejects a pair that reaches the threshold.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# One class per letter a-z, one for the blank, one for everything else; each
# class has BITS bits, so a profile is WORDS longs.
LETTERS = list(string.ascii_lowercase) + [" "]
BITS = 32
WORDS = (len(LETTERS) + 1) * BITS // 64
# Words of the profile of adjacent letters.
GRAM_WORDS = 8
# Words of the profile of LONG_GRAM adjacent letters, which stands in for that of pairs where
# a similar title must share enough of them.
LONG_GRAM = 4
LONG_WORDS = 32
# Letters whose runs are sorted in one go, about.
LETTERS_AT_ONCE = 1_000_000
# Bits of the mask of a text's runs of letters, in Python.
MASK_BITS = 1 << 14
# Pairs that are compared in one go, and the cells of their table of letters at most.
SIDE_BY_SIDE = 4096
LETTER_CELLS = 1 << 22
# Fewer pairs than this per 64 letters are compared one by one.
LEAST_PER_WORD = 32
# Titles above this length have no edit bound before the ratio, and too many parts to meet on.
LONG_TITLE = 100
EPS = 1e-9
# A number that no length reaches.
NEVER = 1 << 30


def char_profile(rows: DataFrame) -> DataFrame:
    """Add p0..: per letter class the lowest ``count`` bits set."""
    counts = [f"length(norm) - length(replace(norm, '{ch}')) AS n{i}" for i, ch in enumerate(LETTERS)]
    seen = " - ".join(f"n{i}" for i in range(len(LETTERS)))
    low = [f"(shiftleft(1L, least(n{i}, {BITS})) - 1L)" for i in range(len(LETTERS))]
    low.append(f"(shiftleft(1L, least(length(norm) - {seen}, {BITS})) - 1L)")
    words = [f"{low[2 * k]} | shiftleft({low[2 * k + 1]}, {BITS}) AS p{k}" for k in range(WORDS)]
    return rows.selectExpr("*", *counts).selectExpr(*rows.columns, *words)


def gram_profile(rows: DataFrame, q: int = 2, name: str = "g", words: int = GRAM_WORDS) -> DataFrame:
    """Add g0..: one bit per run of ``q`` adjacent letters, by hash; a text's second run of
    the same letters is another one than its first."""
    return rows.withColumn("bits", _gram_bits(q, words)(F.col("norm"))).selectExpr(
        *rows.columns, *[f"bits[{k}] AS {name}{k}" for k in range(words)]
    )


def gram_values(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each text's runs of ``q`` letters, by text, equal ones told apart."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
    n = max(len(codes) - q + 1, 0)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        value = (value + codes[k : n + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    whole = owner[:n] == owner[q - 1 : n + q - 1]
    # Text and 40 bits of the run in one number, so that one sort brings equal runs together.
    bits = np.uint64(40)
    both = np.sort((owner[:n][whole] << bits) | (value[whole] >> (np.uint64(64) - bits)))
    first = np.ones(len(both), dtype=bool)
    first[1:] = both[1:] != both[:-1]
    at = np.arange(len(both))
    nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    value = ((both & ((np.uint64(1) << bits) - np.uint64(1))) + nth) * np.uint64(0x9E3779B97F4A7C15)
    return both >> bits, value ^ (value >> np.uint64(32))


def gram_bits(owner: np.ndarray, value: np.ndarray, n: int, words: int) -> np.ndarray:
    """Rows of ``words`` longs: the bits of the runs of ``n`` texts."""
    size = np.uint64(64 * words)
    on = np.zeros((n, 64 * words), dtype=bool)
    on.reshape(-1)[(owner * size + (((value & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32))).astype(np.int64)] = True
    return np.packbits(on, axis=1).view(np.int64)


def _gram_bits(q: int, words: int):
    @F.pandas_udf("array<bigint>")
    def bits(norms: pd.Series) -> pd.Series:
        texts = norms.fillna("")
        part = texts.str.len().cumsum().to_numpy(dtype=np.int64) // LETTERS_AT_ONCE
        return pd.Series([row for _, some in texts.groupby(part, sort=False) for row in gram_bits(*gram_values(list(some), q), len(some), words)], dtype=object)

    return bits


def _bit_words(rows: DataFrame, kept: list[str], name: str, n: int) -> DataFrame:
    words = [
        "aggregate(bits, 0L, (acc, x) -> acc | "
        f"if(x div 64 = {k}, shiftleft(1L, cast(x % 64 as int)), 0L)) AS {name}{k}"
        for k in range(n)
    ]
    return rows.selectExpr(*kept, *words)


def token_set(norm: Column) -> Column:
    return F.array_distinct(F.split(norm, " "))


def token_profile(rows: DataFrame) -> DataFrame:
    """Add p0..: one bit per distinct word, by hash."""
    bits = F.transform(token_set(F.col("norm")), lambda w: F.pmod(F.xxhash64(w), F.lit(64 * WORDS)))
    return _bit_words(rows.withColumn("bits", bits), rows.columns, "p", WORDS)


def bits_missing(a: str, b: str, name: str = "p", n: int = WORDS) -> str:
    """Profile bits of side ``a`` that side ``b`` lacks, as SQL."""
    return " + ".join(f"bit_count({a}_{name}{k} & ~{b}_{name}{k})" for k in range(n))


@lru_cache(maxsize=4096)
def _positions(text: str) -> dict[str, int]:
    """Per character, a bit mask of where it stands."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def common_subsequence(a: str, b: str, need: float = 0) -> int:
    """Length of the longest common subsequence, one row of bits at a time.

    Stops early, with a value below ``need``, once ``need`` is out of reach.
    """
    masks, full, row = _positions(a), (1 << len(a)) - 1, (1 << len(a)) - 1
    for start in range(0, len(b), 32):
        for ch in b[start : start + 32]:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        found = len(a) - row.bit_count()
        if found + max(len(b) - start - 32, 0) < need:
            break
    return len(a) - row.bit_count()


def subsequences_reach(first: list[str], second: list[str], need: list[float]) -> np.ndarray:
    """Per pair: the longest common subsequence has ``need`` letters.

    Pairs of about the same length go through the rows of bits side by side; where too few
    are, each goes by itself.
    """
    out = np.zeros(len(first), dtype=bool)
    words = np.array([-(-len(a) // 64) for a in first], dtype=np.int64)
    order = np.argsort(words, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        for start in range(0, len(group), SIDE_BY_SIDE):
            part = group[start : start + SIDE_BY_SIDE]
            out[part] = _reach([first[i] for i in part], [second[i] for i in part], np.array([need[i] for i in part], dtype=float))
    return out


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in a row, and the texts' lengths."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return letters, np.array([len(t) for t in texts], dtype=np.int64)


def _tables(first: list[str], second: list[str], words: int) -> tuple[np.ndarray, ...] | None:
    """(masks, columns, lengths, sizes) of pairs whose first texts have ``words`` words of 64
    letters at most: where each letter stands in each first text, and where the letters of
    the second texts are found there. None where that is too much."""
    which, texts = pd.factorize(np.array(first, dtype=object))
    letters, lengths = _coded(list(texts))
    partners, others = pd.factorize(np.array(second, dtype=object))
    theirs, sizes = _coded(list(others))
    number = np.zeros(int(max(letters.max(initial=0), theirs.max(initial=0))) + 1, dtype=np.int64)
    number[letters] = 1
    alphabet = np.flatnonzero(number)
    kinds = len(alphabet) + 1  # the last is any letter that no first text has
    number[:] = kinds - 1
    number[alphabet] = np.arange(kinds - 1)
    if max(kinds * words * len(texts), int(sizes.max(initial=0)) * len(first)) > LETTER_CELLS:
        return None
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cell = np.repeat(np.arange(len(texts)), lengths) * kinds + number[letters]
    masks = np.zeros((words, len(texts) * kinds), dtype=np.uint64)
    np.add.at(masks.reshape(-1), (place >> 6) * masks.shape[1] + cell, np.uint64(1) << (place & 63).astype(np.uint64))
    # Second texts as columns of letters, filled up with the last kind.
    columns = np.full((int(sizes.max()), len(others)), kinds - 1, dtype=np.int64)
    step = np.arange(len(theirs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[step, np.repeat(np.arange(len(others)), sizes)] = number[theirs]
    return masks, columns[:, partners] + which * kinds, lengths[which], sizes[partners]


def _reach(first: list[str], second: list[str], need: np.ndarray) -> np.ndarray:
    n, words = len(first), -(-max(map(len, first), default=0) // 64)
    if not words or not any(second) or n < LEAST_PER_WORD * words:
        return np.array([common_subsequence(a, b, x) >= x for a, b, x in zip(first, second, need)], dtype=bool)
    tables = _tables(first, second, words)
    if tables is None:
        half = n // 2
        return np.concatenate([_reach(first[:half], second[:half], need[:half]), _reach(first[half:], second[half:], need[half:])])
    masks, columns, length, size = tables
    live = np.arange(n)
    low = np.clip(length - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    full = np.where(low == 64, ~np.uint64(0), (np.uint64(1) << (low & np.uint64(63))) - np.uint64(1))
    rows = full.copy()
    for start in range(0, len(columns), 32):
        for column in columns[start : start + 32]:
            carry = None
            for w in range(words):
                row = rows[w]
                hit = row & masks[w].take(column)
                total = row + hit
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < words else None
                rows[w] = total | (row ^ hit)
        had = length - np.bitwise_count(rows & full).sum(axis=0, dtype=np.int64)
        on = had + np.maximum(size - start - 32, 0) >= need
        if not on.all():
            live, rows, full, columns = live[on], rows[:, on], full[:, on], columns[:, on]
            length, size, need = length[on], size[on], need[on]
            if not len(live):
                break
    out = np.zeros(n, dtype=bool)
    out[live] = True
    return out


def _alike(a: str, b: str) -> int:
    """Length of the common beginning."""
    least, most = 0, min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    while least < most:
        at = (least + most + 1) // 2
        if a[least:at] == b[least:at]:
            least = at
        else:
            most = at - 1
    return least


def edit_distances(first: list[str], second: list[str]) -> np.ndarray:
    """Edits that lead from one text to the other, per pair."""
    out, open_ = np.zeros(len(first), dtype=np.int64), []
    for i, (a, b) in enumerate(zip(first, second)):
        start = _alike(a, b)
        a, b = a[start:], b[start:]
        end = _alike(a[::-1], b[::-1])
        a, b = sorted((a[: len(a) - end], b[: len(b) - end]), key=len)
        if a:
            open_.append((-(-len(a) // 64), i, a, b))
        else:
            out[i] = len(b)
    open_.sort(key=lambda x: x[0])
    for words, group in groupby(open_, key=lambda x: x[0]):
        _, at, a, b = zip(*group)
        for x in range(0, len(at), SIDE_BY_SIDE):
            part = slice(x, x + SIDE_BY_SIDE)
            out[list(at[part])] = _edits(a[part], b[part], words)
    return out


def _edits(first: list[str], second: list[str], words: int) -> np.ndarray:
    """The same for texts of ``words`` words and no longer ones, by the vertical and
    horizontal steps of the table of distances, one row of bits at a time."""
    n = len(first)
    if n < LEAST_PER_WORD * words:
        return np.array([edit_distance(a, b) for a, b in zip(first, second)], dtype=np.int64)
    tables = _tables(first, second, words)
    if tables is None:
        half = n // 2
        return np.concatenate([_edits(first[:half], second[:half], words), _edits(first[half:], second[half:], words)])
    masks, columns, length, size = tables
    one, top = np.uint64(1), np.uint64(63)
    last = ((length - 1) % 64).astype(np.uint64)
    up, down, out = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64), length.copy()
    for k, column in enumerate(columns):
        more, less = np.ones(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for w in range(words):
            pv, mv, same = up[w], down[w], masks[w].take(column)
            xv = same | mv
            same |= less
            xh = (((same & pv) + pv) ^ pv) | same
            ph, mh = mv | ~(xh | pv), pv & xh
            if w + 1 == words:
                step = ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
                out += np.where(k < size, step, 0)
            over, under = ph >> top, mh >> top
            ph, mh = (ph << one) | more, (mh << one) | less
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            more, less = over, under
    return out


def edit_distance(a: str, b: str) -> int:
    if not a:
        return len(b)
    masks, full, top = _positions(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = full, 0, len(a)
    for ch in b:
        same = masks.get(ch, 0)
        xv = same | down
        xh = (((same & up) + up) ^ up) | same
        ph, mh = down | (full & ~(xh | up)), up & xh
        out += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) | 1, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv & full
    return out


# As many as a block's rows, and one more.
@lru_cache(maxsize=33_000)
def _gram_mask(text: str, q: int) -> tuple[int, int]:
    """Bits of the runs of ``q`` letters, by hash, equal ones told apart, and their number."""
    on, seen = bytearray(MASK_BITS // 8), {}
    for k in range(len(text) - q + 1):
        run = text[k : k + q]
        nth = seen[run] = seen.get(run, 0) + 1
        h = hash((run, nth)) % MASK_BITS
        on[h >> 3] |= 1 << (h & 7)
    mask = int.from_bytes(on)
    return mask, mask.bit_count()


def lacks_more(a: str, b: str, q: int, most_a: float, most_b: float) -> bool:
    """One of the texts has more runs of ``q`` letters that the other lacks than it may."""
    (x, n), (y, m) = _gram_mask(a, q), _gram_mask(b, q)
    both = (x & y).bit_count()
    return n - both > most_a or m - both > most_b


def edits_udf(threshold: float):
    """False where more than (1 - threshold) * longer length edits lead from one text to the
    other, by the runs of letters that an edit touches and by the common subsequence; true
    for a few more than the others."""

    @F.pandas_udf("boolean")
    def close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in batches:
            found, kept = np.zeros(len(first), dtype=bool), []
            for i, (a, b) in enumerate(zip(first, second)):
                longer = max(len(a), len(b))
                edits = int((1 - threshold) * longer + EPS)
                lost, need = LONG_GRAM * edits, longer - edits
                if not lacks_more(a, b, LONG_GRAM, lost, lost):
                    kept.append((i, a, b, need))
            if kept:
                at, a, b, need = zip(*kept)
                found[list(at)] = subsequences_reach(a, b, need)
            yield pd.Series(found, dtype="bool")

    return close


def ratio_udf(threshold: float, autojunk: bool = True):
    """Matching-blocks ratio 2M/(|a|+|b|); the argument order matters.

    M is at most the longest common subsequence, which is much cheaper, and what stands
    outside it is deleted or inserted; pairs that cannot reach the threshold by the runs of
    letters those touch or by the subsequence get 0 without the block search.
    """
    q = LONG_GRAM
    tells = (2 * q - 1) * (1 - threshold) <= 0.75 + EPS

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = SequenceMatcher(None, "", "", autojunk)
        for first, second in batches:
            scores, kept = np.zeros(len(first)), []
            for i, (a, b) in enumerate(zip(first, second)):
                need = threshold * (len(a) + len(b)) / 2 - EPS
                edits, longer = (2 * q - 1) * int((1 - threshold) * (len(a) + len(b)) + EPS), len(a) - len(b)
                if a and b and not (tells and lacks_more(a, b, q, (edits + longer) // 2, (edits - longer) // 2)):
                    kept.append((i, a, b, need))
            if kept:
                at, left, right, need = zip(*kept)
                for i in np.flatnonzero(subsequences_reach(left, right, need)):
                    matcher.set_seqs(left[i], right[i])
                    scores[at[i]] = matcher.ratio()
            yield pd.Series(scores, dtype="float64")

    return ratio


@dataclass(frozen=True)
class Bounds:
    """What two similar titles have at least, from their lengths.

    ``common``: letters of a common subsequence. ``runs``: common runs of LONG_GRAM letters;
    its third argument is the most blocks that hold a character which may begin one in the
    later title, ``NEVER`` where every character may. ``score`` is the similarity, of the
    earlier and the later titles, -1 where they aren't similar. ``junk``: a long later title
    has characters that may not.
    """

    common: Callable[[np.ndarray, np.ndarray], np.ndarray]
    runs: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[list[str], list[str]], np.ndarray]
    junk: bool = False


def edit_bounds(threshold: float) -> Bounds:
    """Of titles that (1 - threshold) * longer length edits lead from one to the other."""

    def edits(longer: np.ndarray) -> np.ndarray:
        return np.floor((1 - threshold) * longer + EPS).astype(np.int64)

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        longer = np.maximum(x, y)
        return longer - edits(longer)

    def runs(x: np.ndarray, y: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        # An edit touches at most LONG_GRAM runs of the longer title.
        longer = np.maximum(x, y)
        return longer - (LONG_GRAM - 1) - LONG_GRAM * edits(longer)

    def score(first: list[str], second: list[str]) -> np.ndarray:
        longer = np.array([max(len(a), len(b)) for a, b in zip(first, second)], dtype=np.int64)
        found = edit_distances(first, second)
        return np.where(found <= edits(longer), 1 - found / longer, -1.0)

    return Bounds(common, runs, score)


def ratio_bounds(threshold: float, autojunk: bool = True) -> Bounds:
    """Of titles whose matching blocks have threshold * (length + length) / 2 letters."""

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ceil(threshold * (x + y) / 2 - EPS).astype(np.int64)

    def runs(x: np.ndarray, y: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        # Between two blocks stands a letter that is in none. A block holds a character that
        # may begin one, or it is the beginning of what is left between two that do.
        least = common(x, y)
        blocks = np.minimum(x + y - 2 * least + 1, 2 * seeds + 1)
        return least - (LONG_GRAM - 1) * blocks

    def score(first: list[str], second: list[str]) -> np.ndarray:
        matcher, out = SequenceMatcher(None, "", "", autojunk), np.zeros(len(first))
        # What it knows of a second text serves for all its pairs.
        for i in sorted(range(len(second)), key=second.__getitem__):
            if matcher.b != second[i]:
                matcher.set_seq2(second[i])
            matcher.set_seq1(first[i])
            out[i] = matcher.ratio()
        return np.where(out >= threshold, out, -1.0)

    return Bounds(common, runs, score, autojunk)


@dataclass(frozen=True)
class Measure:
    size: Callable[[Column], Column]
    profile: Callable[[DataFrame], DataFrame]
    # least overlap of two titles, from the two sizes
    need: Callable[[Column, Column], Column]
    # JVM-side test on the two titles; final when ``decided_by_screen``
    screen: Callable[[Column, Column], Column]
    score: Callable[[Column, Column], Column]
    decided_by_screen: bool
    # similar titles' logarithms of size differ by less
    size_step: float
    # what the comparison of whole blocks goes by
    bounds: Bounds | None = None
    # for the shared-part route: the parts of a title, and how many of its
    # parts a similar title can lack at most (SQL over len, size and parts)
    parts: Callable[[Column], Column] | None = None
    may_lack: str | None = None
    # most pairs of adjacent letters that a title of the first size has and a
    # similar one of the second size lacks (SQL over the two sizes)
    grams_lost: str | None = None
    # titles above this length meet in the length band alone, where the lengths vary more
    parts_up_to: int | None = None


# Letters from rare to common, recoded so that text order puts
# rare letters first. Any one order is correct; this one keeps groups small.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "
RECODED = "abcdefghijklmnopqrstuvwxyz{"


def grams(q: int) -> Callable[[Column], Column]:
    """Distinct substrings of ``q`` characters, recoded."""

    def of(norm: Column) -> Column:
        chars = F.split(F.translate(norm, RARE_FIRST, RECODED), "")
        out = chars
        for k in range(1, q):  # each pass makes the grams one letter longer
            n = F.greatest(F.size(chars) - k, F.lit(0))
            out = F.zip_with(F.slice(out, F.lit(1), n), F.slice(chars, F.lit(1 + k), n), lambda x, y: F.concat(x, y))
        return F.array_distinct(out)

    return of


def gram_size(kept_share: Callable[[int], float], least: int = 4, most: int = 6) -> int | None:
    """The longest gram of which similar titles still share enough."""
    fitting = [q for q in range(least, most + 1) if kept_share(q) >= 0.35]
    return max(fitting, default=None)


def size_step(ratio: float) -> float:
    """Width of the cells of sizes whose logarithms are taken; similar ones differ by less."""
    return math.log(ratio) + 1e-6


def _levenshtein_within(a: Column, b: Column, limit: Column) -> Column:
    return F.call_function("levenshtein", a, b, limit.cast("int")) >= 0


def ratcliff(threshold: float, autojunk: bool = True) -> Measure:
    """difflib's ratio. 2M >= t(|a|+|b|), and M is at most the longest common
    subsequence, so the shared letters are bounded from below."""

    def need(sa: Column, sb: Column) -> Column:
        return F.ceil(F.lit(threshold) * (sa + sb) / 2 - EPS)

    def screen(a: Column, b: Column) -> Column:
        # What stands outside the common subsequence is deleted or inserted, so that
        # many edits at most lead from one title to the other. The subsequence itself is
        # the cheaper test of long titles; the score begins with it.
        within = _levenshtein_within(a, b, F.floor((1 - F.lit(threshold)) * (F.length(a) + F.length(b)) + EPS))
        return F.when(F.length(a) > LONG_TITLE, True).otherwise(within)

    udf = ratio_udf(threshold, autojunk)
    # A deleted letter takes two pairs of adjacent letters along, an inserted one parts one
    # pair; deletions and insertions differ by the sizes' difference.
    edits = f"floor((1 - {threshold}) * ({{x}} + {{y}}) + {EPS})"

    def lost(q: int) -> str:
        return f"floor(({2 * q - 1} * {edits} + {{x}} - {{y}}) / 2)"

    measure = Measure(
        F.length, char_profile, need, screen, lambda a, b: udf(a, b), False, size_step((2 - threshold) / threshold),
        ratio_bounds(threshold, autojunk), grams_lost=lost(2),
    )
    q = gram_size(lambda q: (2 * q - 1) * threshold - 2 * (q - 1))
    if q is None:
        return measure
    # A deleted letter touches q grams, an inserted one q - 1 of them; linear in
    # the partner's length, so the worst partner is at an end of its range.
    other = f"(2 * {q} - 1) * {threshold} / 2"

    def worst(partner: str) -> str:
        return f"len * ({q} - {other}) + ({partner}) * ({q} - 1 - {other})"

    shortest = f"greatest(len - {{band}}, len * {threshold} / (2 - {threshold}) - 1)"
    longest = f"least(len + {{band}}, len * (2 - {threshold}) / {threshold} + 1)"
    lack = f"floor(greatest({worst(shortest)}, {worst(longest)}) + {EPS})"
    return replace(measure, parts=grams(q), may_lack=lack, parts_up_to=LONG_TITLE)


def levenshtein(threshold: float) -> Measure:
    """1 - edits / longer length, on characters."""

    def limit(sa: Column, sb: Column) -> Column:
        return F.floor((1 - F.lit(threshold)) * F.greatest(sa, sb) + EPS)

    def screen(a: Column, b: Column) -> Column:
        return _levenshtein_within(a, b, limit(F.length(a), F.length(b)))

    def score(a: Column, b: Column) -> Column:
        return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))

    def need(sa: Column, sb: Column) -> Column:
        return F.greatest(sa, sb) - limit(sa, sb)

    # An edit touches at most two pairs of adjacent letters.
    edits = f"floor((1 - {threshold}) * greatest({{x}}, {{y}}) + {EPS})"
    measure = Measure(
        F.length, char_profile, need, screen, score, True, size_step(1 / threshold), edit_bounds(threshold), grams_lost=f"2 * {edits}"
    )
    q = gram_size(lambda q: 1 - q * (1 - threshold))
    if q is None:
        return measure
    # An edit touches at most q grams.
    lack = f"{q} * floor((1 - {threshold}) * least(len + {{band}}, len / {threshold}) + {EPS})"
    return replace(measure, parts=grams(q), may_lack=lack, parts_up_to=LONG_TITLE)


def jaccard(threshold: float) -> Measure:
    """Shared distinct words over all distinct words."""

    def need(sa: Column, sb: Column) -> Column:
        return F.ceil(F.lit(threshold) / (1 + threshold) * (sa + sb) - EPS)

    def score(a: Column, b: Column) -> Column:
        x, y = token_set(a), token_set(b)
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    def screen(a: Column, b: Column) -> Column:
        return score(a, b) >= threshold

    lack = f"size - ceil({threshold} * size - {EPS})"
    return Measure(
        lambda n: F.size(token_set(n)), token_profile, need, screen, score, True, size_step(1 / threshold), parts=token_set, may_lack=lack
    )


MEASURES = {"ratcliff": ratcliff, "levenshtein": levenshtein, "jaccard": jaccard}
