"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of bytes other than blank, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df`` as it is, with Arrow batches of ``rows`` rows at most.

    Very long texts then can't add up to a batch that a task has no memory for. The
    setting is the session's: the last call before an action holds for its whole plan.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` gets the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end)."""
    inverse = powers(len(prefix))[1]
    size = (end - start).astype(np.uint64)
    return mixed((prefix[end] - prefix[start]) * inverse[start] + size)


def run_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` successive values; ``len(values) - k + 1`` of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _P + values[j : j + n]
    return mixed(out)


class Words:
    """The words of some texts, as positions in one buffer.

    ``start``, ``end``: byte offsets in ``data``; ``doc``: index of the text;
    ``first``: index of each text's first word, with one more at the end.
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.buffer, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        gap = _WS[self.data]
        edge = np.diff(np.concatenate([[True], gap]).view(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.start, self.at)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)

    def whole(self, k: int) -> np.ndarray:
        """Which windows of ``k`` words, by first word, lie in one text."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) for stretches of about ``limit`` bytes."""
    held: list[bytes] = []
    size = at = 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= limit:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a stretch [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.subtract.at(step, end, 1)
    return np.cumsum(step[:-1]) > 0
