"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams, for n from 1 to 4, that both hold,
divided by the geometric mean of their own numbers (presence, not frequency; a blended
spectrum). Letters are lower-cased, ASCII that isn't a letter counts as a blank, and runs
of blanks are one. n-grams of one and two bytes are told apart exactly, longer ones by a
hash, so a text is a set of at most ``FEATURES`` numbers.

Nyström: with m landmark texts, K the kernel among them and k(x) that of x with them,
k(x) K^(-1/2) are m coordinates whose products approach the kernel; ridge regression in
them gives one score per language against the rest. A score is then k(x) times a matrix
of m x languages, and k(x) is itself the product of the text's 0/1 row and the landmarks'
rows: both matrices are multiplied once, and a batch of texts is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from litsieve.llm.common import read, small_batches

FEATURES = 1 << 18
#: Texts that the model is fitted on: per language, and in all, at most.
PER_LANGUAGE, SAMPLE_ROWS = 300, 2000
#: Languages that are learned: the most frequent ones.
LANGUAGES = 64
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
#: Bytes of a text that are numbered at once, and texts of one matrix product.
BLOCK, ROWS = 1 << 20, 64

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_EXACT = 256 + 65536
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashed(grams: np.ndarray, n: int) -> np.ndarray:
    x = (grams + np.uint64(n << 40)) * _MULTIPLIER
    return (_EXACT + (x >> np.uint64(32)) % np.uint64(FEATURES - _EXACT)).astype(np.intp)


class Presence:
    """The distinct n-grams of texts, by number."""

    def __init__(self) -> None:
        self.seen = np.zeros(FEATURES, bool)

    def _mark(self, b: np.ndarray) -> None:
        x = b.astype(np.uint64)
        self.seen[b.astype(np.intp)] = True
        for n in (2, 3, 4):
            if len(b) < n:
                return
            x = x[: len(b) - n + 1] << np.uint64(8) | b[n - 1 :]
            self.seen[256 + x.astype(np.intp) if n == 2 else _hashed(x, n)] = True

    def of(self, text: str) -> np.ndarray:
        raw = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
        blank = raw == 0x20
        b = raw[~blank | np.concatenate([[True], ~blank[:-1]])]
        for at in range(0, len(b), BLOCK):
            self._mark(b[at : at + BLOCK + 3])
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    column: np.ndarray  # of a feature in weights, -1 for those that no landmark has
    weights: np.ndarray  # columns x languages
    base: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per language; each row sums up to 1."""
        presence = Presence()
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        x = np.zeros((ROWS, len(self.weights)), np.float32)
        for at in range(0, len(texts), ROWS):
            some = texts[at : at + ROWS]
            for i, t in enumerate(some):
                found = presence.of(t)
                columns = self.column[found]
                x[i, columns[columns >= 0]] = 1 / np.sqrt(len(found))
            out[at : at + len(some)] = x[: len(some)] @ self.weights + self.base
            x[:] = 0
        np.clip(out, 1e-6, 1, out=out)
        return out / out.sum(1, keepdims=True)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Kernel of packed presence rows, in blocks of features."""
    out = np.zeros((len(left), len(right)), np.float32)
    step = 1024
    for at in range(0, left.shape[1], step):
        a, b = (np.unpackbits(x[:, at : at + step], axis=1).astype(np.float32) for x in (left, right))
        out += a @ b.T
    sizes = [np.sqrt(np.bitwise_count(x).sum(1, dtype=np.float64)) for x in (left, right)]
    return (out / np.outer(*sizes)).astype(np.float64)


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From packed presence rows in a fixed order; languages take turns as landmarks."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange(np.sum(y == k))
    chosen = rows[np.lexsort((y, turn))[:landmarks]]
    values, vectors = np.linalg.eigh(kernel(chosen, chosen))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) but for a turn, which ridge doesn't see
    phi = kernel(rows, chosen) @ root
    base = np.full(len(languages), 1 / len(languages))
    # Every language weighs the same.
    weight = 1 / np.bincount(y)[y] * len(y) / len(languages)
    target = (y[:, None] == np.arange(len(languages))) - base
    gram = (phi * weight[:, None]).T @ phi + ridge * len(y) * np.eye(phi.shape[1])
    solved = root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    bits = np.unpackbits(chosen, axis=1)
    used = np.flatnonzero(bits.any(0))
    column = np.full(FEATURES, -1, np.int32)
    column[used] = np.arange(len(used))
    size = np.sqrt(bits.sum(1, dtype=np.float64))
    weights = bits[:, used].T.astype(np.float32) @ (solved / size[:, None]).astype(np.float32)
    return Model(languages, column, weights, base.astype(np.float32))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; rows without an id are not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> DataFrame:
    """At most ``rows`` (lang, text, digest) rows, languages taking turns, the same on
    every run."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("lang", "text").filter(has_letter())
    counts = (
        docs.filter(F.col("lang").isNotNull() & ~held_out()).groupBy("lang").count()
        .orderBy(F.desc("count"), "lang").limit(languages).collect()
    )
    digest = F.xxhash64("text")
    # A draw with some rows to spare, so that few texts are sorted; copies count once.
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], min(1.0, 4 * per_language / r["count"])) for r in counts], F.lit(0.0))
    drawn = known.withColumn("digest", digest).filter(F.pmod("digest", F.lit(1 << 20)) < share * (1 << 20))
    drawn = drawn.dropDuplicates(["lang", "digest", "text"])
    first = F.row_number().over(W.partitionBy("lang").orderBy("digest"))
    return (
        drawn.withColumn("turn", first).filter(F.col("turn") <= per_language)
        .orderBy("turn", "lang", "digest").limit(rows).select("lang", "text", "digest")
    )


def train(docs: DataFrame, **bounds: int) -> Model | None:
    """Fit on ``sample``; of its texts only presence bits reach the driver, at most
    ``FEATURES`` per row. None where no text has a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for b in batches:
            bits = []
            for t in b.column("text").to_pylist():
                row = np.zeros(FEATURES, bool)
                row[presence.of(t)] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("digest"), pa.array(bits, pa.binary())], ["lang", "digest", "bits"]
            )

    rows = small_batches(sample(docs, **bounds)).mapInArrow(run, "lang string, digest long, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["digest"], r["bits"]))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(packed, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    Texts without a letter, empty and null ones get ``und`` and 0, as all do without a
    model. Only the text is read; columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANGUAGES numbers per feature at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            at = np.flatnonzero(b.column("_letters").to_numpy(zero_copy_only=False)) if m else []
            if len(at):
                got = m.scores(b.column("text").take(pa.array(at)).to_pylist())
                best = got.argmax(1)
                scores[at] = got[np.arange(len(at)), best]
                for i, k in zip(at, best, strict=True):
                    names[i] = m.languages[k]
            columns = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], schema.names)

    return small_batches(docs.select(*kept, has_letter().alias("_letters"))).mapInArrow(run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
