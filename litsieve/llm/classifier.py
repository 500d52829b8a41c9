"""Quality classifier learned from positive and unlabelled text.

Trusted documents are positives; a second sample is a mixture whose labels are never
looked at. The non-negative unbiased risk (Kiryo and others, 2017) is minimised,

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]),

with the logistic loss, a linear score and Adam. The class prior is estimated from
the same two samples: a score that is fitted crosswise tells them apart, and the
smallest ratio of the two upper tails bounds the share of positives in the mixture.

Features are counts of byte-class pairs and a few word statistics, made in tasks;
the driver gets the features of the bounded sample only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.llm.common import Words, chunks, mixed, read, small_batches

#: Rows that are taken from the labels at most, for positives and mixture together.
SAMPLE_ROWS = 10_000
CLASSES = 18
_CLASS = np.full(256, 17, np.int64)
_CLASS[range(0x61, 0x7B)] = 0
_CLASS[range(0x80, 0x100)] = 1
_CLASS[range(0x41, 0x5B)] = 2
_CLASS[range(0x30, 0x3A)] = 3
for _i, _c in enumerate(b" \n.,!?#*$%&|\"'"[:13]):
    _CLASS[_c] = 4 + _i
N_FEATURES = CLASSES * CLASSES + 6


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers per text; null and empty texts are alike."""
    out = []
    for _, part in chunks(texts):
        w = Words(part)
        n = len(part)
        kind = _CLASS[w.data]
        pair = kind * CLASSES + np.append(kind[1:], kind[-1])
        pair[w.at[1:] - 1] = kind[-1] * CLASSES + kind[-1]  # not with the next text
        sizes = np.diff(w.at)
        owner = np.repeat(np.arange(n), sizes)
        counts = np.bincount(owner * CLASSES**2 + pair, minlength=n * CLASSES**2).reshape(n, -1)
        shares = counts / sizes[:, None]
        words = np.maximum(w.n, 1)
        h = w.hashes()
        again = np.bincount(w.doc[1:], (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]), minlength=n) if len(h) else np.zeros(n)
        keys = np.sort(h ^ mixed(w.doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(h ^ mixed(w.doc.astype(np.uint64) + np.uint64(1)), kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount(w.doc[order], new, minlength=n)
        mean = np.bincount(w.doc, w.end - w.start, minlength=n) / words
        capital = np.bincount(w.doc, kind[w.start] == 2, minlength=n)
        lines = np.add.reduceat((w.data == 10).astype(np.int64), w.at[:-1])
        more = np.stack(
            [again / words, distinct / words, np.minimum(mean, 30) / 30, capital / words, np.minimum(lines / words, 1), np.log1p(w.n) / 10], 1
        )
        out.append(np.concatenate([np.sqrt(shares), more], 1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES), np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int = 400, decay: float = 1e-3):
    """Weights and bias; without a prior, the two samples are simply told apart."""
    d = xp.shape[1]
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)

    def gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope.astype(np.float32) @ x, slope.sum()) / len(x)

    for t in range(1, steps + 1):
        w = theta[:-1].astype(np.float32)
        sp, su = _sigmoid(xp @ w + theta[-1]), _sigmoid(xu @ w + theta[-1])
        # Gradients of the logistic loss: for + it is s - 1, for - it is s.
        g_plus, g_unl = gradient(xp, sp - 1), gradient(xu, su)
        if prior is None:
            g = g_plus + g_unl
        else:
            g_minus = gradient(xp, sp)
            rest = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
            g = prior * g_plus + g_unl - prior * g_minus if rest >= 0 else prior * g_minus - g_unl
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], theta[-1]


def class_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """Share of positives in the mixture, from scores fitted on the other half."""
    p, u = np.zeros(len(xp)), np.zeros(len(xu))
    for k in (0, 1):
        w, b = _descend(xp[k::2], xu[k::2], None, 200)
        p[1 - k :: 2], u[1 - k :: 2] = xp[1 - k :: 2] @ w + b, xu[1 - k :: 2] @ w + b
    least = np.quantile(p, np.linspace(0.005, 0.5, 50))
    # One standard error above the ratio, against the smallest of many being too small.
    ratios = [(r := min(1.0, np.mean(u >= t) / max(np.mean(p >= t), 1e-9))) + np.sqrt(r * (1 - r) / len(u)) for t in least]
    return float(np.clip(min(ratios), 0.05, 0.98))


def fit(positive: np.ndarray, mixture: np.ndarray) -> Model:
    """Without rows in one of the samples, the model scores every text 0.5."""
    if len(positive) < 2 or len(mixture) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    x = np.concatenate([positive, mixture]).astype(np.float32)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x -= mean
    x /= scale
    np.clip(x, -6, 6, out=x)
    xp, xu = x[: len(positive)], x[len(positive) :]
    prior = class_prior(xp, xu)
    w, b = _descend(xp, xu, prior)
    return Model(mean, scale, w, float(b), prior)


def held_out_rows(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``sample_rows`` documents at most, the same on every run; rows held out are
    never read. Half of them are trusted positives (quality 1); the other half is the
    mixture, drawn from all documents whether labelled or not. An id counts once, with
    the text of the least digest, so no id can bring in more than one row."""
    half = sample_rows // 2
    draw = F.xxhash64("doc_id", F.lit("pu"))
    usable = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out_rows())
    trusted = (
        labels.filter(F.col("doc_id").isNotNull() & ~held_out_rows())
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1")
        .filter(F.pmod(draw, F.lit(2)) == 1).orderBy(draw).limit(half)
        .select(F.col("doc_id").alias("_id"), F.lit(True).alias("trusted"))
    )
    mixture = (
        usable.select("doc_id").distinct().filter(F.pmod(draw, F.lit(2)) == 0).orderBy(draw).limit(half)
        .select(F.col("doc_id").alias("_id"), F.lit(False).alias("trusted"))
    )
    chosen = F.broadcast(trusted.unionByName(mixture))  # ``sample_rows`` numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"trusted": b["trusted"], "x": list(features(list(b["text"])))})

    rows = usable.join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(
        F.first("trusted").alias("trusted"), F.min_by("text", F.xxhash64("text")).alias("text")
    ).select("trusted", "text")
    got = small_batches(rows).mapInPandas(run, "trusted boolean, x array<float>").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    trusted_rows = got.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
    # The order rows arrive in must not matter.
    order = np.lexsort(x.T[::-1])
    return fit(x[order[trusted_rows[order]]], x[order[~trusted_rows[order]]])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``.

    Null and empty texts get the score of an empty text; labels, language, source
    and id are no inputs. Columns named as the two new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = model.score(features(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"]
            )

    return small_batches(docs.select(*kept)).mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out_rows().alias("held_out"), "score", "predicted"
    )


def classify_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, row by row: null texts are judged as empty
    ones, rows of one id each by its own text."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).filter("predicted = 1").select(*docs.columns)
