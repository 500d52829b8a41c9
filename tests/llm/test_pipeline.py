"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_operators import brute_components, words  # noqa: E402

from litsieve.llm import classifier, decontaminate, mixing, tokens  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_duplicates", "decontamination", "source_mix", "token_files",
    ]


def step(spark, k: int, docs, columns):
    """A stage's rows, and the same as a table for the next one."""
    out = corpus_pipeline.STAGES[k][1](spark, docs, D)
    assert out.columns == columns
    rows = out.collect()
    return rows, spark.createDataFrame(rows, docs.schema)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").limit(160)
    columns, start = docs.columns, docs.collect()
    docs = spark.createDataFrame(start, docs.schema)

    kept, docs = step(spark, 0, docs, columns)
    model = classifier.train(spark.createDataFrame(start, docs.schema), spark.read.parquet(f"{D}/labels.parquet"))
    good = model.score(classifier.features([r["text"] for r in start])) >= 0.3
    assert sorted(r["doc_id"] for r in kept) == [r["doc_id"] for r, g in zip(start, good, strict=True) if g]

    before = sorted(kept, key=lambda r: r["doc_id"])
    kept, docs = step(spark, 1, docs, columns)
    group, _ = brute_components([r["text"] for r in before])
    assert sorted(kept, key=lambda r: r["doc_id"]) == [r for i, r in enumerate(before) if group[i] == i]

    before = kept
    kept, docs = step(spark, 2, docs, columns)
    plain = lambda t: decontaminate.plain(np.frombuffer(t.encode() + b" ", np.uint8))[0].tobytes().strip()
    bench = [plain(r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in before if not any(b in plain(r["text"]) for b in bench)}
    assert {r["doc_id"] for r in kept} == clean  # these tables hold items as they are

    before = {r["doc_id"]: r for r in kept}
    kept, docs = step(spark, 3, docs, columns)
    sizes = {i: len(words(r["text"])) for i, r in before.items()}
    sources = sorted({r["source"] for r in before.values()})
    totals = {s: sum(n for i, n in sizes.items() if before[i]["source"] == s) for s in sources}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    targets, left, free = {}, 1.5 * sum(totals.values()), set(sources)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * totals[s]}
        if not over:
            targets |= {s: level * weights[s] for s in free}
            break
        targets |= {s: 2 * totals[s] for s in over}
        left -= sum(2 * totals[s] for s in over)
        free -= over
    taken = dict.fromkeys(sources, 0)
    for r in kept:
        taken[r["source"]] += len(words(r["text"]))
        assert before[r["doc_id"]]["text"].startswith(r["text"])
    assert all(abs(taken[s] - targets[s]) < 1.5 for s in sources)

    out = corpus_pipeline.STAGES[4][1](spark, docs, D).orderBy("start").collect()
    coded = {}
    for r, e in zip(kept, tokens.tokenizer(None).encode_batch([r["text"] for r in kept], add_special_tokens=False), strict=True):
        coded.setdefault(r["doc_id"], []).append(zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes()))
    at, seen = 0, {}
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append(r["ids_crc32"])
    assert list(seen) == sorted(seen)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in coded.items()}


def test_empty_input(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0


def test_quality_weights(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "###"), (3, ""), (4, None)], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(mixing.quality_weight(df["text"])).collect()]
    assert got == [1.5, 0.5, 0.5, 0.5]
