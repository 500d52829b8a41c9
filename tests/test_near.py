import random

import numpy as np
import pytest

from litsieve.functions import near
from litsieve.functions.similarity import MEASURES, edit_distance, edit_distances
from litsieve.plans.screening import fuzzy_report
from test_fuzzy import edit_distance as plain_distance, frame, matches, py_norm, score


def cut_titles(seed, n):
    """Titles of 60 to 300 letters, and copies that lack up to a quarter of them."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlucmfwyp", k=rng.randint(2, 9))) for _ in range(60)] + ["zq", "kjx", "é", "日本"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            t = rng.choice(out)
            at, size = rng.randrange(len(t)), rng.randrange(1 + len(t) // 4)
            out.append(rng.choice([t[:at] + t[at + size :], t[size:], t + " " + t[:size]]))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(10, 45))))
    return list(enumerate(out))


def brute(rows, metric, threshold):
    kept, out = [], {}
    for key, title in rows:
        norm = py_norm(title)
        for lead, other in kept:
            if min(len(norm), len(other)) > 0.3 * max(len(norm), len(other)) and (s := score(metric, other, norm)) >= threshold:
                out[key] = (lead, round(s, 9))
                break
        else:
            kept.append((key, norm))
    return out


@pytest.mark.parametrize("metric,threshold", [("ratcliff", 0.85), ("levenshtein", 0.8), ("jaccard", 0.7)])
def test_without_a_band_all_lengths_are_compared(spark, metric, threshold):
    rows = cut_titles(3, 90)
    want = brute(rows, metric, threshold)
    length = {k: len(py_norm(t)) for k, t in rows}
    assert any(abs(length[k] - length[lead]) > 20 for k, (lead, _) in want.items())
    assert matches(spark, rows, metric=metric, threshold=threshold, band=None) == want
    sizes = {"block_rows": 9, "probe_rows": 30, "edges_per_row": 1}
    assert matches(spark, rows, metric=metric, threshold=threshold, band=None, **sizes) == want


def test_without_a_band_on_parts(spark):
    rows = cut_titles(4, 60) + [(1000 + i, t[:70] if i % 2 else t[:70 - i % 4]) for i, t in cut_titles(5, 40)]
    want = brute(rows, "ratcliff", 0.95)
    assert len(want) > 9 and matches(spark, rows, threshold=0.95, band=None, route="parts") == want


def test_report_without_a_band_counts_all_comparisons(spark):
    rows = [(1, "a" * 50), (2, "b" * 90), (3, "c" * 10), (4, "a" * 50)]
    got = fuzzy_report(frame(spark, rows), threshold=0.9, band=None).first()
    assert (got.comparisons, got.removed) == (4, 1)  # 1 with 2, 3, 4 and 2 with 3


def test_query_compares_titles_of_any_length(spark, tmp_path):
    import __spark_entry__ as entry

    text = "xylophone jazz quickly vexed " * 6
    rows = [(0, "en", "s", text), (1, "en", "s", text[: len(text) - 40]), (2, "en", "s", "other")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["fuzzy_dedup_ratcliff"](spark, str(tmp_path)).collect()
    assert sorted(r.ord for r in got) == [0, 2]


def edited(rng, text, alphabet, most):
    out = list(text)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = rng.choice(["", "", rng.choice(alphabet), "xyz"])
    return "".join(out)


@pytest.mark.parametrize("metric,threshold,band", [
    ("ratcliff", 0.85, None), ("ratcliff", 0.95, 20), ("ratcliff", 0.7, None), ("levenshtein", 0.85, 20), ("levenshtein", 0.6, None),
])
def test_tiles_find_the_pairs_of_the_nested_loop(spark, monkeypatch, metric, threshold, band):
    monkeypatch.setattr(near, "TILE", (16, 32))
    monkeypatch.setattr(near, "PAIRS_AT_ONCE", 50)
    rng = random.Random(7)
    # Long titles have letters that may begin no block, and rare ones that may.
    alphabets = ["ab ", "etaoinshrdlu ", "abcdefghijklmnopqrstuvwxyzéü日本 ", "e" * 40 + "tqz "]
    texts = []
    for k in range(120):
        alphabet = alphabets[k % 4]
        base = "".join(rng.choices(alphabet, k=rng.choice([3, 30, 64, 150, 199, 201, 260])))
        texts += [base, edited(rng, base, alphabet, rng.choice([1, 6, 25]))]
    texts = [t for t in dict.fromkeys(texts) if t]
    rng.shuffle(texts)
    bounds = MEASURES[metric](threshold).bounds
    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[i + 1 :], i + 1):
            if band is None or abs(len(a) - len(b)) <= band:
                if 2 * min(len(a), len(b)) >= threshold * max(len(a), len(b)) and (s := score(metric, a, b)) >= threshold - 1e-12:
                    want[i, j] = s
    rank = np.arange(len(texts))
    one = near.Side(texts, rank)
    found = near.near_pairs(one, near.Side(texts, rank), bounds, band, True)
    assert {(int(one.order[i]), int(one.order[j])): s for x in found for i, j, s in zip(*x)} == pytest.approx(want)
    two = [near.Side([texts[k] for k in part], rank[part]) for part in (rank[::3], rank[rank % 3 > 0])]
    found = {tuple(sorted((two[0].rank[i], two[1].rank[j]))) for x in near.near_pairs(*two, bounds, band, False) for i, j, _ in zip(*x)}
    assert found == {(i, j) for i, j in want if (i % 3 == 0) != (j % 3 == 0)}


def test_edit_distances():
    rng = random.Random(1)
    for alphabet, least, most in (("ab", 0, 9), ("abcdefé日 ", 50, 140), ("abc", 60, 66)):
        first = ["".join(rng.choices(alphabet, k=rng.randrange(least, most))) for _ in range(150)]
        second = [edited(rng, a, alphabet, 12) if rng.random() < 0.7 else rng.choice(first) for a in first]
        want = [plain_distance(a, b) for a, b in zip(first, second)]
        assert edit_distances(first, second).tolist() == want == [edit_distance(a, b) for a, b in zip(first, second)]
