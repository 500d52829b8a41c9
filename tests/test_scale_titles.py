import random

import pytest

from litsieve.functions import similarity as S
from litsieve.operators import fuzzy as Z
from litsieve.session import durable


def test_runs_that_stand_twice_count_twice():
    # Each run of four letters of either text stands in the other, but half as often.
    a, b = "abcd" * 12, "abcd" * 6 + "efgh" * 6
    assert S.lacks_more(a, b, 4, 20, 60) and S._gram_mask(a, 4)[1] > 40


def test_profile_counts_repeats(spark):
    rows = spark.createDataFrame([(1, "abcd" * 12), (2, "abcd")], "ord long, norm string")
    bits = S.gram_profile(rows, 4, "h", S.LONG_WORDS).selectExpr(
        "ord", " + ".join(f"bit_count(h{k})" for k in range(S.LONG_WORDS)) + " AS n"
    )
    got = {r.ord: r.n for r in bits.collect()}
    assert got[2] == 1 and got[1] > 40


@pytest.mark.parametrize("cells", [1 << 22, 3000])
def test_subsequences_side_by_side(monkeypatch, cells):
    monkeypatch.setattr(S, "LETTER_CELLS", cells)
    rng = random.Random(3)
    for letters, lengths in (("ab", (0, 70)), ("abcdefgh ", (60, 200)), ("ab\u00e9\u65e5 xyz", (1, 130)), ("ab", (62, 67))):
        texts = [""] * 4 + ["".join(rng.choices(letters, k=rng.randrange(*lengths))) for _ in range(40)]
        first = [rng.choice(texts) for _ in range(300)]
        second = ["".join(c for c in a if rng.random() > 0.12) if rng.random() < 0.6 else rng.choice(texts) for a in first]
        need = [rng.choice([0.5, 0.8, 0.9]) * (len(a) + len(b)) / 2 for a, b in zip(first, second)]
        want = [S.common_subsequence(a, b, x) >= x for a, b, x in zip(first, second, need)]
        assert S.subsequences_reach(first, second, need).tolist() == want


def test_stated_blocks_copy_no_row_without_bound(spark, monkeypatch):
    rng = random.Random(6)
    titles = ["".join(rng.choices("abcdefgh ", k=40)).strip() for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    measure = S.MEASURES["levenshtein"](0.85)
    reps = durable(Z.representatives(rows, "title", "ord", measure, 20), "titles")
    sides = []
    monkeypatch.setattr(Z, "_near", lambda left, right, *rest: sides.extend([left, right]))
    Z.edges_within(reps, 1500, 0.85, 20, measure, block_rows=4)
    Z.edges_between(reps.filter("ord < 700"), reps.filter("ord >= 700"), 1500, 0.85, 20, measure, block_rows=4)
    copies = [x.count() for x in sides]
    assert sum(copies[:2]) <= 18 * 1500 and sum(copies[2:]) <= 18 * 1500
