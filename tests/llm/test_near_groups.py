import random

import numpy as np
import pytest

from litsieve.llm import sketch_join


@pytest.mark.parametrize("block", [4, 64])
def test_members_of_a_shared_passage_are_compared_by_all_bits(spark, block):
    """Pairs of near copies that show the pieces of one long passage which they all have: the
    group's first member is like none of the others, so the pairs meet in the second pass."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(200)]
    docs, pair = [], {}
    for k in range(20):
        own = passage + [word() for _ in range(300)]
        near = list(own)
        for at in rng.sample(range(200, 500), 6):
            near[at] = word()
        pair[len(docs)] = pair[len(docs) + 1] = len(docs)
        docs += [own, near]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in sketch_join.near_duplicates(frame, block=block).collect()}
    assert got == pair


def test_all_64_bits_of_a_word_count():
    left = np.array([[-1, 0], [-(2**63), 1], [5, 5]], np.int64)
    right = np.array([[0, 0], [3, -2]], np.int64)
    want = [[bin((int(a) ^ int(b)) % 2**64).count("1") + bin((int(c) ^ int(d)) % 2**64).count("1") for b, d in right] for a, c in left]
    assert sketch_join.bits_apart(left, right).tolist() == want
