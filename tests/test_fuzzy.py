import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from litsieve.functions.similarity import MEASURES, common_subsequence
from litsieve.functions.text import normalise_title
from litsieve.operators import fuzzy as Z
from litsieve.session import durable

WORDS = "data driven design by analogy the of case based reasoning review method for a".split()


def py_norm(text):
    if text is None:
        return ""
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(metric, a, b):
    if not a or not b:
        return 0.0
    if metric == "ratcliff":
        return SequenceMatcher(None, a, b).ratio()
    if metric == "levenshtein":
        return 1 - edit_distance(a, b) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def brute(rows, metric, threshold):
    """Every row against the earlier kept rows, in order."""
    kept, out = [], {}
    for key, title in sorted(rows):
        norm = py_norm(title)
        for lead, other in kept:
            if abs(len(norm) - len(other)) <= 20:
                s = score(metric, other, norm)
                if s >= threshold:
                    out[key] = (lead, round(s, 9))
                    break
        else:
            kept.append((key, norm))
    return out


def titles(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(t)) if t else 0
                kind = rng.random()
                if kind < 0.4:
                    t[at : at + 1] = rng.choice("abcdé ")
                elif kind < 0.7:
                    t.insert(at, rng.choice("xyz-"))
                else:
                    del t[at : at + 1]
            out.append("".join(t))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))))
    long = "".join(rng.choice("etaoin shrdlu") for _ in range(230))
    out += [long, "z" + long[1:], long[:100] + long[104:], "", None, "!!!", "日本 語 の", "日本 語 x"]
    rng.shuffle(out)
    keys = rng.sample(range(10 * len(out)), len(out))
    return list(zip(keys, out))


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "ord long, title string").repartition(parts)


def matches(spark, rows, **options):
    got = Z.fuzzy_matches(frame(spark, rows), **options).collect()
    return {r.member: (r.leader, round(r.similarity, 9)) for r in got}


@pytest.mark.parametrize("metric,threshold", [
    ("ratcliff", 0.8), ("ratcliff", 0.85), ("ratcliff", 0.95), ("levenshtein", 0.85), ("jaccard", 0.6),
])
def test_equals_brute_force(spark, metric, threshold):
    rows = titles(int(threshold * 100), 150)
    assert matches(spark, rows, metric=metric, threshold=threshold) == brute(rows, metric, threshold)


@pytest.mark.parametrize("edges_per_row", [0, 1, 4])
def test_prefix_steps_and_small_blocks_change_nothing(spark, edges_per_row):
    rows = titles(5, 110)
    sizes = {"block_rows": 7, "probe_rows": 25, "edges_per_row": edges_per_row}
    got = matches(spark, rows, threshold=0.85, hot_rows=2, **sizes)
    assert got == brute(rows, "ratcliff", 0.85)


@pytest.mark.parametrize("metric,threshold", [("ratcliff", 0.95), ("levenshtein", 0.85), ("jaccard", 0.6)])
def test_shared_part_route_finds_the_same(spark, metric, threshold):
    rows = titles(8, 120) + [(9000 + i, "ab" * i) for i in range(1, 12)]
    want = brute(rows, metric, threshold)
    plain = {"metric": metric, "threshold": threshold, "route": "parts"}
    assert matches(spark, rows, **plain) == want
    steps = {"hot_part": 5, "probe_rows": 60, "edges_per_row": 1, "block_rows": 9}
    assert matches(spark, rows, **plain, **steps) == want


def test_many_near_copies_form_no_pairs_of_copies(spark):
    base = "a long title that very many records share word by word"
    rows = [(i, base + f" {i % 97:02d}{'abcdefghij'[i // 97 % 10]}") for i in range(600)]
    assert len({t for _, t in rows}) == 600
    got = matches(spark, rows, threshold=0.85, probe_rows=40, edges_per_row=4)
    assert {lead for lead, _ in got.values()} == {0} and len(got) == 599


def test_argument_order_and_tag_prefix(spark):
    assert score("ratcliff", "tide", "diet") == 0.25
    assert matches(spark, [(1, "diet"), (2, "tide")], threshold=0.5) == {2: (1, 0.5)}
    assert matches(spark, [(2, "diet"), (1, "tide")], threshold=0.5) == {}
    pair = [(1, "Case-based reasoning"), (2, "[BOOK][B]Case-based reasoning")]
    assert round(matches(spark, pair, threshold=0.85)[2][1], 3) == 0.851
    assert matches(spark, pair, threshold=0.95) == {}


def test_length_band_is_part_of_the_meaning(spark):
    a = "abcdefghij" * 19
    assert list(matches(spark, [(1, a), (2, a + "k" * 20)], threshold=0.9)) == [2]
    assert matches(spark, [(1, a), (2, a + "k" * 21)], threshold=0.9) == {}


def test_chain_keeps_its_end_and_star_has_one_leader(spark):
    chain = [(1, "aaaaaaaaaabbbbbbbbbb"), (2, "aaaaaaaaaabbbbbbbbcc"), (3, "aaaaaaaaaabbbbbbcccc")]
    assert matches(spark, chain, threshold=0.9) == {2: (1, 0.9)}
    star = [(1, "a fine title here")] + [(i, f"a fine title her{c}") for i, c in enumerate("xyz", 2)]
    assert {m: l for m, (l, _) in matches(spark, star, threshold=0.9).items()} == {2: 1, 3: 1, 4: 1}


def test_long_chain_of_decisions(spark):
    edges = durable(
        spark.createDataFrame([(i, i + 1, 0.9) for i in range(9)], "lo long, hi long, similarity double"),
        "edges",
    )
    assert sorted((r.hi, r.lo) for r in Z.leaders(edges).collect()) == [(i + 1, i) for i in range(0, 9, 2)]


def test_no_pairs_gives_the_input(spark):
    rows = [(1, "alpha beta"), (2, "something else"), (3, None), (4, "")]
    assert sorted(r.ord for r in Z.fuzzy_dedup(frame(spark, rows)).collect()) == [1, 2, 3, 4]
    empty = frame(spark, rows).filter("false")
    assert Z.fuzzy_dedup(empty).count() == 0


def test_comparison_count(spark):
    rows = titles(4, 60)
    taken, compared = set(), 0
    ordered = [(k, py_norm(t)) for k, t in sorted(rows)]
    for i, (k, a) in enumerate(ordered):
        if k in taken:
            continue
        for m, b in ordered[i + 1 :]:
            if m not in taken and abs(len(a) - len(b)) <= 20:
                compared += 1
                if score("ratcliff", a, b) >= 0.85:
                    taken.add(m)
    df = frame(spark, rows)
    hits = durable(Z.fuzzy_matches(df, threshold=0.85), "matches")
    for ranges in (1, 2, 7):
        assert Z.comparison_count(df, hits, ranges=ranges).first()[0] == compared


def test_scored_pairs(spark):
    rows = [(1, "aaaaaaaaaa"), (2, "aaaaaaaaab"), (3, "aaaaaaaabb"), (4, "zz")]
    got = {(r.lo, r.hi): r.similarity for r in Z.scored_pairs(frame(spark, rows), threshold=0.8).collect()}
    assert got == {(1, 2): 0.9, (1, 3): 0.8, (2, 3): 0.9}


def test_pairs_and_tags(spark):
    rows = [(1, "Case-based design"), (2, "Case based design!"), (3, "other")]
    pair = Z.similar_pairs(frame(spark, rows), threshold=0.9).first()
    assert (pair.ord1, pair.ord2, pair.title1, pair.similarity) == (1, 2, "Case-based design", 1.0)
    tags = {r.ord: (r.is_duplicate, r.leader_id) for r in Z.fuzzy_tags(frame(spark, rows)).collect()}
    assert tags == {1: (False, None), 2: (True, 1), 3: (False, None)}


def test_normalise(spark):
    cases = ['A–B: "C"', "x_y", "²", "  a \t b ", None, "Ünï 日本", "...", "É-é"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.n for r in df.select(normalise_title(F.col("t")).alias("n")).collect()]
    assert got == [py_norm(c) for c in cases]


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in "xy")
        assert common_subsequence(a, b) == plain(a, b)


def test_plan_has_no_nested_loop(spark):
    rows = frame(spark, titles(1, 40))
    measure = MEASURES["ratcliff"](0.85)
    reps = durable(Z.representatives(rows, "title", "ord", measure, 20), "titles")
    plan = Z.edges_within(reps, 40, 0.85, 20, measure)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def greedy(edges: list[tuple]) -> dict[int, int]:
    """Dropped rows and their leaders, one row after another."""
    before, gone = {}, {}
    for lo, hi in edges:
        before.setdefault(hi, []).append(lo)
    for hi in sorted(before):
        kept = [lo for lo in before[hi] if lo not in gone]
        if kept:
            gone[hi] = min(kept)
    return gone


@pytest.mark.parametrize("component_edges", [2_000_000, 30])
def test_leaders_of_any_graph(spark, component_edges):
    rng = random.Random(component_edges)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(260)} | {(400 + i, 401 + i) for i in range(40)}
    table = durable(spark.createDataFrame([(lo, hi, 0.9) for lo, hi in edges], "lo long, hi long, similarity double"), "edges")
    got = {r.hi: r.lo for r in Z.leaders(table, component_edges).collect()}
    assert got == greedy(list(edges))


def test_long_chain_takes_few_tables(spark, monkeypatch):
    n, written = 10_000, []
    edges = durable(spark.range(n).selectExpr("id AS lo", "id + 1 AS hi", "0.9D AS similarity"), "chain")
    monkeypatch.setattr(Z, "durable", lambda df, name: written.append(name) or durable(df, name))
    got = Z.leaders(edges).collect()
    assert sorted((r.hi, r.lo) for r in got) == [(i + 1, i) for i in range(0, n, 2)]
    assert len(written) < 60


@pytest.mark.parametrize("metric", ["ratcliff", "levenshtein"])
def test_gram_bound_holds(spark, metric):
    """No pair that reaches the threshold has more lost pairs of letters than the bound."""
    rng = random.Random(6)
    rows, pairs = [], []
    for k in range(300):
        a = "".join(rng.choices("abcde ", k=rng.randrange(1, 40))).strip() or "a"
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        rows += [(2 * k, a), (2 * k + 1, "".join(b).strip() or "b")]
        pairs.append((2 * k, 2 * k + 1))
    for threshold in (0.6, 0.85):
        measure = MEASURES[metric](threshold)
        df = spark.createDataFrame(rows, "ord long, norm string").withColumn("len", F.length("norm"))
        df = Z.gram_profile(df.withColumn("size", F.col("len")))
        l = df.select(*[F.col(c).alias(f"l_{c}") for c in df.columns])
        r = df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])
        lost = [measure.grams_lost.format(x=f"{x}_len", y=f"{y}_len") for x, y in ("lr", "rl")]
        tests = [F.expr(f"{Z.bits_missing(x, y, 'g', Z.GRAM_WORDS)} <= {e}") for (x, y), e in zip(("lr", "rl"), lost)]
        both = l.join(r, F.col("l_ord") + 1 == F.col("r_ord")).filter("l_ord % 2 = 0")
        for x in both.select("l_norm", "r_norm", (tests[0] & tests[1]).alias("passes"), measure.screen(F.col("l_norm"), F.col("r_norm")).alias("s")).collect():
            if score(metric, x.l_norm, x.r_norm) >= threshold:
                assert x.passes and x.s, (x.l_norm, x.r_norm)


def test_texts_stay_out_of_the_fan_out(spark):
    rows = frame(spark, titles(3, 60))
    measure = MEASURES["levenshtein"](0.85)
    reps = durable(Z.representatives(rows, "title", "ord", measure, 20), "titles")
    plan = Z.edges_within(reps, 60, 0.85, 20, measure, route="blocks")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Generate" in line or "RepartitionByExpression" in line or "explode" in line:
            assert "norm" not in line, line
