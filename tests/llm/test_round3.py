"""Language identification, conversation repair and tokenizer alignment."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fixtures as X  # noqa: E402

from litsieve.llm import alignment, langid, repair  # noqa: E402

# Alignment -------------------------------------------------------------------

ODD_TEXTS = [
    "hello <|endoftext|> world", "<s> x </s> <0x41>", "a▁b c", "▁", " ", "  two  blanks ", "tail ", "\n lead",
    "a\x00b\x01 c", "no break　wide x", "I'll don't we've", "ﬁne é é", "x" * 900, "ab" * 500,
    "日本語のテキスト。 次の文", "🙂🙂 🙂", "a\r\n\r\nb\t\tc", "ЧЕРЕЗ поле", "   y", "\u0085z", "-- -- ==== ====",
]


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    """(n_a, n_b, links, groups) of each text, tokenised whole; None without tokens."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def ends(pieces: list[bytes]) -> list[int]:
        return list(itertools.accumulate(map(len, pieces)))

    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        pieces_a = [a.decode([i]).encode() for i in ids_a]
        if any(b"\xef\xbf\xbd" in p for p in pieces_a):  # parts of characters: by the alphabet
            alphabet = {c: n for n, c in enumerate(byte_alphabet())}
            pieces_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        pieces_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
        whole = (" " + t).encode()
        if b"".join(pieces_a) != whole or b"".join(pieces_b) != whole:
            out.append(None)
            continue
        ends_a, ends_b = ends(pieces_a), ends(pieces_b)
        links, groups, i, j = Counter(), [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            links.update(itertools.product(ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        out.append((len(ids_a), len(ids_b), links, groups))
    return out


def byte_alphabet() -> list[str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@pytest.mark.parametrize("chunk_bytes", [8_000_000, 300])
def test_alignment_against_whole_texts(spark, chunk_bytes):
    texts = X.texts() + ODD_TEXTS + ODD_TEXTS[:4] * 3
    expected = brute_alignment(texts)
    docs = Counter(p for e in expected if e for p in e[2])
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.measures(X.table(spark, texts), chunk_bytes=chunk_bytes).collect()}
    assert len(got) == len(texts)
    for i, e in enumerate(expected):
        if e is None:
            assert got[i] == (0, 0, 0, 0, 0, 0, ""), texts[i]
            continue
        best = sum(n for (a, b), n in e[2].items() if docs[a, b] == highest[a])
        summed = sum(n * docs[p] for p, n in e[2].items())
        digest = hashlib.sha256(";".join(e[3]).encode()).hexdigest()
        assert got[i] == (e[0], e[1], len(e[3]), sum(e[2].values()), best, summed, digest), texts[i]


def test_groups_are_the_texts(spark):
    texts = [None, ""] + ODD_TEXTS
    got = {r["doc_id"]: r["groups"] for r in alignment.groups(X.table(spark, texts)).collect()}
    assert got == {i: ";".join(e[3]) if e else "" for i, e in enumerate(brute_alignment(texts))}


def test_wide_groups_are_counted(monkeypatch):
    a, b = alignment.side_a(None), alignment.side_b(None)
    units = [(" " + t).encode() for t in ("x" * 90, "antidisestablishment", "日本語のテキスト")]
    plain = alignment.Units(units, a, b)
    monkeypatch.setattr(alignment, "WIDE", 0)
    counted = alignment.Units(units, a, b)

    def lines(u: alignment.Units) -> list[Counter]:
        out, at = [], 0
        for n in u.lines.tolist():
            c = Counter()
            for p, k in zip(u.pair[at : at + n].tolist(), u.times[at : at + n].tolist()):
                c[p] += k
            out.append(c)
            at += n
        return out

    assert lines(plain) == lines(counted)
    assert plain.shown == counted.shown and plain.n_shown.tolist() == counted.n_shown.tolist()


def test_alignment_forgets(monkeypatch, spark):
    whole = [r for r in brute_alignment(X.texts()) if r]
    monkeypatch.setattr(alignment, "MEMO_BYTES", 0)
    known = alignment.Memo(alignment.side_a(None), alignment.side_b(None))
    texts = [t.encode() for t in X.texts() if t]
    for _ in range(2):
        for t, e in zip(texts, whole, strict=True):
            row = alignment._chunk([t], np.ones(1, np.int64), known)
            assert (row["n_a"][0], row["n_b"][0], row["n_links"][0]) == (e[0], e[1], sum(e[2].values()))


def test_alignment_of_odd_tables(spark):
    assert alignment.measures(X.no_rows(spark)).collect() == []
    assert [tuple(r) for r in alignment.measures(X.all_null(spark)).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 3
    docs = X.table(spark, X.texts()[:12], repeat=True)
    got = [tuple(r) for r in alignment.measures(docs).collect()]
    assert len(got) == 15
    one = [r[1:] for r in got if r[0] == 3]
    assert len(one) == 3 and len(set(one)) == 1
    assert next(r[1:] for r in got if r[0] is None) == next(r[1:] for r in got if r[0] == 7)
    # "one" stands in four documents, as itself three times
    assert one[0][5] >= 4 * one[0][3]


# Repair ----------------------------------------------------------------------


def faults(rows: list[tuple]) -> list[tuple[bool, bool, bool]]:
    """(blank, duplicate, truncated) of (turn, role, text) rows in order."""
    out, seen = [], set()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        blank = not shown
        duplicate = not blank and (role, text) in seen
        out.append((blank, duplicate, not blank and not duplicate and shown[-1] not in ".!?"))
        seen.add((role, text))
    return out


def brute_repair(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """All audits with up to two inserts before each row and at the end."""
    marks, found = faults(rows), []
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any((m[0] or m[1]) and x != "D" for m, x in zip(marks, letters)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + x for n, x in zip(inserts, [*letters, ""]))
            cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in audit)
            cost += sum(5 for m, x in zip(marks, letters) if m[2] and x != "D")
            kept = [(r, x) for (r, x) in zip([*rows, None], [*letters, None])]
            slots: list[tuple[str, str]] = []  # (fixed role or '', text)
            for n, (row, x) in zip(inserts, kept):
                slots += [("", "")] * n
                if x in ("K", "R"):
                    slots.append((row[1] if x == "K" else "", row[2]))
            for first in ("s", "u"):
                if first == "s" and not (slots and slots[0][0][:1] == "s"):
                    continue
                want = (["s"] if first == "s" else []) + ["u", "a"] * len(slots)
                if (len(slots) - (first == "s")) % 2 or first == "s" and len(slots) == 1:
                    continue
                if all(not role or role[0] == w for (role, _), w in zip(slots, want)):
                    full = {"u": "user", "a": "assistant"}
                    found.append((cost, audit, [f"{role or full[w]}:{text}" for (role, text), w in zip(slots, want)]))
    return min(found)


def conversations(seed: int, n: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "umpire"]
    texts = ["Yes.", "No", "", " \t", "Why?", "well…", "x!", "Go. "]
    return [
        (c, t, rng.choice(roles), rng.choice(texts))
        for c in range(n)
        for t in sorted(rng.sample(range(9), rng.randrange(1, longest + 1)))
    ]


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment_rows", [4096, 1, 2])
def test_repair_against_all_audits(spark, segment_rows):
    rows = conversations(5, 40, 4)
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, CONVERSATION), segment_rows).collect()}
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = [r[1:] for r in group]
        cost, audit, kept = brute_repair(group)
        r = got[conv]
        assert (r["cost"], r["audit"]) == (cost, audit), group
        assert r["digest"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        marks = faults(group)
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(map(sum, zip(*marks)))
        pairs = zip(group, group[1:])
        assert r["illegal"] == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in pairs)
        turns = [t for t, *_ in group]
        assert r["gaps"] == max(turns) - min(turns) + 1 - len(set(turns))


def test_segments_do_not_show(spark):
    rows = conversations(9, 12, 9) + [(99, t, "user" if t % 3 else "assistant", f"t{t % 7}.") for t in range(400)]
    df = spark.createDataFrame(rows, CONVERSATION)
    whole = sorted(map(tuple, repair.repaired_all(df.repartition(1)).collect()))
    assert len(whole) == 13
    assert sorted(map(tuple, repair.repaired_all(df.repartition(6), 3).collect())) == whole


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, None, None), (1, 5, "", "So."),
        (None, 0, "user", "A."), (None, 1, "assistant", "B."), (2, None, None, None), (3, 2**60, "system", "S."),
    ]
    got = {r["conv_id"]: tuple(r)[1:-1] for r in repair.repair(spark.createDataFrame(rows, CONVERSATION)).collect()}
    assert got[1][:6] == (0, 1, 1, 0, 3, 5) and got[1][6] in ("KDDR", "KDRD")  # the last two share a turn
    assert got[None] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[2] == (0, 1, 0, 0, 0, 2, "D")
    assert got[3] == (0, 0, 0, 0, 0, 2, "D")
    none = spark.createDataFrame([], CONVERSATION)
    assert repair.repair(none).collect() == [] == repair.repaired_all(none).collect()
    clashing = spark.createDataFrame([(1, 0, "user", "A.", 1, "x", 2)], CONVERSATION + ", place long, key string, c long")
    assert repair.repaired_all(clashing).count() == 1


def test_damage_by_remainder(spark):
    rows = [(c, t, "assistant", "Ab. c!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in repair.damage(spark.createDataFrame(rows, CONVERSATION)).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"]))
    for c, t, *_ in rows[:-1]:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = ("user" if k == 4 else "assistant", {1: "", 2: "Ab c"}.get(k, "Ab. c!"))
        assert got[c, t] == [row] * {0: 0, 3: 2}.get(k, 1)
    k = zlib.crc32(b" : ") % 20
    assert got[None, None] == [("user" if k == 4 else " ", "" if k == 1 else " ")] * {0: 0, 3: 2}.get(k, 1)


@pytest.mark.parametrize("mod", [repair.Audits.MOD, 1, 7])
def test_audits_compare_as_strings(monkeypatch, mod):
    monkeypatch.setattr(repair.Audits, "MOD", mod)  # 1: all hashes are equal
    rng, tree = random.Random(3), repair.Audits()
    made = {"": 0}
    for _ in range(300):
        base = rng.choice(list(made))
        more = base + rng.choice("DIKR")
        made[more] = tree.extend(made[base], more[-1])
    names = rng.sample(list(made), 120)
    for a, b in itertools.combinations(names, 2):
        assert tree.less(made[a], made[b]) == (a < b)
        assert tree.text(made[a]) == a


# Language --------------------------------------------------------------------

STEMS = {
    "aa": ["kola", "mira", "tano", "sulo", "pari", "Ñeko"],
    "bb": ["strum", "brend", "gwilt", "hrosk", "Übrig", "ploft"],
    "cc": ["xiqo", "zaqu", "quix", "jaxo", "vozy", "ïzaq"],
}


def speech(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        text = " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "n", "s"]) for _ in range(rng.randrange(3, 40)))
        out.append((i, text, lang))
    return out


DOCS = "doc_id long, text string, lang string"


def grams(text: str) -> set[int]:
    return set(langid.Presence().of(text).tolist())


def test_presence_is_a_set_of_grams():
    assert grams("Ab, ab!  AB") == grams("ab ab")
    assert grams("") == grams("123 !") != grams("a")
    text = "".join(random.Random(1).choices("abcdef ", k=5000))
    whole = langid.Presence().of(text)
    one = langid.BLOCK
    try:
        langid.BLOCK = 7
        assert (langid.Presence().of(text) == whole).all()
    finally:
        langid.BLOCK = one
    plain = re.sub(" +", " ", f" {text} ").encode()
    exact = {plain[i : i + n] for n in (1, 2, 3, 4) for i in range(len(plain) - n + 1)}
    assert len(whole) <= len(exact) <= len(whole) * 1.02


def test_scores_are_the_kernel_regression():
    """Against kernels of Python sets and ridge regression on explicit coordinates."""
    data = speech(2, 60)
    sets = [grams(t) for _, t, _ in data]
    rows = np.zeros((60, langid.FEATURES), bool)
    for i, s in enumerate(sets):
        rows[i, list(s)] = True
    packed = np.packbits(rows, axis=1)
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    assert np.allclose(langid.kernel(packed, packed), k, atol=1e-6)

    labels = [x[2] for x in data]
    model = langid.fit(packed, labels, landmarks=60)
    # With every row a landmark, Nyström is the kernel itself: plain kernel ridge regression.
    y = np.array([[x == c for c in model.languages] for x in labels], float)
    weight = 1 / y.sum(0)[y.argmax(1)] * 60 / 3
    alpha = np.linalg.solve(k * weight[:, None] + langid.RIDGE * 60 * np.eye(60), weight[:, None] * (y - 1 / 3))
    new = [t for _, t, _ in speech(7, 80)]
    wanted = np.array([[len(grams(t) & s) / (len(grams(t)) * len(s)) ** 0.5 for s in sets] for t in new]) @ alpha + 1 / 3
    wanted = np.clip(wanted, 1e-6, 1)
    assert np.allclose(model.scores(new), wanted / wanted.sum(1, keepdims=True), atol=5e-3)


def test_held_out_accuracy(spark):
    data = speech(11, 600)
    docs = spark.createDataFrame(data, DOCS)
    got = langid.predict(docs, langid.train(docs)).select("*", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["h"]]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    # Labels of rows held out, sources and ids change nothing.
    other = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else g) for i, t, g in data], DOCS)
    again = {r["doc_id"]: r["lang_pred"] for r in langid.predict(other, langid.train(other)).collect()}
    assert again == {r["doc_id"]: r["lang_pred"] for r in got}


def test_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame(speech(4, 500) + [(0, "kola kola", "aa")] * 2000, DOCS)
    got = langid.sample(docs, per_language=20, rows=50).collect()
    assert 35 <= len(got) <= 50 and max(Counter(r["lang"] for r in got).values()) <= 20
    assert len({r["text"] for r in got}) == len(got)
    again = langid.sample(docs.repartition(7), per_language=20, rows=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r["lang"] for r in langid.sample(docs, languages=1).collect()} == {"aa"}


def test_language_of_odd_tables(spark):
    assert langid.train(X.no_rows(spark)) is None and langid.train(X.all_null(spark)) is None
    assert langid.predict(X.no_rows(spark), None).collect() == []
    docs = spark.createDataFrame(speech(1, 90), DOCS)
    model = langid.train(docs)
    odd = X.table(spark, [None, "", " 12 34 !", "kolas mira tano", "strum brend " * 20_000, "Ω"], repeat=False)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "aa", "bb"]
    assert got[0]["score"] == got[1]["score"] == 0 and 0 < got[3]["score"] <= 1
    assert got[5]["lang_pred"] in model.languages
    assert "key" in got[3].asDict() and got[3]["source"] == X.table(spark, ["x"] * 4).collect()[3]["source"]
    assert {r["lang_pred"] for r in langid.predict(X.all_null(spark), model).collect()} == {"und"}
    assert langid.predict(X.all_null(spark).withColumnRenamed("key", "_letters"), model).count() == 3
