"""Small tables with odd rows, shared by the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, score double, key string"

WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "Ha", "ï") for b in ("la", "mi", "no", "ré", "st", "x")]


def prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + rng.choice(["", "", "n", "s"]) for _ in range(n)]


def texts(seed: int = 1) -> list[str | None]:
    """Copies, near copies, shared passages, short periods, null, empty and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(6)]
    shared = prose(rng, 60)
    out: list[str | None] = [None, "", " \n\t ", "one", "one two", "two one three four"]
    for b in base:
        out += [" ".join(b), "  ".join(b) + "\n", " ".join(b).upper()]
        near = list(b)
        near[len(near) // 2] = "changed"
        out.append(" ".join(near))
        half = list(b)
        half[10:20] = shared
        out.append(" ".join(half))
    out += ["ab " * 300, "xyz " * 150 + "end", "q" * 700, "la la la la la la la la la la la la la la la la la la la la la la", "ab " * 300]
    out.append(" ".join(prose(rng, 6000)) + "\n" + " ".join(shared))
    return out


def table(spark, rows: list[str | None], repeat: bool = False):
    """Rows with clashing extra columns; null ids and sources come in."""
    data = [(i, t, None, [None, "a", "b"][i % 3], None, None, 7, None, None) for i, t in enumerate(rows)]
    if repeat:
        data += [data[3], data[3]]
        data.append((None, rows[7], "en", None, 3, 1, 1, 0.5, "k"))
    return spark.createDataFrame(data, SCHEMA)


def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def all_null(spark):
    return spark.createDataFrame([(None,) * 9] * 3, SCHEMA)
