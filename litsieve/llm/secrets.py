"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary of word pieces writes prose with several characters a token; a random
string falls apart into pieces of one or two characters. What the fixed patterns leave
over of runs of letters, digits and ``+/_=-`` is tested: their parts of eight and more
characters between separators, and where none is found long runs that mix letters and
digits as a whole.
Those with fewer than ``least_ratio`` characters a token are reported as ``random``,
unless they are known digests (hexadecimal of a digest's length) or identifiers (UUIDs,
numbers). Letters of one case, which may be a rare word, must have still fewer
characters a token, the fewer the shorter they are.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.llm.common import read, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so a shorter run can't be part of a match of 16.
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
PART = re.compile(r"[A-Za-z0-9]{8,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
NUMBERS = re.compile(r"[0-9+/_=-]+\Z")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
#: Capitals elsewhere than at the beginning or throughout.
CASES = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
#: Letters of one case may be a word: (from so many, characters a token that are too few).
WORDLIKE = ((16, 1.7), (12, 1.5), (8, 1.3))
#: Whole runs, separators and all, count from here on.
LONG = 20

Span = tuple[int, int, int]


@cache
def vocabulary(path: str | None):
    """A tiktoken encoding from a file of ranks; the default is the installed one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, leftmost, not overlapping per kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def is_random(part: str, vocabulary_path: str | None, least_ratio: float) -> bool:
    """Too few characters a token, and no digest, identifier or number."""
    if DIGEST.match(part) or UUID.match(part) or NUMBERS.match(part):
        return False
    limit = least_ratio
    if not MIXED.match(part) and not CASES.search(part):
        limit = next(ratio for size, ratio in WORDLIKE if len(part) >= size) * least_ratio / 2
    elif len(part) < 12:
        limit = 0.85 * least_ratio
    return len(part) < limit * len(vocabulary(vocabulary_path).encode_ordinary(part))


def inner_spans(run: str, vocabulary_path: str | None, least_ratio: float) -> list[tuple[int, int]]:
    """What of a run is random: parts of it between separators, else all of a long one."""
    if UUID.match(run):
        return []
    parts = [(m.start(), m.end()) for m in PART.finditer(run) if is_random(m.group(), vocabulary_path, least_ratio)]
    whole = not parts and len(run) >= LONG and MIXED.match(run) and is_random(run, vocabulary_path, least_ratio)
    return [(0, len(run))] if whole else parts


def random_spans(
    text: str, base: list[Span], vocabulary_path: str | None, least_ratio: float, known: dict[str, list] | None = None
) -> list[Span]:
    """Random parts of what the fixed patterns leave over. ``known``: runs seen before."""
    known = {} if known is None else known
    taken = sorted((a, b) for _, a, b in base)
    found, i = [], 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        left = [(start, end)]
        for a, b in taken[i:]:
            if a >= end:
                break
            x, y = left.pop()
            left += [(x, min(a, y))] * (a > x) + [(max(b, x), y)] * (b < y)
            if b >= y:
                break
        for a, b in left:
            if b - a < 8:
                continue
            run = text[a:b]
            spans = known.get(run)
            if spans is None:
                spans = known[run] = inner_spans(run, vocabulary_path, least_ratio)
            found += [(3, a + x, a + y) for x, y in spans]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0])))


def scan(docs: DataFrame, vocabulary_path: str | None = None, least_ratio: float = 2.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans (text form).

    Null texts are empty and have no span; repeated rows are scanned each; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list] = {}  # of one batch
            columns: list[list] = [[] for _ in NAMES[1:]]
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", base, vocabulary_path, least_ratio, known)
                kinds = [k for k, _, _ in base]
                row = (*(kinds.count(k) for k in range(3)), len(more), joined(base), joined(base + more))
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], NAMES)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a digest of the fixed patterns' spans."""
    found = scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random",
    )
