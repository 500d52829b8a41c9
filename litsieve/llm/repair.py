"""Repair of conversation structure with the cheapest audit.

A conversation's rows, in the order of their turns, are kept (K), given the role user or
assistant (R) or deleted (D), and empty rows are inserted (I), so that the initials of the
roles read ``(s?(ua)+)?``. The audit is the string of these letters; of the cheapest
audits the one that is least in ASCII order counts.

A task goes through sorted rows and cuts every conversation into segments of a bounded
number of rows and bytes. In a segment a dynamic programme runs over the places that the
pattern can be at, from each place that the segment can begin at. Audits are nodes of a
shared tree: a prefix is stored once, a node knows its ancestors 1, 2, 4, .. letters back
and a rolling hash of its string, and audits of equal cost are compared at the end of
their longest common prefix, found by halving; equal hashes only count for equal nodes.
Inserts belong to the row that they stand before, so no audit of a segment is a prefix
of another one and their order does not depend on what follows.

Conversations that lie inside one task's range are finished there. Of the others, a
table of costs per segment is enough to choose each segment's beginning and end; the
segments then are rendered on their own. Only the digest, which has to read a
conversation's text from end to end, streams through one task, with one segment in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.llm.common import read, small_batches
from litsieve.session import durable

#: Rows and bytes of text that a segment holds, about.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 8_000_000
RETELL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\v\f\r"
#: Places in the pattern: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {
    (EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What ends a conversation at each place.
_CLOSE = ("", "II", "I", "")


class Audits:
    """Strings as nodes of one tree; equal strings are one node. Node 0 is empty."""

    BASE, MOD = 1_000_003, (1 << 61) - 1

    def __init__(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]
        self._child: dict[tuple[int, str], int] = {}

    def extend(self, node: int, letter: str) -> int:
        got = self._child.get((node, letter))
        if got is None:
            got = self._child[node, letter] = len(self.letter)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * self.BASE + ord(letter)) % self.MOD)
            ups, k = [node], 0
            while k < len(self.up[ups[k]]):  # the ancestor twice as far back
                ups.append(self.up[ups[k]][k])
                k += 1
            self.up.append(tuple(ups))
        return got

    def lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        return self.hash[a] == self.hash[b] and a == b

    def less(self, a: int, b: int) -> bool:
        least = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, least), self.lift(b, least)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


Best = tuple[int, int] | None


def _better(tree: Audits, old: Best, cost: int, node: int, letter: str) -> Best:
    """The cheaper, then lesser, of ``old`` and the audit ``node`` with one letter more."""
    if old is not None and cost > old[0]:
        return old
    new = tree.extend(node, letter)
    if old is None or cost < old[0] or tree.less(new, old[1]):
        return cost, new
    return old


def walk(rows: list[tuple[str, bool, bool]], start: int, tree: Audits) -> list[Best]:
    """Cheapest audit per place at the end, from ``start``, over (initial, must go,
    truncated) rows; trailing inserts are left to what follows."""
    at: list[Best] = [None] * 4
    at[start] = (0, 0)
    for initial, must_go, truncated in rows:
        for source, target in ((EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if here := at[source]:
                at[target] = _better(tree, at[target], here[0] + INSERT, here[1], "I")
        after: list[Best] = [None] * 4
        for place, here in enumerate(at):
            if here is None:
                continue
            cost, node = here
            after[place] = _better(tree, after[place], cost + DELETE, node, "D")
            if must_go:
                continue
            cost += TRUNCATED if truncated else 0
            kept, told = _KEEP.get((place, initial)), _NEXT[place]
            if kept is not None:
                after[kept] = _better(tree, after[kept], cost, node, "K")
            after[told] = _better(tree, after[told], cost + RETELL, node, "R")
        at = after
    return at


def apply(audit: str, place: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the rows that an audit leaves, from ``place`` on."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        place = _KEEP[place, roles[i][:1]] if letter == "K" else _NEXT[place]
        role = roles[i] if letter == "K" else _ROLE[place]
        out.append(f"{role}:{'' if letter == 'I' else texts[i]}")
        i += letter != "I"
    return out


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
SEGMENTS = (
    "conv_id long, place long, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, "
    "turns long, first_turn long, last_turn long, opening string, closing string, cost long, audit string, "
    "digest string, costs array<long>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>"
)
_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_SEGMENTS_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in (*COUNTS, "first_turn", "last_turn")]
    + [("opening", pa.string()), ("closing", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string())]
    + [("costs", _LONGS), ("ranks", pa.list_(pa.int32())), ("audits", _STRINGS), ("roles", _STRINGS), ("texts", _STRINGS)]
)


class _Segment:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv: int | None, first: bool):
        self.conv, self.first = conv, first
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.flags: list[tuple[str, bool, bool]] = []
        self.turns: list[int] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        shown = text.rstrip(WHITE)
        blank = not shown.lstrip(WHITE)
        duplicate = repeated and not blank
        truncated = not blank and not duplicate and shown[-1] not in ".!?"
        if self.flags and self.flags[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        for name, found in (("rows", 1), ("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.n[name] += found
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.n["turns"] += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.roles.append(role)
        self.texts.append(text)
        self.flags.append((role[:1], blank or duplicate, truncated))
        self.size += len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.size >= SEGMENT_BYTES

    def line(self, place: int, last: bool, open_ended: bool) -> dict:
        """``open_ended``: the conversation may go on in another task's range."""
        turns = self.turns or [None, None]
        out = {
            "conv_id": self.conv, "place": place, "whole": self.first and last and not open_ended, **self.n,
            "first_turn": turns[0], "last_turn": turns[-1], "opening": self.flags[0][0], "closing": self.flags[-1][0],
        }
        if out["whole"]:
            tree = Audits()
            ends = [(b[0] + INSERT * len(_CLOSE[p]), b[1], p) for p, b in enumerate(walk(self.flags, EMPTY, tree)) if b]
            best = ends[0]
            for e in ends[1:]:
                if e[0] < best[0] or e[0] == best[0] and tree.less(e[1], best[1]):
                    best = e
            audit = tree.text(best[1]) + _CLOSE[best[2]]
            repaired = "\n".join(apply(audit, EMPTY, self.roles, self.texts))
            return out | {"cost": best[0], "audit": audit, "digest": hashlib.sha256(repaired.encode()).hexdigest()}
        costs, ranks, audits = [-1] * 16, [0] * 16, [""] * 16
        for start in range(4):
            tree = Audits()
            ends = walk(self.flags, start, tree)
            for end, best in enumerate(ends):
                if best:
                    k = 4 * start + end
                    costs[k], audits[k] = best[0], tree.text(best[1])
                    ranks[k] = sum(tree.less(x[1], best[1]) for x in ends if x and x[1] != best[1])
        return out | {"costs": costs, "ranks": ranks, "audits": audits, "roles": self.roles, "texts": self.texts}


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Written lines of ``SEGMENTS`` from conv_id, turn, role, text, repeated rows that
    are range-partitioned and sorted; ``place`` numbers them in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        now: _Segment | None = None
        fresh = False  # the open conversation surely began here
        out: list[dict] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "repeated"))
            for conv, turn, role, text, repeated in zip(*columns, strict=True):
                if now is not None and (conv != now.conv or now.full(segment_rows)):
                    ended = conv != now.conv
                    out.append(now.line(place, ended, not fresh))
                    place += 1
                    fresh = fresh or ended
                    now = _Segment(conv, ended)
                elif now is None:
                    now = _Segment(conv, True)
                now.add(turn, role, text, repeated)
            if out:
                yield pa.RecordBatch.from_pylist(out, _SEGMENTS_ARROW)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.line(place, True, True)], _SEGMENTS_ARROW)

    return durable(small_batches(rows).mapInArrow(run, SEGMENTS), "segments")


PICKS = "conv_id long, place long, start int, pick int, close string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
_PICKS_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("start", pa.int32()), ("pick", pa.int32()), ("close", pa.string())]
    + [(c, pa.int64()) for c in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal")]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Lines of one conversation after another."""
    held: list[dict] = []
    for batch in batches:
        for line in batch.to_pylist():
            if held and held[-1]["conv_id"] != line["conv_id"]:
                yield held
                held = []
            held.append(line)
    if held:
        yield held


def _chosen(lines: list[dict]) -> list[dict]:
    """Where each segment begins and ends in the cheapest, least audit."""
    never = 1 << 62
    togo = [[INSERT * len(c) for c in _CLOSE]]
    for line in reversed(lines):
        ways = [[c + t if c >= 0 else never for c, t in zip(line["costs"][4 * s : 4 * s + 4], togo[-1], strict=True)] for s in range(4)]
        togo.append([min(w) for w in ways])
    togo.reverse()
    place, out = EMPTY, []
    for line, (left, after) in zip(lines, pairwise(togo), strict=True):
        costs, ranks = (line[c][4 * place : 4 * place + 4] for c in ("costs", "ranks"))
        ends = [e for e in range(4) if costs[e] >= 0 and costs[e] + after[e] == left[place]]
        end = min(ends, key=ranks.__getitem__)
        out.append({"conv_id": line["conv_id"], "place": line["place"], "start": place, "pick": 4 * place + end, "close": ""})
        place = end
    out[-1]["close"] = _CLOSE[place]
    turns = [(x["first_turn"], x["last_turn"]) for x in lines if x["first_turn"] is not None]
    distinct = sum(x["turns"] for x in lines) - sum(a[1] == b[0] for a, b in pairwise(turns))
    seams = sum(a["closing"] + b["opening"] not in ("su", "ua", "au") for a, b in pairwise(lines))
    total = {c: sum(x[c] for x in lines) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += seams
    total |= {"cost": togo[0][EMPTY], "gaps": turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0}
    return [x | total for x in out]


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lines in _runs(batches):
        yield pa.RecordBatch.from_pylist(_chosen(lines), _PICKS_ARROW)


RENDERED = "conv_id long, place long, part string, repaired string"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            part = x["audits"][x["pick"]] + x["close"]
            out.append((x["conv_id"], x["place"], part, "\n".join(apply(part, x["start"], x["roles"], x["texts"]))))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "part", "repaired"]
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: tuple | None = None
    state: list = []

    def closed() -> pa.RecordBatch:
        row = {"conv_id": now[0], "audit": "".join(state[0]), "digest": state[1].hexdigest()}
        return pa.RecordBatch.from_pylist(
            [row], pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("digest", pa.string())])
        )

    for batch in batches:
        for conv, part, repaired in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "repaired")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    yield closed()
                now, state = (conv,), [[], hashlib.sha256(), False]
            state[0].append(part)
            if repaired:
                state[1].update(("\n" if state[2] else "").encode() + repaired.encode())
                state[2] = True
    if now is not None:
        yield closed()


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _ordered(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartition(columns[0]).sortWithinPartitions(*columns)


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation of conv_id, turn, role, text rows: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, digest.

    Rows go by turn, nulls first; rows of one turn by a digest of role and text, equal
    ones next to each other. Nulls of role and text are one space; an empty role has no
    initial, so such a row is retold or deleted; rows without conv_id are one
    conversation; other columns are ignored; no rows give no rows.
    """
    filled = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # Equal rows meet as a number, and are dealt out again.
    distinct = durable(
        filled.groupBy("conv_id", "turn", "key").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"), F.count("*").alias("n")),
        "conversation-rows",
    )
    # Only what is said in several turns.
    again = (
        distinct.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k"))
        .agg(F.min(F.struct("turn"))["turn"].alias("first"), F.count("*").alias("m"))
        .filter("m > 1")
        .select("c", "k", "first", F.lit(True).alias("told"))
    )
    dealt = (
        distinct.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
        .withColumn("later", F.coalesce("told", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first")))
        .select("conv_id", "turn", "key", "role", "text", "later", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
        .select("conv_id", "turn", "key", "i", "role", "text", (F.col("later") | (F.col("i") > 1)).alias("repeated"))
    )
    at = ["conv_id", "turn", "key", "i"]
    lines = segments(dealt.repartitionByRange(*at).sortWithinPartitions(*at), segment_rows)

    done = lines.filter("whole").select(
        "conv_id",
        F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).alias("gaps"),
        *RESULT[1:], "audit", "digest",
    )
    parts = lines.filter("NOT whole")
    slim = parts.select(
        "conv_id", "place", *COUNTS, "first_turn", "last_turn", "opening", "closing", "costs", "ranks"
    )
    picks = durable(small_batches(_ordered(slim, "conv_id", "place")).mapInArrow(_choose, PICKS), "picks")
    chosen = parts.select("conv_id", "place", "audits", "roles", "texts").join(picks.select("place", "start", "pick", "close"), "place")
    rendered = small_batches(chosen, 2).mapInArrow(_render, RENDERED)
    texts = _ordered(rendered, "conv_id", "place").mapInArrow(_digest, "conv_id long, audit string, digest string")
    sums = picks.dropDuplicates(["conv_id"]).select(F.col("conv_id").alias("c"), *RESULT)
    cut = texts.join(sums, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *RESULT, "audit", "digest")
    return done.unionByName(cut)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text rows with the faults that a row's conv_id and turn name:
    of twenty remainders, 0 drops it, 1 empties its text, 2 takes its sentence ends, 3
    repeats it, 4 makes it the user's. Nulls count as one space, but for the order of turns."""

    def filled(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.explode(copies)
    ).drop("col")


def _sql() -> str:
    """The damage and a walk over each conversation's rows that carries, per place in the
    pattern, the cheapest and least (cost, audit, repaired rows)."""

    def step(x: str, letter: str, cost: str, row: str = "") -> str:
        out = f"list_append({x}.o, {row})" if row else f"{x}.o"
        return f"{{'c': {x}.c + {cost}, 't': {x}.t || '{letter}', 'o': {out}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def when(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    kept, bad = "role || ':' || txt", "CASE WHEN truncated THEN 5 ELSE 0 END"

    def moves(x: str, role: str) -> list[str]:
        return [
            when(f"NOT gone AND ini = '{role[0]}'", step(x, "K", bad, kept)),
            when("NOT gone", step(x, "R", f"1 + {bad}", f"'{role}:' || txt")),
        ]

    start = "{'c': %d, 't': '', 'o': []::VARCHAR[]}"
    none, white = start % 10**9, r"\x20\x09-\x0D"
    add_u, add_a = (lambda x: step(x, "I", "5", "'user:'")), (lambda x: step(x, "I", "5", "'assistant:'"))
    return rf"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key
        FROM conversations),
    coded AS (
        SELECT * EXCLUDE (key), xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(key,
                   lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END),
               4294967295) % 20 AS fault
        FROM keyed),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
               unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM coded WHERE fault <> 0),
    placed AS (
        SELECT *, row_number() OVER in_order AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER in_order AS before,
               row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY turn NULLS FIRST, copy) AS told,
               regexp_extract(txt, '([^{white}])[{white}]*$', 1) AS last
        FROM damaged WINDOW in_order AS (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || txt), copy)),
    flagged AS MATERIALIZED (
        SELECT *, last = '' AS blank, last <> '' AND told > 1 AS dup, last = '' OR told > 1 AS gone,
               last <> '' AND told = 1 AND last NOT IN ('.', '!', '?') AS truncated
        FROM placed),
    walk AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, {start % 0} AS e, {none} AS s, {none} AS u, {none} AS a FROM flagged
        UNION ALL
        SELECT conv_id, i, {step("e", "D", "2")}, {least(step("s", "D", "2"), when("NOT gone AND ini = 's'", step("e", "K", bad, kept)))},
               {least(step("u", "D", "2"), *moves("e", "user"), *moves("s", "user"), *moves("a", "user"))},
               {least(step("a", "D", "2"), *moves("u", "assistant"))}
        FROM (SELECT * EXCLUDE (a), {least("a", add_a("u"))} AS a
              FROM (SELECT f.*, w.e, w.s, w.a, {least("w.u", add_u("w.e"), add_u("w.s"), add_u("w.a"))} AS u
                    FROM walk w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
    ended AS (
        SELECT conv_id, {least("e", "a", add_a("u"), add_a("(" + add_u("s") + ")"))} AS best
        FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (truncated) AS truncated,
               count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
        FROM flagged GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.t, '') AS audit,
           sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = _sql()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's audit after damage; one without rows has none."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired_all(rows)


def repaired_all(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    found = repair(damage(rows), segment_rows).withColumnRenamed("conv_id", "c")
    ids = rows.select("conv_id").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RESULT],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(empty)).alias("repaired_sha256"),
    )
