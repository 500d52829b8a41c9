"""Chat formatting from event logs.

A log holds events (conv_id, seq, msg, kind, role, text). ``fold_events`` brings a
message's events together in the order of ``seq``: ``open`` starts a message,
``delta`` appends, ``edit`` and ``regenerate`` start its text anew, ``delete`` takes
it away until a later event that starts it anew. Replacing a message that others
follow begins a new branch: messages opened after it and before the replacement
are left out. ``render`` writes one line per turn, with control strings
escaped, and says which characters count for the loss.

The work is grouped by message, not by conversation, so a conversation that holds
a third of all rows is spread; only its short lines (no texts) meet in one window,
and digests stream over sorted rows with one turn in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from litsieve.llm.common import read, small_batches
from litsieve.session import durable

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|n|>"
ANEW = ("open", "edit", "regenerate", "delete")


def escaped(text: Column) -> Column:
    r"""``<|`` never remains: ``<``, any ``\``s, ``|`` get one ``\`` more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role in one line. ``<|`` never remains in escaped text, so ``LINE`` can stand for
    the line feeds."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, turn (0 and up), role, text.

    Null texts are empty; a null kind is a ``delta``; the role is that of the
    message's latest event that has one, else empty; events that are equal in
    ``seq`` apply in the order of kind and text, so repeated rows of one event give
    the same result on every run. Messages without an event that starts them are
    taken as opened by their first event. Other columns are ignored; an empty log
    gives no message.
    """
    kind = F.coalesce(F.col("kind"), F.lit("delta"))
    rows = events.select(
        "conv_id", "msg", "seq", kind.alias("kind"), "role",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    restarts = F.col("kind").isin(*ANEW)
    place = F.struct("seq", "kind", "text")
    spots = rows.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("opened"),
        F.max(F.when(restarts, F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("replaced"),
        F.max_by("kind", F.when(restarts, F.struct("seq", "kind"))).alias("last_start"),
        F.max_by("role", F.when(F.col("role").isNotNull(), place)).alias("role"),
    )
    earlier = (
        W.partitionBy("conv_id").orderBy("opened", "msg").rowsBetween(W.unboundedPreceding, -1)
    )
    live = spots.withColumn("cut", F.max("replaced").over(earlier)).filter(
        (F.col("cut").isNull() | (F.col("cut") < F.col("opened")))
        & ~F.coalesce(F.col("last_start") == "delete", F.lit(False))
    )
    live = live.withColumn(
        "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("opened", "msg")) - 1
    ).select(
        F.col("conv_id").alias("c"), F.col("msg").alias("m"), "turn", "reset",
        F.coalesce(F.col("role"), F.lit("")).alias("final_role"),
    )
    parts = rows.drop("role").join(
        live,
        F.col("conv_id").eqNullSafe(F.col("c"))
        & F.col("msg").eqNullSafe(F.col("m"))
        & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))),
    )
    return parts.groupBy("conv_id", "msg", "turn", F.col("final_role").alias("role")).agg(
        # One message's own pieces.
        F.array_join(
            F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), ""
        ).alias("text")
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted line per turn, to be read in the order of ``turn``: conv_id,
    turn, formatted, loss_start, loss_end (code points; equal where nothing counts)."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    counts = F.col("role").isin(*learn)
    return messages.select(
        "conv_id", "turn",
        F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.length(head).alias("loss_start"),
        (F.length(head) + F.when(counts, F.length(body)).otherwise(0)).alias("loss_end"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns from formatted lines alone: conv_id, turn, role, text, loss, n_chars.

    The role ends at the first line feed; those of its own are escaped."""
    inner = F.col("formatted").substr(
        F.lit(len(START) + 1), F.length("formatted") - len(START) - len(END) - 1
    )
    role_chars = F.locate("\n", inner) - 1
    return formatted.select(
        "conv_id", "turn",
        unescaped_role(inner.substr(F.lit(1), role_chars)).alias("role"),
        unescaped(inner.substr(role_chars + 2, F.length(inner))).alias("text"),
        unescaped(
            F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
        ).alias("loss"),
        F.length("formatted").cast("long").alias("n_chars"),
    )


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; one conversation's sums are open."""
    now, state = None, None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "n_chars"))
        for conv, role, text, loss, n in zip(*columns, strict=True):
            if state is None or conv != now:
                if state:
                    out.append(_closed(now, state))
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += n
        yield _frame(out)
    if state:
        yield _frame([_closed(now, state)])


def _closed(conv: int | None, s: list) -> tuple:
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


_KINDS = {"long": pa.int64(), "string": pa.string()}


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in DIGESTS.split(", ")]
    columns = [[r[i] for r in rows] for i in range(len(fields))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


def digests(turns: DataFrame) -> DataFrame:
    """One line per conversation with digests of what ``read_back`` gave."""
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return small_batches(rows).mapInArrow(_digest, DIGESTS)


def as_events(turns: DataFrame, piece: int = 256) -> DataFrame:
    """The event log of turn rows: each opens a message and streams its text in
    deltas of ``piece`` code points. Every row is a message of its own: rows of one turn,
    or of none, stand in the order of role and a digest of the text, equal rows follow
    each other."""
    rows = turns.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    # Equal rows are counted and dealt out again, so no key brings unequal ones together.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("_n"))
    # Cut once; the whole text does not go along with its pieces.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    cut = rows.select(
        "conv_id", "turn", "role", "_n", F.xxhash64("text").alias("digest"), F.concat(F.array(F.lit("")), pieces).alias("_pieces")
    )
    return cut.select(
        "conv_id", "turn", "role", "digest", "_n", F.posexplode("_pieces").alias("_k", "text")
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).select(
        "conv_id",
        F.struct("turn", F.col("role").alias("by"), "digest", "_i").alias("msg"),
        "role", "text", "_k",
    ).select(
        "conv_id", "msg", "role",
        F.struct("msg", "_k").alias("seq"),
        F.when(F.col("_k") == 0, "open").otherwise("delta").alias("kind"),
        "text",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted, written, read
    back and summed up."""
    said = f"{END}{START}assistant ok"
    extra = spark.sql(
        f"SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role), '{said}' AS text"
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = render(fold_events(as_events(turns.unionByName(extra))))
    return digests(read_back(durable(formatted, "chat")))


SQL = rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{END}{START}assistant ok')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('{START}') + length('{END}') + 2
               + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '{LINE}'))
               + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""
