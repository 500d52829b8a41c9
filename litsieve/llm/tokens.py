"""Token ids in ORC files.

One row per document (doc_id, shard, place, ids), in ascending order of doc_id over the
files: integer run-length encoding packs the ids, row indexes hold the range of
doc_id for every ``stride`` rows and a Bloom filter its members, so a reader of one
document skips stripes and rows from metadata, and tasks read stripes in parallel.
``place`` is the row's number in its shard, so an index can be made in the files' order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from litsieve.llm.alignment import VISIBLE, ranges, split
from litsieve.llm.common import read, small_batches
from litsieve.session import durable, scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text that are encoded at once, and bytes of units that a worker remembers.
CHUNK_BYTES, MEMO_BYTES = 6_000_000, 60_000_000
#: Units that are encoded joined.
JOINED = 64
#: Stands before a text's first unit, which no blank leads.
LEAD = b"\0"


@cache
def tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


class Pieces:
    """Ids of units, looked up where a unit was seen before.

    The vocabulary's rule always begins a new piece at a blank that a visible character
    follows, so a text can be cut there and its parts encoded on their own. New units are
    encoded joined, some dozens at a time, and told apart by the number of bytes that
    each id stands for. Texts that hold the vocabulary's own special strings are encoded
    whole. What is remembered is bounded in bytes: beyond that all is forgotten.
    """

    def __init__(self, path: str | None):
        self.tokenizer = tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character stands for one byte
            self.n_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ``end`` after each; number of ids per text)."""
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        plain = [b"" if i in set(odd) else t for i, t in enumerate(texts)] if odd else texts
        units, words, first = split(plain, LEAD)
        slot = self._slots(units)[words]
        size = self.size[slot]
        ends = np.concatenate([[0], np.cumsum(size)])[first[1:]]
        ids = np.insert(self.ids[ranges(self.start[slot], size)], ends, end)
        n = np.diff(ends, prepend=0) + 1
        if odd:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, x in zip(odd, self._ids([texts[i].decode() for i in odd]), strict=True):
                parts[i] = np.array([*x, end], np.int32)
                n[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, n

    def _slots(self, units: pa.Array) -> np.ndarray:
        """Places of distinct ``units`` among those remembered."""
        if self.units.nbytes + 16 * len(self.start) + 4 * len(self.ids) > MEMO_BYTES:
            self._forget()
        found = pc.index_in(units, value_set=self.units)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = units.filter(found.is_null())
            ids, size = self._encoded(new.to_pylist())
            at[at < 0] = np.arange(len(self.start), len(self.start) + len(new))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, ids.astype(np.int32))
            self.units = pa.concat_arrays([self.units, new])
        return at

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per unit)."""
        joint = [i for i, u in enumerate(units) if len(u) > 1 and u[0] == 0x20 and VISIBLE[u[1]] and u[-1] != 0x20]
        alone = sorted(set(range(len(units))).difference(joint))
        whole = [b"".join([units[i] for i in joint[k : k + JOINED]]).decode() for k in range(0, len(joint), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._ids(whole)), np.int64)
        ends = np.cumsum(np.fromiter((len(units[i]) for i in joint), np.int64, len(joint)))
        cut = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
        rest = self._ids([units[i].removeprefix(LEAD).decode() for i in alone])
        n = np.zeros(len(units), np.int64)
        n[joint] = np.diff(cut, prepend=0)
        n[alone] = list(map(len, rest))
        both = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.int64)])
        order, start = np.array([*joint, *alone], np.int64), np.zeros(len(units), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return both[ranges(start, n)], n


@cache
def pieces(path: str | None) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """doc_id, shard, place, ids in ascending doc_id order: ``shard`` counts the
    partitions, ``place`` the rows of one.

    Null texts are empty and give the end id alone; a null doc_id comes first; rows of one
    doc_id go by a digest of their text, equal ones next to each other; other columns are
    ignored. Without ``shards`` their number is that of shuffle partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place = TaskContext.get().partitionId(), 0
        coder = pieces(vocabulary_path)
        held: list[pa.RecordBatch] = []

        def coded() -> pa.RecordBatch:
            nonlocal place
            texts = [x or b"" for b in held for x in b.column("text").cast(pa.binary()).to_pylist()]
            ids, n = coder.encode(texts, end_id)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids, pa.int32()))
            places = pa.array(np.arange(place, place + len(texts)))
            place += len(texts)
            doc_ids = pa.concat_arrays([b.column("doc_id") for b in held])
            shards_ = pa.array(np.full(len(texts), shard, np.int32))
            return pa.RecordBatch.from_arrays([doc_ids, shards_, places, lists], ["doc_id", "shard", "place", "ids"])

        size = 0
        for b in batches:
            held.append(b)
            size += b.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield coded()
                held, size = [], 0
        if held:
            yield coded()

    at = ["doc_id", "_digest"]
    rows = docs.select("doc_id", "text").withColumn("_digest", F.xxhash64("text"))
    rows = rows.repartitionByRange(*([shards] if shards else []), *at).sortWithinPartitions(*at).drop("_digest")
    return small_batches(rows, 256).mapInArrow(run, "doc_id long, shard int, place long, ids array<int>")


def write_tokens(encoded: DataFrame, path: str, stripe_mb: int = 64, stride: int = 1000) -> None:
    encoded.write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": str(stripe_mb << 20),
            "orc.row.index.stride": str(stride),
            "orc.create.index": "true",
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, shard int, place long, ids array<int>").orc(path)


def index(tokens: DataFrame) -> DataFrame:
    """Per document: start (ids of all documents before it), n_tokens, ids_crc32.

    One pass over the files; shards are ranges of doc_id, so their sums give each shard's
    start, and rows are summed up within a shard only, in the order they are stored in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "shard", "place")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "place", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"
    rows = durable(small_batches(tokens, 256).mapInArrow(run, schema), "token-index")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One line per shard.
    before = sums.select(
        F.col("shard").alias("_shard"),
        F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(
        before, F.col("shard") == F.col("_shard")
    ).select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame) -> DataFrame:
    """Encode, write, read back, and sum up."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(encode(docs), path)
    return index(read_tokens(docs.sparkSession, path))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(read(spark, sf_dir, "documents"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and where each document's ids lie in them. Nulls and
    repeated ids: see ``encode``."""
    return tokens_of(docs)
