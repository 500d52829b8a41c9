"""N-gram Jaccard join over parity sketches.

A document is the set of its distinct word shingles. Its sketch is a row of pieces;
every shingle belongs to one piece by its hash, and a piece is the exclusive or of
its shingles' hashes. A shingle that only one of two documents has changes one piece,
so the number of pieces that differ is a lower bound of the symmetric difference,
and two sets with Jaccard similarity of at least 0.8 differ in at most
``(|A| + |B|) / 9`` pieces.

* Size bands: sets of 2**k to 2**(k+1) - 1 shingles have the same number of pieces;
  a set that is small in its band also shows its pieces in the band below.
* Pigeonhole: of a band's K pieces at most d differ. Pieces are put in one order that
  all sets share (those of many shingles first); two sets with K - d equal pieces then
  have an equal one among the first d + 1 of each, so no more are shown.
* Sets that show an equal piece are candidates. Each candidate's bit parity sketch
  (one bit for a shingle, 1024 bits) gives a second lower bound; what passes is
  verified with the words of the texts.

Groups of sets with an equal piece are joined to one member, never all pairs. A group
whose members then aren't all in one component is looked at once more: its members in
different components are compared in blocks of bounded size by their bit sketches. The
members of large such groups first show other pieces, by rarity (``rarest_pieces``).
Equal sets are one node throughout.

All links lie inside components, so once these are known the links of each set are
counted there: a component's sets are dealt into blocks of bounded size, every two
blocks meet in a task, and an index of shingles gives the intersections of all their
pairs. Only the counts go on, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from litsieve.llm.common import Words, chunks, mixed, read, run_hash, small_batches, unused
from litsieve.llm.components import components
from litsieve.session import durable

SHINGLE = 5
BITS = 1024
#: Members of a block when a mixed group is compared once more.
BLOCK = 64
#: Shingles of a block when the links inside a component are counted.
COUNT_SHINGLES = 300_000
#: Bytes of text whose pieces are joined inside a task before they are shuffled.
LOCAL_BYTES = 16_000_000
#: Documents, and shingles, that the list of frequent shingles is made from at most.
SAMPLE_ROWS, SAMPLE_SHINGLES, LEAST_IN_SAMPLE = 4000, 50_000, 8
NONE = np.zeros(0, np.uint64)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_sets(part: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of some texts, by text."""
    w = Words([t.translate(LOWER) for t in part])
    h = w.hashes()
    at = np.flatnonzero(w.whole(k))
    doc, hashes = [w.doc[at]], [run_hash(h, k)[at]]
    for short in range(1, k):  # fewer words: the whole sequence
        texts = np.flatnonzero(w.n == short)
        if len(texts):
            doc.append(texts)
            hashes.append(run_hash(h, short)[w.first[texts]])
    doc, hashes = np.concatenate(doc), np.concatenate(hashes)
    key = hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    keep = order[new]
    keep = keep[np.argsort(doc[keep], kind="stable")]
    return doc[keep], hashes[keep]


def nodes(doc: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's set."""
    sums = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        sums[full] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5BD1E995)), starts)
    return mixed(sums + n.astype(np.uint64)).view(np.int64)


def most_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of two linked sets of these sizes."""
    return (a + b) // 9


def pieces(
    doc: np.ndarray, hashes: np.ndarray, n: np.ndarray, lower: bool, frequent: np.ndarray = NONE, every: bool = False
) -> tuple[np.ndarray, ...]:
    """(text, signature, need) of the pieces that each text shows, in its band or the one
    below; ``need`` says how many. All pieces with ``every``. Pieces with the most shingles
    that aren't ``frequent`` (sorted hashes) come first."""
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    if lower:
        band -= 1
        shown = (n >= 2) & (n <= (5 * (2 ** (band + 1) - 1)) // 4)
        need = most_apart(n, n) + 1
    else:
        shown = n >= 1
        need = most_apart(n, 5 * n // 4) + 1
    shown &= need > 1  # no difference is allowed: equal sets are one node
    top = 2 ** (np.maximum(band, 0) + 1) - 1
    most = np.maximum(most_apart(top, 5 * top // 4), most_apart(5 * top // 4, 5 * top // 4)) + 1
    total = np.where(shown, most + most // 4 + 1, 0)
    offset = np.cumsum(total) - total
    mine = shown[doc]
    d, h = doc[mine], hashes[mine]
    slot = offset[d] + ((h >> np.uint64(20)) % total[d].astype(np.uint64)).astype(np.int64)
    count = np.bincount(slot, minlength=int(total.sum()))
    value = np.zeros(len(count), np.uint64)
    order = np.argsort(slot, kind="stable")
    full = np.flatnonzero(count)
    if len(full):
        value[full] = np.bitwise_xor.reduceat(h[order], np.cumsum(count[full]) - count[full])
    owner = np.repeat(np.arange(len(n)), total)
    place = np.arange(len(count)) - offset[owner]
    signature = mixed(value ^ mixed((band[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)))
    at = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
    rare = np.bincount(slot, frequent[at] != h if len(frequent) else None, minlength=len(count))
    by = np.lexsort((signature, -count, -rare, owner))
    shows = by if every else by[np.arange(len(by)) - offset[owner[by]] < need[owner[by]]]
    return owner[shows], signature[shows], need[owner[shows]]


def bit_sketches(doc: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """One row of BITS / 64 words per text; each shingle flips one bit."""
    bit = (hashes % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(doc * BITS + bit, minlength=n_texts * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n_texts, BITS), axis=1, bitorder="little").view("<i8")


def digest(text: Column) -> Column:
    return F.xxhash64(text)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, digest, node, n_shingles, text.

    Texts are kept once per node and task, null otherwise: whatever row a node's text is
    taken from, it has that node's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column("text").to_pylist()
            for at, part in chunks(texts):
                doc, h = shingle_sets(part)
                n = np.bincount(doc, minlength=len(part))
                node = nodes(doc, h, n)
                fresh = [not (x in seen or seen.add(x)) for x in node.tolist()]
                first = [t if f else None for t, f in zip(texts[at : at + len(part)], fresh, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(part)), b.column("digest").slice(at, len(part)),
                        pa.array(node), pa.array(n.astype(np.int64)), pa.array(first, pa.string()),
                    ],
                    ["doc_id", "digest", "node", "n_shingles", "text"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, digest long, node long, n_shingles long, text string")


PIECE = "key long, node long, rep long, sig long"


def _piece_rows(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows of pieces, joined as far as one task sees them.

    Of the nodes with one signature only the least goes on to meet other tasks' nodes
    (key: the signature); the others are joined to it here (key: any)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    same = ~first & (node == np.concatenate([node[:1], node[:-1]]))
    sig, node, first = sig[~same], node[~same], first[~same]
    rep = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    key = np.where(first, sig, mixed((sig ^ node).view(np.uint64)).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(node), pa.array(rep, mask=first), pa.array(sig, mask=first)], ["key", "node", "rep", "sig"]
    )


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many of a bounded sample of sets (node, text) have.

    They only settle which pieces are shown first; any list gives right results. With
    this one, documents do not meet for a passage that very many of them have."""
    chosen = docs.select("node").distinct().orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS)
    # A row per task and set at most, so a set that very many documents have stays small.
    sample = docs.join(F.broadcast(chosen), "node", "left_semi").dropDuplicates(["node"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in chunks(b.column("text").to_pylist()):
                _, h = shingle_sets(part)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counts = small_batches(sample).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= LEAST_IN_SAMPLE).orderBy(F.desc("n"), "h").limit(SAMPLE_SHINGLES).toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def piece_rows(docs: DataFrame) -> DataFrame:
    """Rows of PIECE of the sets that ``docs`` (node, text) has."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for _, part in chunks(b.column("text").to_pylist()):
                doc, h = shingle_sets(part)
                n = np.bincount(doc, minlength=len(part))
                node = nodes(doc, h, n)
                fresh = np.array([not (x in seen or seen.add(x)) for x in node.tolist()], bool)
                keep = fresh[doc]
                for lower in (False, True):
                    owner, sig, _ = pieces(doc[keep], h[keep], np.where(fresh, n, 0), lower, shared.value)
                    held.append((sig.view(np.int64), node[owner]))
                size += sum(map(len, part))
                if size >= LOCAL_BYTES:
                    yield _piece_rows(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield _piece_rows(*map(np.concatenate, zip(*held, strict=True)))

    return small_batches(docs.select("text")).mapInArrow(run, PIECE)


MEET = "sig long, node long, rep long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: groups of two nodes and more, joined to the least.
    The last key of a batch waits; it has a row per task and LOCAL_BYTES at most."""
    held_key, held_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        far = b.column("rep").is_null().to_numpy(zero_copy_only=False)
        near = b.filter(pa.array(~far))
        yield pa.RecordBatch.from_arrays([near.column("sig"), near.column("node"), near.column("rep")], ["sig", "node", "rep"])
        key = np.concatenate([held_key, b.column("key").to_numpy()[far]])
        node = np.concatenate([held_node, b.column("node").to_numpy()[far]])
        if not len(key):
            continue
        cut = int(np.flatnonzero(key == key[-1])[0])
        held_key, held_node = key[cut:], node[cut:]
        yield _joined(key[:cut], node[:cut])
    yield _joined(held_key, held_node)


def _joined(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    rep = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else node
    more = node != rep
    return pa.RecordBatch.from_arrays(
        [pa.array(key[more]), pa.array(node[more]), pa.array(rep[more])], ["sig", "node", "rep"]
    )


def sketches_of(docs: DataFrame) -> DataFrame:
    """node, bits of every document that ``docs`` (node, text) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node")
            for at, part in chunks(b.column("text").to_pylist()):
                doc, h = shingle_sets(part)
                bits = bit_sketches(doc, h, len(part))
                yield pa.RecordBatch.from_arrays(
                    [node.slice(at, len(part)), pa.array(list(bits), pa.list_(pa.int64()))], ["node", "bits"]
                )

    return small_batches(docs.select("node", "text")).mapInArrow(run, "node long, bits array<long>")


def may_link(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """The two lower bounds of the symmetric difference against its limit."""
    limit = F.floor((n_a + n_b) / 9)
    apart = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.abs(n_a - n_b) <= limit) & (apart <= limit)


def _shingles(text: str | None) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose words say that 100 * intersection >= 80 * union; rows come sorted by
    b, whose set is made once for successive pairs."""
    last, right = None, set()
    for b in batches:
        keep = []
        for text_a, text_b in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
            if text_b != last:
                last, right = text_b, _shingles(text_b)
            left = _shingles(text_a)
            both = len(left & right)
            keep.append(100 * both >= 80 * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are linked. ``sizes``: node, n_shingles, bits;
    ``texts``: node, text, of all nodes in question."""
    sides = {
        x: sizes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        for x in ("a", "b")
    }
    near = pairs.join(sides["a"], "a").join(sides["b"], "b").filter(
        may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"))
    )
    near = durable(near.select("a", "b"), "near")
    rows = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return durable(small_batches(rows.select("a", "b", "text_a", "text_b"), 64).mapInArrow(_verify, "a long, b long"), "linked")


def rarest_pieces(large: DataFrame, texts: DataFrame) -> DataFrame:
    """(sig, node, c): the pieces that the nodes of ``large`` (node, c) show when the order
    is by how many of them have a piece, the rarest first.

    Documents with a passage that very many have meet in its pieces without being
    alike. Any order that all share is a right one; this one shows such pieces last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for at, part in chunks(b.column("text").to_pylist()):
                doc, h = shingle_sets(part)
                n = np.bincount(doc, minlength=len(part))
                for lower in (False, True):
                    owner, sig, need = pieces(doc, h, n, lower, every=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(node[at + owner]), pa.array(np.full(len(owner), lower)),
                            pa.array(need.astype(np.int64)), pa.array(sig.view(np.int64)),
                        ],
                        ["node", "lower", "need", "sig"],
                    )

    # Dealt anew, as the work per text is much more than the join's.
    # Written, for ranges of nodes are drawn from it: they deal out as many texts to every task.
    dealt = durable(texts.join(large, "node").select("node", "text"), "large").repartitionByRange("node")
    rows = small_batches(dealt).mapInArrow(
        run, "node long, lower boolean, need long, sig long"
    )
    rows = durable(rows, "all_pieces")
    often = durable(rows.groupBy("sig").agg(F.count("*").alias("often")), "piece_counts")
    place = F.row_number().over(W.partitionBy("node", "lower").orderBy("often", "sig"))
    shown = rows.join(often, "sig").withColumn("_place", place).filter((F.col("_place") <= F.col("need")) & (F.col("often") > 1))
    return durable(shown.select("sig", "node").distinct().join(large, "node"), "rare_members")


def bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many bits each row of the one side differs in from each row of the other one. Of
    signed numbers the bits of their absolute values would be counted."""
    return np.bitwise_count((left[:, None, :] ^ right[None]).view(np.uint64)).sum(2)


def mixed_group_pairs(
    meets: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, block: int = BLOCK
) -> DataFrame | None:
    """Candidates in groups that are not in one component yet: members of different
    components whose bounds allow a link. None when there is no such group.

    Members of groups above ``block`` show their rarest pieces first; what then still
    is a large group is dealt into blocks, and a task compares two of them."""
    of = {x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in ("node", "rep")}
    told = (
        meets.join(of["node"], "node", "left").join(of["rep"], "rep", "left")
        .withColumns({f"c_{x}": F.coalesce(f"c_{x}", x) for x in ("node", "rep")})
    )
    open_ = durable(told.filter("c_node <> c_rep").select("sig").distinct(), "mixed")
    if not open_.head(1):
        return None
    rows = durable(told.join(open_, "sig"), "mixed_rows")
    members = durable(
        rows.select("sig", "node", F.col("c_node").alias("c"))
        .unionByName(rows.select("sig", F.col("rep").alias("node"), F.col("c_rep").alias("c")))
        .distinct(),
        "members",
    )
    counts = durable(members.groupBy("sig").agg(F.count("*").alias("n")), "member_counts")
    small = members.join(counts.filter(F.col("n") <= block), "sig").withColumn("blocks", F.lit(1))
    large = members.join(counts.filter(F.col("n") > block), "sig").select("node", "c").distinct()
    again = rarest_pieces(large, texts)
    often = again.groupBy("sig").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = (
        small.select("sig", "node", "c", "blocks")
        .unionByName(again.join(often, "sig").select("sig", "node", "c", "blocks"))
        .withColumn("mine", F.pmod(F.xxhash64("node", "sig"), F.col("blocks")).cast("int"))
    )
    met = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "c", "mine")
        .join(sizes, "node")
        .groupBy("sig", "i", "j")
        .agg(F.collect_list(F.struct("mine", "node", "c", "n_shingles", "bits")).alias("members"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, members in zip(*(b.column(c).to_pylist() for c in ("i", "j", "members")), strict=True):
                left = [m for m in members if m["mine"] == i]
                right = [m for m in members if m["mine"] == j]
                if not left or not right:
                    continue
                l, r = (
                    {k: np.array([m[k] for m in side], np.int64) for k in ("node", "c", "n_shingles", "bits")}
                    for side in (left, right)
                )
                limit = most_apart(l["n_shingles"][:, None], r["n_shingles"][None])
                apart = bits_apart(l["bits"], r["bits"])
                ok = (l["c"][:, None] != r["c"][None]) & (apart <= limit)
                ok &= np.abs(l["n_shingles"][:, None] - r["n_shingles"][None]) <= limit
                x, y = np.nonzero(ok)
                out_a.append(np.maximum(l["node"][x], r["node"][y]))
                out_b.append(np.minimum(l["node"][x], r["node"][y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return small_batches(met, 64).mapInArrow(run, "a long, b long").distinct()


def clusters(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, named, texts): the rows' ``profiles``; node, n_shingles, component and
    ``least``, the node's least (no id, doc_id, digest), of all sets with words; and node,
    n_shingles, text of the sets that are not alone.

    Rows meet by their sets alone; doc_id is carried and never a key, so rows that share
    one, or have none, are told apart by their texts.
    """
    profile = durable(profiles(docs), "profiles")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    reps = durable(
        profile.filter("n_shingles > 0").groupBy("node").agg(F.min(place).alias("least"), F.min("n_shingles").alias("n_shingles")),
        "nodes",
    )
    held = profile.filter("n_shingles > 0 AND text IS NOT NULL").select("node", "text")
    shuffled = piece_rows(held).repartition("key").sortWithinPartitions("key", "node")
    meets = durable(small_batches(shuffled, 2000).mapInArrow(_meet, MEET), "meets")
    pairs = meets.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    # Only texts that stand for a node with a candidate are fetched.
    asked = meets.select("node").unionByName(meets.select(F.col("rep").alias("node"))).distinct()
    wanted = reps.join(asked, "node").select("node", "n_shingles")
    texts = durable(held.join(wanted, "node").dropDuplicates(["node"]).select("node", "n_shingles", "text"), "texts")
    sizes = durable(texts.select("node", "n_shingles").join(sketches_of(texts), "node"), "sketches")
    links = verified(pairs, sizes, texts)
    labels = durable(components(links), "components")
    again = mixed_group_pairs(meets, labels, sizes, texts, block)
    if again is not None and (more := verified(again, sizes, texts)).head(1):
        # Stars of what is joined already, and the new links.
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = durable(components(stars.unionByName(more)), "components")
    named = durable(
        reps.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "named"
    )
    return profile, named, texts


def _links_of(left: np.ndarray, right: np.ndarray, owner_l: np.ndarray, owner_r: np.ndarray, n_l: np.ndarray, n_r: np.ndarray) -> Iterator[np.ndarray]:
    """For each set of the left side, which of the right side's sets are linked to it.
    ``left``, ``right``: shingle hashes by set (``owner_l``, ``owner_r``)."""
    order = np.argsort(right, kind="stable")
    right, owner_r = right[order], owner_r[order]
    low, high = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    at = np.searchsorted(owner_l, np.arange(len(n_l) + 1))
    for i in range(len(n_l)):
        a, n = low[at[i] : at[i + 1]], (high - low)[at[i] : at[i + 1]]
        entry = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner_r[entry], minlength=len(n_r))
        yield 100 * both >= 80 * (n_l[i] + n_r - both)


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, i and j; one group of two blocks is held at a time."""

    def counted(group: tuple, members: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        _, i, j = group
        sides = []
        for side in (i, j):
            node = np.array([m[1] for m in members if m[0] == side], np.int64)
            doc, h = shingle_sets([m[2].encode("utf-8", "surrogatepass") for m in members if m[0] == side])
            sides.append((node, doc, h, np.bincount(doc, minlength=len(node))))
        (node_l, doc_l, h_l, n_l), (node_r, doc_r, h_r, n_r) = sides
        out_l, out_r = np.zeros(len(node_l), np.int64), np.zeros(len(node_r), np.int64)
        for k, linked in enumerate(_links_of(h_l, h_r, doc_l, doc_r, n_l, n_r)):
            out_l[k] = linked.sum()
            out_r += linked
        if i == j:
            return node_l, out_l - 1  # a set is no link of its own
        return np.concatenate([node_l, node_r]), np.concatenate([out_l, out_r])

    now, held = None, []
    for b in batches:
        node, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for *group, mine, name, text in zip(
            *(b.column(c).to_pylist() for c in ("component", "i", "j", "mine", "node", "text")), strict=True
        ):
            if group != now and held:
                for out, x in zip((node, n), counted(now, held), strict=True):
                    out.append(x)
                held = []
            now = group
            held.append((mine, name, text))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(n))], ["node", "n"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in counted(now, held)], ["node", "n"])


def link_counts(named: DataFrame, texts: DataFrame, count_shingles: int = COUNT_SHINGLES) -> DataFrame:
    """node, n_links: with how many other sets each set of a component is linked.

    ``named``: node, n_shingles, component; ``texts``: node, text."""
    several = named.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).filter("n > 1")
    several = several.select("component", F.ceil(F.col("size") / count_shingles).cast("int").alias("blocks"))
    dealt = (
        named.select("component", "node").join(several, "component")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(texts.select("node", "text"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "text")
    )
    met = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    counts = small_batches(met).mapInArrow(_count_links, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n_links"))


def near_duplicates(docs: DataFrame, block: int = BLOCK, count_shingles: int = COUNT_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (how many other distinct sets the
    document's set is linked to; copies of a set count once).

    A component is named by its least doc_id; a null id only where no row of it has one.
    Documents without words are alone. Null texts are empty. Rows that share a doc_id, or
    have none, get a row each by their own text and may be in different components. An
    empty table gives an empty result; other columns are ignored.
    """
    profile, named, texts = clusters(docs, block)
    degree = link_counts(named, texts, count_shingles).withColumnRenamed("node", "a")
    # Each component's least document.
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    table = named.join(least, "component").join(degree, F.col("node") == F.col("a"), "left").select(
        F.col("node").alias("_node"), F.col("first.doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    out = profile.join(table, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def op3_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the least doc_id, rows without an id
    last, then the least digest of the text. Documents without words stay, but of rows
    with equal id and text one."""
    profile, named, _ = clusters(docs)
    kept = named.groupBy("component").agg(F.min("least").alias("first")).select("first.doc_id", "first.digest")
    empty = profile.filter("n_shingles = 0").select("doc_id", "digest").distinct()
    id_, digest_ = unused(docs, "_id"), unused(docs, "_digest")
    stay = kept.unionByName(empty).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (digest(F.col("text")) == F.col(digest_))
    return docs.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"])
