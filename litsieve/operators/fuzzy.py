"""Near-duplicate titles: exact similarity self-join, keep the first of a group.

Semantics: going through the rows in order, a row is dropped when an earlier
*kept* row is similar to it, and its leader is the first such row.

How it scales:

* rows with the same normalised title collapse to their first row; they are
  put back at the end with that row's leader;
* where the threshold allows it and the input is large, candidate pairs meet on
  a shared part (a rare substring or word that similar titles must have in
  common), hot parts cut into blocks; otherwise they meet in cells of the length
  band, every cell cut into blocks of bounded size, so that a length a third of
  the titles share is spread over many tasks. Both find the same pairs;
* two blocks that meet decide their pairs on the spot: each copy of a row brings its text,
  and the task compares whole tiles of pairs by letters, then by runs of letters and common
  subsequence (``functions/near.py``). The pairs that pass the first test are too many (with
  the square of the rows) to be shuffled. The join on parts carries row ids and letter
  profiles, and its few pairs fetch their texts;
* when many rows resemble each other, the work goes in order-prefixes: settle a
  prefix, strike out everything its kept rows cover, go on with what is left. A
  large group of near copies then costs one comparison per copy, not one per
  pair of copies. Nothing is capped or sampled away.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from litsieve.functions.near import similar_rows
from litsieve.functions.similarity import GRAM_WORDS, MEASURES, WORDS, Measure, bits_missing, gram_profile  # noqa: F401
from litsieve.functions.text import normalise_title
from litsieve.operators.skew import lookup_by_key
from litsieve.session import durable

LENGTH_BAND = 20
# Letters that no title has.
MOST_LETTERS = 1 << 31
# Cells above this number are one cell, so that tables per cell stay tiny.
MAX_CELL = 4095
# Letters above which a title counts as several rows of a block.
ROW_LETTERS = 1000
# Rows of a block: as many as give each core some pairs of blocks, between these.
BLOCK_ROWS = (512, 32_768)
# Copies per row above which blocks of a stated size are made larger.
MOST_COPIES = 16
# Rounds of decisions before components are walked through, and the edges of one that a
# task may hold.
ROUNDS = 3
COMPONENT_EDGES = 2_000_000
# Tasks of one comparison at most, in all and for each core.
MOST_TASKS = 20_000
TASKS_PER_CORE = 32
# More meetings per row than this make the shared-part route the cheaper one.
MEETINGS_PER_ROW = 20_000
# Parts per title above which that route would copy more than the blocks do.
MOST_PARTS = 32
# Rows of one part above which its group is cut.
HOT_PART = 65_536
# Up to this many rows no look-ahead for dense groups is needed.
PROBE_ROWS = 8192
# Edges a prefix may be expected to have, per row that is still undecided.
EDGES_PER_ROW = 32


def representatives(
    df: DataFrame, key: str, order: str, measure: Measure, band: int | None
) -> DataFrame:
    """One line per distinct non-empty normalised title, at its first row. ``cell``: similar
    titles are in the same or the next one, by length, or by size where there is no band."""
    titles = (
        df.select(F.col(order).alias("ord"), normalise_title(F.col(key)).alias("norm"))
        .filter(F.col("norm") != "")
        .groupBy("norm")
        .agg(F.min("ord").alias("ord"), F.count("*").alias("n_rows"))
    )
    # Profiles take far longer than their bytes suggest, so partitions must not be merged by size.
    titles = titles.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "norm")
    titles = measure.profile(titles).withColumn("len", F.length("norm")).withColumn("size", measure.size(F.col("norm")))
    cell = F.floor(F.log("size") / measure.size_step) if band is None else F.floor(F.col("len") / (band + 1))
    return titles.withColumn("cell", F.least(cell, F.lit(MAX_CELL)))


def _cells(rows: DataFrame) -> dict[int, int]:
    """Rows per cell, long ones as several, at most MAX_CELL + 1 pairs of numbers."""
    counts = rows.groupBy("cell").agg(F.sum(F.ceil(F.length("norm") / ROW_LETTERS)).cast("long").alias("n"))
    return {r["cell"]: r["n"] for r in counts.collect()}


def _meetings(one: dict[int, int], two: dict[int, int]) -> int:
    """Pairs of rows the length cells alone would bring together."""
    return sum(n * two.get(c + d, 0) for c, n in one.items() for d in (-1, 0, 1))


def _block_rows(spark: SparkSession, one: dict[int, int], two: dict[int, int]) -> int:
    tasks = 64 * spark.sparkContext.defaultParallelism
    least, most = BLOCK_ROWS
    return min(max(int((_meetings(one, two) / tasks) ** 0.5), least), most)


def _stated_rows(block_rows: int, most: int, one: dict[int, int], two: dict[int, int]) -> int:
    """A stated block size, doubled up to ``most`` while rows would have too many copies:
    their number per row grows with the rows of a cell."""

    def copies(size: int) -> int:
        sides = [(one, two)] if one is two else [(one, two), (two, one)]
        return sum(_meetings(x, {c: -(-n // size) for c, n in y.items()}) for x, y in sides)

    rows = sum(one.values()) + (0 if one is two else sum(two.values()))
    while block_rows < most and copies(block_rows) > MOST_COPIES * rows:
        block_rows = min(2 * block_rows, most)
    return block_rows


def _blocks(spark: SparkSession, cells: dict[int, int], block_rows: int) -> DataFrame:
    """Blocks per cell, as a literal table in the plans."""
    lines = ", ".join(f"({c}L, {-(-n // block_rows)}L)" for c, n in cells.items())
    if not lines:
        return spark.sql("SELECT 0L AS cell, 0L AS blocks WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t(cell, blocks)")


def _tasks(spark: SparkSession, one: dict[int, int], two: dict[int, int], block_rows: int) -> int:
    """Pairs of blocks that meet, or some for each core."""
    n = {c: -(-x // block_rows) for c, x in one.items()}
    m = {c: -(-x // block_rows) for c, x in two.items()}
    return max(1, min(MOST_TASKS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism, sum(x * m.get(c + d, 0) for c, x in n.items() for d in (-1, 0, 1))))


def _fan_out(
    rows: DataFrame, own: DataFrame, other: DataFrame, steps: list[int], upper: int
) -> DataFrame:
    """Put every row next to all blocks of the other side it has to meet.

    ``steps`` are the cell distances to the other side. ``upper`` is 1 (blocks
    from the own number up) or -1 (down to it) for the own cell of a self-join,
    so that a pair of blocks meets once; 0 meets all blocks.
    """
    here = rows.join(F.broadcast(own), "cell").selectExpr(
        *rows.columns, "pmod(xxhash64(ord), blocks) AS block"
    )
    targets = other.selectExpr(
        f"explode(array({', '.join(str(s) for s in steps)})) AS step", "cell AS other_cell", "blocks"
    ).selectExpr("other_cell - step AS cell", "other_cell", "blocks - 1 AS last")
    first = "if(cell = other_cell, block, 0L)" if upper > 0 else "0L"
    last = "if(cell = other_cell, block, last)" if upper < 0 else "last"
    return here.join(F.broadcast(targets), "cell").selectExpr(
        *here.columns, "other_cell", f"explode(sequence({first}, {last})) AS other_block"
    )


LETTERS = ["len", "size", *[f"p{k}" for k in range(WORDS)]]


def _cheap_tests(band: int | None, measure: Measure) -> list[Column]:
    """Length band, or sizes that can be similar, then the profile test, for sides l and r."""
    need = measure.need(F.col("l_size"), F.col("r_size"))
    near = F.least("l_size", "r_size") >= need if band is None else F.abs(F.col("l_len") - F.col("r_len")) <= band
    return [near, F.expr(bits_missing("l", "r")) <= F.col("l_size") - need]


def _in_turn(tests: list[Column]) -> Column:
    """All tests hold. CASE keeps their order: the optimiser moves filters into the
    join condition and would put the costly ones first."""
    return reduce(lambda rest, t: F.when(~t, False).otherwise(rest), reversed(tests[:-1]), tests[-1])


def _with_texts(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, measure: Measure) -> DataFrame:
    """Similar pairs of the (lo, hi) that passed the cheap tests."""
    texts = left.select("ord", "norm")
    if right is not left:
        texts = texts.union(right.select("ord", "norm"))

    def side(key: str, name: str) -> DataFrame:
        return texts.select(F.col("ord").alias(key), F.col("norm").alias(name))

    found = pairs.join(side("lo", "a"), "lo").join(side("hi", "b"), "hi")
    return _scored(found.filter(measure.screen(F.col("a"), F.col("b"))), threshold, measure)


def _scored(pairs: DataFrame, threshold: float, measure: Measure) -> DataFrame:
    scored = pairs.withColumn("similarity", measure.score(F.col("a"), F.col("b")))
    if not measure.decided_by_screen:
        scored = scored.filter(F.col("similarity") >= threshold)
    return scored.select("lo", "hi", "similarity")


def _near(
    left: DataFrame, right: DataFrame, texts: DataFrame, self_join: bool, threshold: float, band: int | None, measure: Measure, tasks: int
) -> DataFrame:
    """Similar pairs (lo, hi, similarity) of the rows that meet, lo before hi."""
    if measure.bounds:
        return _near_blocks(left, right, texts, self_join, band, measure, tasks)
    return _scored(_near_rows(left, right, self_join, band, measure, tasks), threshold, measure)


PLACE = ["k1", "k2", "k3", "k4"]
HERE, THERE = ["cell", "block", "other_cell", "other_block"], ["other_cell", "other_block", "cell", "block"]


def _at(places: list[str]) -> list[str]:
    # Columns known not to be null keep generated tests short enough for the JIT compiler.
    return [f"coalesce({c}, 0L) AS {k}" for c, k in zip(places, PLACE)]


def _near_blocks(left: DataFrame, right: DataFrame, texts: DataFrame, self_join: bool, band: int | None, measure: Measure, tasks: int) -> DataFrame:
    """Similar pairs: whole blocks are compared, in Arrow. Ids fan out, and each copy fetches
    its text."""
    copies = left.selectExpr("ord", *_at(HERE), "true AS left").unionByName(right.selectExpr("ord", *_at(THERE), "false AS left"))
    kind = left.schema["ord"].dataType.simpleString()
    # A stated number of partitions: the work per byte is high and uneven here, so
    # they must not be merged by size.
    return (
        copies.join(texts.select("ord", "norm"), "ord")
        .repartition(tasks, *PLACE)
        .sortWithinPartitions(*PLACE)
        .mapInArrow(similar_rows(measure.bounds, band, PLACE, self_join), f"lo {kind}, hi {kind}, similarity double")
    )


def _near_rows(left: DataFrame, right: DataFrame, self_join: bool, band: int | None, measure: Measure, tasks: int) -> DataFrame:
    """Pairs (lo, hi, a, b) that pass the screen, row by row by the profiles."""

    def side(rows: DataFrame, name: str, places: list[str]) -> DataFrame:
        numbers = [f"coalesce({c}, 0) AS {name}_{c}" for c in LETTERS]
        return rows.selectExpr(f"ord AS {name}_ord", f"norm AS {name}_norm", *numbers, *_at(places))

    l, r = side(left, "l", HERE), side(right, "r", THERE)
    tests = _cheap_tests(band, measure)
    if self_join:
        same = (F.col("l.k1") == F.col("l.k3")) & (F.col("l.k2") == F.col("l.k4"))
        tests[0] = tests[0] & (~same | (F.col("l_ord") < F.col("r_ord")))
    tests.append(measure.screen(F.col("l_norm"), F.col("r_norm")))
    meet = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in PLACE])
    pairs = l.repartition(tasks, *PLACE).alias("l").join(r.repartition(tasks, *PLACE).alias("r"), meet & _in_turn(tests))
    first = F.col("l_ord") < F.col("r_ord")
    a, b = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("l_norm", "r_norm"), ("r_norm", "l_norm")))
    return pairs.select(F.least("l_ord", "r_ord").alias("lo"), F.greatest("l_ord", "r_ord").alias("hi"), a.alias("a"), b.alias("b"))


def _share_rows(rows: DataFrame, band: int | None, measure: Measure) -> DataFrame:
    """Titles with ``keys``, the parts one of which a similar title must have.

    Two similar titles lack at most ``lack`` of each other's parts. In one fixed
    order of all parts, their first ``lack + 1`` parts then have one in common,
    unless both titles have no more than ``lack`` parts (``poor``). Long titles count as
    poor too; those that no shorter one can be similar to need no keys.
    """
    shorter = f"len * exp(-{measure.size_step})" if band is None else f"len - {band}"
    long, alone = _long(measure, "len"), _long(measure, shorter)
    return (
        rows.withColumn("parts", F.when(alone, F.array().cast("array<string>")).otherwise(F.array_sort(measure.parts(F.col("norm")))))
        .withColumn("lack", _may_lack(measure, band))
        .withColumn("poor", (F.size("parts") <= F.col("lack")) | long)
        .withColumn("keys", F.expr("slice(parts, 1, lack + 1)"))
        .drop("parts", "lack")
    )


def _long(measure: Measure, length: str) -> Column:
    return F.expr(f"{length} > {measure.parts_up_to}") if measure.parts_up_to else F.lit(False)


def _may_lack(measure: Measure, band: int | None) -> Column:
    return F.expr(f"cast(greatest({measure.may_lack.format(band=MOST_LETTERS if band is None else band)}, 0) AS int)")


def _by_shared_part(
    left: DataFrame,
    right: DataFrame,
    self_join: bool,
    threshold: float,
    band: int | None,
    measure: Measure,
    hot_rows: int,
) -> DataFrame:
    """Similar pairs of which at least one title is not poor.

    A title has many parts, so each copy carries the letter profile only; titles that
    share a part have letters in common anyway. Rows meet on (length cell, shared part). A group above ``hot_rows`` rows is
    cut into blocks on both sides, and every pair of blocks is a group of its own.
    """
    l = left.select("ord", "poor", "cell", *LETTERS, F.explode("keys").alias("part"))
    r = right.select("ord", "poor", "cell", *LETTERS, F.explode("keys").alias("part"))
    groups = l.select("cell", "part")
    if not self_join:
        groups = groups.union(r.select("cell", "part"))
    # At most (rows * keys per row) / hot_rows lines.
    hot = durable(
        groups.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
        .select("part", F.ceil(F.col("n") / hot_rows).alias("cuts")),
        "hot-parts",
    )
    steps = "0, 1" if self_join else "-1, 0, 1"
    l = (
        l.join(hot, "part", "left")
        .selectExpr(
            "ord AS l_ord", "poor AS l_poor", "part", "cell",
            "pmod(xxhash64(ord), coalesce(cuts, 1L)) AS cut", "coalesce(cuts, 1L) AS cuts",
            *[f"coalesce({c}, 0) AS l_{c}" for c in LETTERS],
            f"explode(array({steps})) AS step",
        )
        .withColumn("at", F.expr("cell + step"))
        .withColumn("other_cut", F.expr("explode(sequence(0L, cuts - 1))"))
    )
    r = r.join(hot, "part", "left").selectExpr(
        "ord AS r_ord", "poor AS r_poor", "part", "cell AS at",
        *[f"coalesce({c}, 0) AS r_{c}" for c in LETTERS],
        "pmod(xxhash64(ord), coalesce(cuts, 1L)) AS other_cut",
        "explode(sequence(0L, coalesce(cuts, 1L) - 1)) AS cut",
    )
    tests = _cheap_tests(band, measure)
    tests[0] = tests[0] & ~(F.col("l_poor") & F.col("r_poor"))
    if self_join:
        tests[0] = tests[0] & ((F.col("step") != 0) | (F.col("l_ord") < F.col("r_ord")))
    meet = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("part", "at", "cut", "other_cut")])
    pairs = (
        l.alias("l")
        .join(r.alias("r"), meet & _in_turn(tests))
        .select(F.least("l_ord", "r_ord").alias("lo"), F.greatest("l_ord", "r_ord").alias("hi"))
        .distinct()
    )
    return _with_texts(pairs, left, right, threshold, measure)


def _takes_parts(route: str, measure: Measure, left: DataFrame, right: DataFrame, n: int, band: int | None) -> bool:
    if measure.parts is None or route != "auto":
        return route == "parts" and measure.parts is not None
    one = _cells(left)
    if _meetings(one, one if right is left else _cells(right)) <= MEETINGS_PER_ROW * n:
        return False
    keys = left.filter(~_long(measure, "len")).agg(F.avg(_may_lack(measure, band) + 1)).first()[0]
    return keys is not None and keys <= MOST_PARTS


def edges_within(
    rows: DataFrame,
    n: int,
    threshold: float,
    band: int | None,
    measure: Measure,
    block_rows: int | None = None,
    route: str = "auto",
    hot_part: int = HOT_PART,
) -> DataFrame:
    """Similar pairs (lo, hi, similarity) among ``rows`` (about ``n`` of them).

    ``route`` "blocks" compares inside the length band, "parts" only titles that
    share a part plus the poor ones inside the band; "auto" takes the cheaper.
    """
    if _takes_parts(route, measure, rows, rows, n, band):
        keyed = durable(_share_rows(rows, band, measure), "keyed")
        shared = _by_shared_part(keyed, keyed, True, threshold, band, measure, hot_part)
        poor = keyed.filter("poor")
        return shared.union(
            edges_within(poor, n, threshold, band, measure, block_rows, "blocks")
        )
    cells = _cells(rows)
    size = _block_rows(rows.sparkSession, cells, cells)
    size = _stated_rows(block_rows, size, cells, cells) if block_rows else size
    blocks = _blocks(rows.sparkSession, cells, size)
    slim = rows.select("ord", "cell", "norm", *([] if measure.bounds else LETTERS))
    left = _fan_out(slim, blocks, blocks, [0, 1], 1)
    right = _fan_out(slim, blocks, blocks, [0, -1], -1)
    return _near(left, right, rows, True, threshold, band, measure, _tasks(rows.sparkSession, cells, cells, size))


def edges_between(
    kept: DataFrame,
    rest: DataFrame,
    n: int,
    threshold: float,
    band: int | None,
    measure: Measure,
    block_rows: int | None = None,
    route: str = "auto",
    hot_part: int = HOT_PART,
) -> DataFrame:
    """Similar pairs with one row in each input (about ``n`` rows in all)."""
    if _takes_parts(route, measure, kept, rest, n, band):
        one, two = (durable(_share_rows(x, band, measure), "keyed") for x in (kept, rest))
        shared = _by_shared_part(one, two, False, threshold, band, measure, hot_part)
        return shared.union(
            edges_between(
                one.filter("poor"), two.filter("poor"), n, threshold, band, measure, block_rows, "blocks"
            )
        )
    spark, one, two = kept.sparkSession, _cells(kept), _cells(rest)
    size = _block_rows(spark, one, two)
    size = _stated_rows(block_rows, size, one, two) if block_rows else size
    kept_blocks, rest_blocks = _blocks(spark, one, size), _blocks(spark, two, size)
    slim = ["ord", "cell", "norm", *([] if measure.bounds else LETTERS)]
    left = _fan_out(kept.select(slim), kept_blocks, rest_blocks, [-1, 0, 1], 0)
    right = _fan_out(rest.select(slim), rest_blocks, kept_blocks, [-1, 0, 1], 0)
    return _near(left, right, kept.select("ord", "norm").union(rest.select("ord", "norm")), False, threshold, band, measure, _tasks(spark, one, two, size))


def leaders(edges: DataFrame, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """Dropped rows with their leader: (hi, lo, similarity).

    While some row both points and is pointed at: the rows nothing undecided points at
    are kept, the rows they point at are dropped with all their edges. Once no row does
    both, all pointing rows are kept; stars need no round. What ``ROUNDS`` of them leave
    open are long chains of dependent decisions: those go on by component, each one of
    up to ``component_edges`` edges walked through in order by one task. Larger ones get
    rounds until they are settled. ``edges`` must be durable.
    """
    edges = edges.filter("lo < hi")
    live, dropped, rounds = edges.select("lo", "hi"), [], 0
    while True:
        targets = live.selectExpr("hi AS lo")
        if live.join(targets, "lo", "left_semi").isEmpty():
            break
        if rounds == ROUNDS:
            walked, live = _walk_components(live, component_edges)
            dropped.append(walked)
            rounds += 1
            continue
        rounds += 1
        heads = live.select("lo").join(targets, "lo", "left_anti").distinct()
        gone = durable(live.join(heads, "lo", "left_semi").select("hi").distinct(), "dropped")
        dropped.append(gone.selectExpr("hi AS lo"))
        live = durable(
            live.join(gone, "hi", "left_anti").join(dropped[-1], "lo", "left_anti"), "live"
        )
    if dropped:
        edges = edges.join(reduce(DataFrame.union, dropped), "lo", "left_anti")
    return first_leader(edges)


def _walk_components(live: DataFrame, component_edges: int) -> tuple[DataFrame, DataFrame]:
    """(dropped rows of the components that fit into a task, edges of the others)."""
    named = durable(live.join(components(live), F.col("lo") == F.col("node")).select("component", "lo", "hi"), "named")
    # One line per component that is too large, at most edges / component_edges.
    large = named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > component_edges)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, gone = None, None, set()
        for batch in batches:
            out = []
            for component, hi, lo in zip(*(batch.column(c).to_pylist() for c in ("component", "hi", "lo")), strict=True):
                if component != now:
                    now, gone = component, set()
                # Rows come in order, so all earlier ones are settled.
                if lo not in gone and hi not in gone:
                    gone.add(hi)
                    out.append(hi)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column("hi").type)], ["lo"])

    small = named.join(large, "component", "left_anti").select("component", "hi", "lo")
    kind = live.schema["hi"].dataType.simpleString()
    dropped = small.repartition("component").sortWithinPartitions("component", "hi", "lo").mapInArrow(walk, f"lo {kind}")
    rest = named.join(large, "component", "left_semi").select("lo", "hi")
    return durable(dropped, "walked"), durable(rest, "live")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (lo, hi): component is the least node.

    Each node is told the least name among itself and its neighbours, then the name that
    this one was told, and so on: names halve their distance to the least, so a chain
    takes a number of written tables that grows with the logarithm of its length.
    """
    both = durable(edges.select("lo", "hi").unionByName(edges.selectExpr("hi AS lo", "lo AS hi")).distinct(), "both")
    names = durable(both.groupBy(F.col("lo").alias("node")).agg(F.least(F.min("hi"), F.first("lo")).alias("component")), "names")
    while True:
        far = names.select(F.col("node").alias("_node"), F.col("component").alias("_far"))
        # Least name next door, then that name's own.
        near = (
            both.join(far, F.col("hi") == F.col("_node")).groupBy(F.col("lo").alias("node")).agg(F.min("_far").alias("_near"))
        )
        better = names.join(near, "node").select("node", "component", F.least("component", "_near").alias("_least"))
        # A node's old name hears of the better one too, so whole trees move.
        told = durable(
            better.select("node", F.col("_least").alias("component"))
            .unionByName(better.select(F.col("component").alias("node"), F.col("_least").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component")),
            "told",
        )
        far = told.select(F.col("node").alias("_node"), F.col("component").alias("_far"))
        after = durable(
            told.join(far, F.col("component") == F.col("_node")).select("node", F.least("component", "_far").alias("component")), "names"
        )
        moved = after.join(names.select("node", F.col("component").alias("_was")), "node").filter("component <> _was")
        if moved.isEmpty():
            return after
        names = after


def first_leader(edges: DataFrame) -> DataFrame:
    best = F.min_by("similarity", "lo")
    return edges.groupBy("hi").agg(F.min("lo").alias("lo"), best.alias("similarity"))


def _prefix_end(rows: DataFrame, n: int, probe_rows: int, edges_per_row: int, join):
    """Order value up to which the expected number of edges stays in budget.

    Looks at the edges among a hash-picked part of ``probe_rows`` rows, for the
    size of the next step only; None means all rows at once.
    """
    every = -(-n // probe_rows)
    part = rows.filter(F.pmod(F.xxhash64("ord", F.lit(7)), F.lit(every)) == 0)
    found = join(part, probe_rows).groupBy(F.col("hi").alias("ord")).agg(F.count("*").alias("n"))
    # About probe_rows lines of two numbers.
    steps = part.select("ord").join(found, "ord", "left").orderBy("ord").collect()
    total, end = 0, None
    for i, step in enumerate(steps):
        total += step["n"] or 0
        if total * every * every > edges_per_row * n and i > 0:
            return end
        end = step["ord"]
    return None


def settle(
    reps: DataFrame,
    threshold: float,
    band: int | None,
    measure: Measure,
    block_rows: int | None = None,
    probe_rows: int = PROBE_ROWS,
    edges_per_row: int = EDGES_PER_ROW,
    route: str = "auto",
    hot_part: int = HOT_PART,
) -> DataFrame:
    """Dropped representatives (hi, lo, similarity). ``reps`` must be durable."""

    def within(rows: DataFrame, size: int) -> DataFrame:
        return edges_within(rows, size, threshold, band, measure, block_rows, route, hot_part)

    found, open_rows = [], reps
    while True:
        n = open_rows.count()
        end = None
        if n > probe_rows:
            end = _prefix_end(open_rows, n, probe_rows, edges_per_row, within)
        prefix = open_rows if end is None else open_rows.filter(F.col("ord") <= F.lit(end))
        hits = leaders(durable(within(prefix, n), "edges"))
        if end is None:
            found.append(hits)
            break
        hits = durable(hits, "hits")
        found.append(hits)
        rest = open_rows.filter(F.col("ord") > F.lit(end))
        kept = prefix.join(hits.select(F.col("hi").alias("ord")), "ord", "left_anti")
        covered = durable(
            first_leader(
                edges_between(kept, rest, n, threshold, band, measure, block_rows, route, hot_part)
            ),
            "covered",
        )
        found.append(covered)
        open_rows = durable(
            rest.join(covered.select(F.col("hi").alias("ord")), "ord", "left_anti"), "open"
        )
    return reduce(DataFrame.unionByName, found)


def fuzzy_matches(
    df: DataFrame,
    key: str = "title",
    order: str = "ord",
    threshold: float = 0.95,
    band: int | None = LENGTH_BAND,
    metric: str = "ratcliff",
    autojunk: bool = True,
    hot_rows: int | None = None,
    numbered: bool = False,
    **sizes,
) -> DataFrame:
    """Rows to drop: (member, leader, similarity), by value of ``order``, which must
    tell rows apart (a repeated value raises; ``numbered`` says that it surely does).
    Titles whose lengths differ by more than ``band`` are not compared, as in the
    original; None compares all that can reach the threshold."""
    repeated = None if numbered else df.groupBy(order).agg(F.count("*").alias("n")).filter("n > 1").head(1)
    if repeated:
        raise ValueError(f"{order} = {repeated[0][0]} stands in more than one row")
    options = {"autojunk": autojunk} if metric == "ratcliff" else {}
    measure = MEASURES[metric](threshold, **options)
    reps = durable(representatives(df, key, order, measure, band), "titles")
    hits = settle(reps, threshold, band, measure, **sizes)
    groups = (
        reps.select("norm", F.col("ord").alias("rep"), "n_rows")
        .join(
            hits.select(F.col("hi").alias("rep"), F.col("lo").alias("leader"), "similarity"),
            "rep",
            "left",
        )
        .filter((F.col("n_rows") > 1) | F.col("leader").isNotNull())
    )
    rows = df.select(F.col(order).alias("member"), normalise_title(F.col(key)).alias("norm"))
    skew = {"hot_rows": hot_rows} if hot_rows else {}
    return (
        lookup_by_key(rows, groups, ["norm"], "member", **skew)
        .filter(F.col("leader").isNotNull() | (F.col("member") != F.col("rep")))
        .select(
            "member",
            F.coalesce("leader", "rep").alias("leader"),
            F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
        )
    )


def similar_pairs(df: DataFrame, key: str = "title", order: str = "ord", **options) -> DataFrame:
    """(ord1, ord2, title1, title2, similarity), leader first."""
    hits = durable(fuzzy_matches(df, key, order, **options), "matches")
    text = df.select(F.col(order).alias("_ord"), F.col(key).alias("_key"))
    return (
        hits.join(text.select(F.col("_ord").alias("leader"), F.col("_key").alias("title1")), "leader")
        .join(text.select(F.col("_ord").alias("member"), F.col("_key").alias("title2")), "member")
        .select(
            F.col("leader").alias("ord1"),
            F.col("member").alias("ord2"),
            "title1",
            "title2",
            "similarity",
        )
    )


def fuzzy_dedup(df: DataFrame, key: str = "title", order: str = "ord", **options) -> DataFrame:
    """``df`` without the near duplicates; unchanged when there are none."""
    hits = fuzzy_matches(df, key, order, **options)
    return df.join(hits.select(F.col("member").alias(order)), order, "left_anti").select(df.columns)


def fuzzy_tags(df: DataFrame, key: str = "title", order: str = "ord", **options) -> DataFrame:
    """All rows with ``is_duplicate``, ``leader_id`` and ``similarity``."""
    hits = fuzzy_matches(df, key, order, **options).select(
        F.col("member").alias(order), F.col("leader").alias("leader_id"), "similarity"
    )
    return df.join(hits, order, "left").select(
        *df.columns,
        F.col("leader_id").isNotNull().alias("is_duplicate"),
        "leader_id",
        "similarity",
    )


def first_row_per_title(df: DataFrame, key: str = "title", order: str = "ord") -> DataFrame:
    """Title lookup: the first row that carries each title."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def band_profile(
    df: DataFrame, key: str = "title", order: str = "ord", band: int = LENGTH_BAND
) -> DataFrame:
    """Per title length: (len, titles, band_titles), the titles it is compared with
    counted from the length histogram, so no pair is formed."""
    lengths = df.select(F.length(normalise_title(F.col(key))).alias("len"))
    counts = lengths.groupBy("len").agg(F.count("*").alias("titles"))
    reach = F.sequence(F.col("len") - band, F.col("len") + band)
    near = counts.select(F.explode(reach).alias("len"), F.col("titles").alias("near"))
    return (
        counts.join(near, "len")
        .groupBy("len")
        .agg(F.max("titles").alias("titles"), F.sum("near").alias("band_titles"))
    )


def scored_pairs(
    df: DataFrame,
    key: str = "title",
    order: str = "ord",
    threshold: float = 0.95,
    band: int | None = LENGTH_BAND,
    metric: str = "ratcliff",
    **sizes,
) -> DataFrame:
    """Every pair of distinct titles at or above ``threshold`` with its score:
    (lo, hi, similarity), also those between dropped rows. As large as there are
    similar pairs; the dedup itself never forms this table for a dense group."""
    measure = MEASURES[metric](threshold)
    reps = durable(representatives(df, key, order, measure, band), "titles")
    return edges_within(reps, reps.count(), threshold, band, measure, **sizes)


def comparison_count(
    df: DataFrame,
    matches: DataFrame,
    key: str = "title",
    order: str = "ord",
    band: int | None = LENGTH_BAND,
    ranges: int = 256,
) -> DataFrame:
    """One line: how many comparisons the one-by-one procedure makes.

    A kept row i is compared with a later row j inside the length band while j is
    open, that is up to j's leader. So for each j the kept rows up to its leader
    (or before itself) are counted, from running counts per length and range of
    the order; no pair is formed.
    """
    # Without a band all lengths are as one.
    length, band = (F.lit(0), 0) if band is None else (F.length(normalise_title(F.col(key))), band)
    rows = durable(
        df.select(F.col(order).alias("ord"), length.alias("len"))
        .join(matches.selectExpr("member AS ord", "leader"), "ord", "left"),
        "lengths",
    )
    # About ``ranges`` order values.
    steps = ", ".join(str(i / ranges) for i in range(1, ranges))
    cuts = rows.selectExpr(f"percentile_approx(ord, array({steps})) AS c").first()["c"] or []
    bounds = "array(" + ", ".join(f"{c}L" for c in sorted(set(cuts))) + ")"
    span = f"size(filter({bounds}, c -> c < at)) AS range"
    # Kept rows count from just after themselves, asking rows look before theirs.
    kept = rows.filter("leader IS NULL").selectExpr(
        "len", "ord AS at", "0L AS asks", "1L AS kept", "1 AS late"
    ).selectExpr("*", span)
    asking = (
        rows.selectExpr(
            "len", "coalesce(leader, ord) AS at", "if(leader IS NULL, 0, 2) AS late"
        )
        .groupBy("len", "at", "late")
        .agg(F.count("*").alias("asks"))
        .selectExpr("*", span)
        .selectExpr(
            f"explode(sequence(greatest(len - {band}, 0), len + {band})) AS len",
            "at", "asks", "0L AS kept", "late", "range",
        )
    )
    events = kept.unionByName(asking)
    inside = Window.partitionBy("len", "range").orderBy("at", "late")
    before = Window.partitionBy("len").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        events.groupBy("len", "range")
        .agg(F.sum("kept").alias("n"))
        .select("len", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    counted = events.withColumn("seen", F.sum("kept").over(inside)).filter("asks > 0")
    return counted.join(base, ["len", "range"]).agg(
        F.coalesce(F.sum(F.col("asks") * (F.col("seen") + F.col("base"))), F.lit(0)).alias("comparisons")
    )
