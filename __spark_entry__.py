
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from litsieve.functions import markup as M
from litsieve.functions.text import NOUN_SUFFIXES, STOP_WORDS, normalise_title, tag_class
from litsieve.operators import dedup as D
from litsieve.operators import extract as P
from litsieve.operators import fuzzy as Z
from litsieve.operators import keywords as K
from litsieve.operators import search as Q
from litsieve.operators import snowball as G
from litsieve.plans import screening, views as V
from litsieve.schema import in_column_order
from litsieve.session import durable
from litsieve.sources.io import seed_name

try:
    import corpus_pipeline
    import litsieve.llm.queries as llm
except ModuleNotFoundError as e:  # the subpackage and its pipeline may be left out
    if not (e.name or "").startswith(("corpus_pipeline", "litsieve.llm")):
        raise
    corpus_pipeline = llm = None

LEV = {"metric": "levenshtein", "threshold": 0.85}
JAC = {"metric": "jaccard", "threshold": 0.8}
RAT = {"metric": "ratcliff", "threshold": 0.85}
SMALL = {"probe_rows": 64, "block_rows": 32, "edges_per_row": 1, "hot_rows": 8, "hot_part": 16}
SEARCH = "the and"
CAP = 10
TOP = 30


def entry(spark: SparkSession) -> DataFrame:
    """Screening of documents and pages: exact, then near-duplicate dedup."""
    return queries()["screening"](spark, "/root/testdata/sf0.001")


def _titles(s: SparkSession, d: str) -> DataFrame:
    return V.document_titles(s, d)


def _texts(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "documents", heavy=True).select(F.col("doc_id").alias("ord"), "text")


def _doc_search(s: SparkSession, d: str) -> DataFrame:
    return V.document_articles(s, d, heavy=True).withColumn("citations", F.length("title"))


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return G.resolve_seeds(V.seed_titles(s, d), V.part_articles(s, d))


def _misspelt(s: SparkSession, d: str) -> DataFrame:
    """Seed titles as they are, and with an ending that no part has."""
    titles = V.seed_titles(s, d)
    return titles.unionByName(titles.select(F.concat("title", F.lit("ish")).alias("title")))


def _links(s: SparkSession, d: str) -> DataFrame:
    """Citation links, written once: every direction reads them."""
    return durable(V.part_citations(s, d), "links")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


def _pairs(s: SparkSession, d: str, options: dict) -> DataFrame:
    return _rounded(Z.similar_pairs(_titles(s, d), **options))


def _url_params(s: SparkSession, d: str) -> DataFrame:
    params = M.url_params(F.col("url"))
    pairs = F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return V.table(s, d, "pages", heavy=True).select(
        "page_id",
        F.array_join(F.array_sort(pairs), "&").alias("params"),
        M.start_of(F.col("url")).alias("start"),
    )


def _absolute(s: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("page_url", r"^[a-z]+://([^/?#]+)", 1)
    return (
        P.page_links(V.table(s, d, "pages", heavy=True))
        .filter(M.usable_href(F.col("href"), host))
        .select("page_id", "pos", M.absolute_url(F.col("href"), F.col("page_url")).alias("link"))
    )


def _link_by_text(s: SparkSession, d: str) -> DataFrame:
    found = M.links(M.without_scripts(F.col("html")))
    return V.table(s, d, "pages", heavy=True).select(
        "page_id", M.link_by_text(found, "^TH", "/[aeiou]").alias("href")
    )


def _bylines(s: SparkSession, d: str) -> DataFrame:
    b = F.col("byline")
    return V.bylines(s, d).select(
        "ord",
        P.first_author(b).alias("authors"),
        P.year_of(b).alias("year"),
        P.venue_last(b).alias("venue_last"),
        P.venue_second(b).alias("venue_second"),
    )


def _accumulated(s: SparkSession, d: str) -> DataFrame:
    """Pages of a site in order; records are its paragraphs, a page without any is an
    empty page."""
    pages = V.table(s, d, "pages", heavy=True).withColumn(
        "site", F.regexp_extract("url", r"\.([a-z]+)/", 1)
    )
    body = F.regexp_extract_all(M.without_scripts(F.col("html")), F.lit(r"(?i)<p\b[^>]*>"), F.lit(0))
    records = pages.select("site", "page_id", F.posexplode(body).alias("pos", "par"))
    return Q.accumulate_pages(
        pages.select("site", "page_id"), records, "site", "page_id", "pos", 200
    ).select("site", "page_id", "pos", "place")


def _walks(s: SparkSession, d: str) -> DataFrame:
    """Walks along each customer's result pages from the dearest order on."""
    hops = P.follow_next(V.customer_result_pages(s, d), "lib.example")
    return P.walk_pages(hops, V.customer_starts(s, d))


def _walk_records(s: SparkSession, d: str) -> DataFrame:
    records = P.extract_records(V.customer_result_pages(s, d))
    return P.walk_records(durable(_walks(s, d), "walks"), records, 5)


def _search_many(s: SparkSession, d: str) -> DataFrame:
    articles = V.order_articles(s, d)
    return Q.search_many(Q.term_index(articles), articles, V.segment_requests(s, d))


def _word_tags(s: SparkSession, d: str) -> DataFrame:
    """A tag for every distinct word of the documents, from a lexicon of part names."""
    words = K.vocabulary(_texts(s, d), "text").select("word")
    return K.tag_words(words, V.part_lexicon(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    extra = {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}
    return _library_queries() | extra


def oracle_sql() -> dict[str, str]:
    extra = dict(llm.SQL) if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    base = _library_sql()
    same = {
        "fuzzy_dedup_lev_parts": base["fuzzy_dedup_lev"].replace("0.15::DOUBLE", "0.05::DOUBLE"),
        "fuzzy_dedup_lev_steps": base["fuzzy_dedup_lev"],
    }
    return base | same | {"fuzzy_pairs_jaccard_parts": base["fuzzy_pairs_jaccard"]} | extra


def _library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # exact dedup
        "dedup_exact": lambda s, d: D.drop_duplicates(_titles(s, d)),
        "dedup_exact_text": lambda s, d: D.drop_duplicates(_texts(s, d), "text").select("ord"),
        "dedup_marks": lambda s, d: D.mark_duplicates(_titles(s, d)),
        "dedup_report": lambda s, d: D.duplicate_report(_titles(s, d)),
        "dedup_stats": lambda s, d: D.dedup_stats(_titles(s, d)),
        "dedup_stats_per_source": lambda s, d: D.dedup_stats(_titles(s, d), by="source_file"),
        "dedup_per_source": lambda s, d: D.drop_duplicates(_titles(s, d), ["source_file", "title"]),
        "union_by_name": lambda s, d: D.union_by_name(V.shelf_titles(s, d)),
        "union_dedup": lambda s, d: D.union_dedup(V.shelf_titles(s, d)),
        # near duplicates
        "title_norm": lambda s, d: _titles(s, d).select(
            "ord", normalise_title(F.col("title")).alias("norm")
        ),
        "title_lookup": lambda s, d: Z.first_row_per_title(_titles(s, d)),
        "band_profile": lambda s, d: Z.band_profile(_titles(s, d)),
        "fuzzy_pairs_lev": lambda s, d: _pairs(s, d, LEV),
        "fuzzy_dedup_lev": lambda s, d: Z.fuzzy_dedup(_titles(s, d), **LEV),
        "fuzzy_tags_lev": lambda s, d: _rounded(Z.fuzzy_tags(_titles(s, d), **LEV)),
        "fuzzy_stats_lev": lambda s, d: screening.fuzzy_report(_titles(s, d), **LEV),
        "fuzzy_histogram_lev": lambda s, d: screening.score_histogram(
            _rounded(Z.fuzzy_matches(_titles(s, d), **LEV))
        ),
        "fuzzy_scores_lev": lambda s, d: _rounded(Z.scored_pairs(_titles(s, d), **LEV)),
        "fuzzy_pairs_jaccard": lambda s, d: _pairs(s, d, JAC),
        # by the code that is meant for large inputs, fuzzy_dedup_lev_parts at 0.95 only
        "fuzzy_dedup_lev_parts": lambda s, d: Z.fuzzy_dedup(
            _titles(s, d), route="parts", metric="levenshtein", threshold=0.95
        ),
        "fuzzy_pairs_jaccard_parts": lambda s, d: _pairs(s, d, JAC | {"route": "parts"}),
        "fuzzy_dedup_lev_steps": lambda s, d: Z.fuzzy_dedup(_titles(s, d), **LEV, **SMALL),
        "fuzzy_pairs_ratcliff": lambda s, d: _pairs(s, d, RAT),
        # all pairs that reach the threshold, whatever their lengths
        "fuzzy_dedup_ratcliff": lambda s, d: Z.fuzzy_dedup(_titles(s, d), **RAT, band=None),
        "fuzzy_dedup_ratcliff_095": lambda s, d: Z.fuzzy_dedup(
            _titles(s, d), metric="ratcliff", threshold=0.95
        ),
        "screening": lambda s, d: screening.screen(V.shelf_titles(s, d), **RAT),
        "screening_lev": lambda s, d: screening.screen(V.shelf_titles(s, d), **LEV),
        # keywords
        "keyword_tokens": lambda s, d: K.token_rows(_titles(s, d)),
        "keyword_counts": lambda s, d: K.keyword_counts(_texts(s, d), "text", lemmas=False).select(
            "word", "freq"
        ),
        "keyword_top": lambda s, d: K.top_keywords(_texts(s, d), "text", n=TOP, lemmas=False),
        "keyword_lemma_top": lambda s, d: K.top_keywords(_texts(s, d), "text", n=TOP),
        "keyword_title_top": lambda s, d: K.top_keywords(_titles(s, d), "title", n=TOP),
        "keyword_lexicon_top": lambda s, d: K.top_keywords(
            V.part_articles(s, d), "title", n=TOP, lexicon=V.part_lexicon(s, d)
        ),
        "keyword_word_class": lambda s, d: V.part_lexicon(s, d).select(
            "token", "tag", tag_class(F.col("tag")).alias("word_class")
        ),
        "keyword_word_tags": _word_tags,
        # extraction
        "page_blocks": lambda s, d: P.record_blocks(V.order_result_pages(s, d)).select(
            "page_id", "pos", F.length("block").alias("n_chars")
        ),
        "page_records": lambda s, d: V.page_articles(s, d).select(
            "page_id", "pos", "title", "abstract", "citations"
        ),
        "result_records": lambda s, d: P.extract_records(V.order_result_pages(s, d)).drop("page_url"),
        "result_rejected": lambda s, d: P.extract_records(
            V.order_result_pages(s, d), keep_rejected=True
        ).filter("error is not null").select("page_id", "pos", "authors", "year", "error"),
        "result_nested": lambda s, d: P.extract_records(V.nested_result_pages(s, d)).drop("page_url"),
        "result_next_page": lambda s, d: P.follow_next(V.order_result_pages(s, d), "lib.example"),
        "page_walk": lambda s, d: P.walk_pages(
            P.follow_next(V.order_result_pages(s, d), "lib.example"), V.segment_starts(s, d)
        ),
        "page_walk_cycles": _walks,
        "page_walk_records": _walk_records,
        "page_links": lambda s, d: P.page_links(V.table(s, d, "pages", heavy=True)).drop("page_url"),
        "link_by_text": _link_by_text,
        "absolute_links": _absolute,
        "url_params": _url_params,
        "byline_fields": _bylines,
        # search
        "search_terms": lambda s, d: Q.search(_doc_search(s, d), SEARCH, max_results=50).select(
            "ord", "title", "hits"
        ),
        "search_filters": lambda s, d: Q.search(
            V.order_articles(s, d), "order building", author="customer#", year_start=1996,
            year_end=1998, max_results=200,
        ).select("ord", "title", "authors", "year", "citations"),
        "search_by_date": lambda s, d: Q.search(
            V.order_articles(s, d), "urgent", sort_by="date", max_results=100
        ).select("ord", "title", "year"),
        "search_page": lambda s, d: Q.search(
            V.order_articles(s, d), "order", sort_by="date", page=3
        ).select("ord", "title", "year"),
        "search_matches": lambda s, d: Q.match_articles(_doc_search(s, d), SEARCH).select("ord", "hits"),
        "search_many": _search_many,
        "accumulate_pages": _accumulated,
        "select_order": lambda s, d: in_column_order(V.order_articles(s, d)),
        "year_as_text": lambda s, d: V.order_articles(s, d).select(
            "ord", F.col("year").cast("string").alias("year")
        ),
        "result_name": lambda s, d: _titles(s, d).select("ord", seed_name(F.col("title")).alias("name")),
        # snowball
        "seed_resolve": _seeds,
        "seed_best_score": lambda s, d: _rounded(
            G.resolve_seeds_by_score(_misspelt(s, d), V.part_articles(s, d), metric="levenshtein")
        ),
        "cited_by": lambda s, d: G.cited_by(_seeds(s, d), _links(s, d)),
        "references": lambda s, d: G.references(_seeds(s, d), _links(s, d)),
        "related": lambda s, d: G.related(_seeds(s, d), _links(s, d)),
        "snowball_capped": lambda s, d: G.snowball(_links(s, d), _seeds(s, d), cap=CAP),
        "snowball_merged": lambda s, d: G.merged(
            G.snowball(_links(s, d), _seeds(s, d), cap=CAP)
        ),
    }


# SQL counterparts -----------------------------------------------------------

TITLES = "SELECT doc_id AS ord, source AS source_file, split_part(text, chr(10), 1) AS title FROM documents"
NO_SCRIPT = "regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)>', '', 'g')"


def _norm(c: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _decode(c: str) -> str:
    for entity, char in M.ENTITIES.items():
        c = f"replace({c}, '&{entity};', '{_quoted(char)}')"
    return c


def _text_of(c: str) -> str:
    bare = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    return _decode(f"regexp_replace({bare}, '^\\s+|\\s+$', '', 'g')")


PAGE_TITLES = f"""
    SELECT page_id, {_text_of("m")} AS title, nullif(regexp_extract(block, '(?is)<p(?:\\s[^>]*)?>(.*?)(?:</p>|<p\\b|</article>)', 0), '') AS abs_m, pos, url
    FROM (SELECT page_id, url, block, pos,
                 nullif(regexp_extract(block, '(?is)<h1(?:\\s[^>]*)?>.*?</h1>', 0), '') AS h,
                 regexp_extract(block, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1) AS m
          FROM (SELECT page_id, url, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS pos
                FROM (SELECT page_id, url, string_split_regex({NO_SCRIPT}, '(?i)<article\\b') AS b FROM pages))
          WHERE pos > 0)
    WHERE h IS NOT NULL"""

SHELF_SQL = f"""
    SELECT 0 AS file_rank, ord, source_file, title, NULL::VARCHAR AS url FROM ({TITLES})
    UNION ALL
    SELECT 1, page_id + {V.SHELF}, NULL, title, url FROM ({PAGE_TITLES})"""

SHELF_EXACT = f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY title ORDER BY file_rank, ord) AS rn FROM ({SHELF_SQL}))
    WHERE rn = 1"""

# The edit distance there counts bytes; one ASCII character per letter repairs it.
ONE_BYTE = "translate(norm, 'ßàáâäçèéêëíîïñóôöùúûü', 'ABCDEFGHIJKLMNOPQRSTU')"

LEV_EDGES = f"""
    SELECT lo, hi, 1 - d / longest AS similarity FROM (
        SELECT a.ord AS lo, b.ord AS hi, greatest(a.len, b.len)::DOUBLE AS longest,
               CASE WHEN abs(a.len - b.len) <= 20 THEN levenshtein(a.k, b.k) END AS d
        FROM x a JOIN x b ON a.ord < b.ord AND b.len BETWEEN a.len - 20 AND a.len + 20)
    WHERE d <= floor(0.15::DOUBLE * longest + 1e-9)"""

JAC_EDGES = """
    SELECT lo, hi, shared / (na + nb - shared)::DOUBLE AS similarity FROM (
        SELECT a.ord AS lo, b.ord AS hi, len(a.w) AS na, len(b.w) AS nb,
               len(list_intersect(a.w, b.w))::DOUBLE AS shared
        FROM x a JOIN x b ON a.ord < b.ord AND b.len BETWEEN a.len - 20 AND a.len + 20)
    WHERE shared / (na + nb - shared)::DOUBLE >= 0.8::DOUBLE"""


def _rat_edges(threshold: float, band: int | None = 20) -> str:
    """Pairs by matching blocks: the longest common block, the first in a, then in b, and so
    on left and right of it. In a b of 200 characters and more, characters that make up more
    than a hundredth of it begin no block, but lengthen one at both ends. The letters that
    two titles share bound their score from above; pairs below that need no blocks."""
    near = f"b.len BETWEEN a.len - {band} AND a.len + {band}" if band else f"2 * least(a.len, b.len) >= {threshold}::DOUBLE * (a.len + b.len) - 1e-9"
    at, end = "greatest(0, alo - r.i, blo - r.j)", "least(r.n, ahi - r.i, bhi - r.j)"
    counts = ", ".join(f"len(k) - len(replace(k, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz ")

    def alike(x: str, y: str, n: str) -> str:
        """Length of the common beginning of two strings of ``n`` characters; mostly short."""

        def differ(size: str) -> str:
            return f"list_position(list_transform(range(1, {size} + 1), lambda k: {x}[k] <> {y}[k]), true) - 1"

        return f"""CASE WHEN lb < 200 THEN 0 WHEN {x} = {y} THEN {n}
            WHEN left({x}, 32) <> left({y}, 32) THEN {differ(f"least(32, {n})")} ELSE {differ(n)} END"""

    def blocks(windows: str) -> str:
        return f"""
            SELECT lo, hi, alo, ahi, blo, bhi, i - back AS i, j - back AS j, n + back + fore AS n FROM (
                SELECT *, {alike("xa", "xb", "nx")} AS back, {alike("ya", "yb", "ny")} AS fore
                FROM (SELECT *, reverse(substr(ka, i - nx + 1, nx)) AS xa, reverse(substr(kb, j - nx + 1, nx)) AS xb,
                             substr(ka, i + n + 1, ny) AS ya, substr(kb, j + n + 1, ny) AS yb
                      FROM (SELECT *, least(i - alo, j - blo) AS nx, least(ahi - i, bhi - j) - n AS ny
                            FROM (SELECT *, coalesce(c.n, 0) AS n, coalesce(-c.i, alo) AS i, coalesce(-c.j, blo) AS j
                                  FROM (SELECT *, list_max(list_filter(list_transform(core, lambda r:
                                            {{'n': {end} - {at}, 'i': -(r.i + {at}), 'j': -(r.j + {at})}}), lambda c: c.n > 0)) AS c
                                        FROM ({windows}) JOIN packed USING (lo, hi))))))"""

    return f"""
    WITH RECURSIVE p AS MATERIALIZED (SELECT ord, k, len, [{counts}] AS n FROM x),
    cand AS MATERIALIZED (
        SELECT lo, hi, ka, kb, la, lb FROM (
            SELECT a.ord AS lo, b.ord AS hi, a.k AS ka, b.k AS kb, a.len AS la, b.len AS lb,
                   list_sum(list_transform(list_zip(a.n, b.n), lambda z: least(z[1], z[2])))
                   + least(a.len - list_sum(a.n), b.len - list_sum(b.n)) AS shared
            FROM p a JOIN p b ON a.ord < b.ord AND {near})
        WHERE 2 * shared >= {threshold}::DOUBLE * (la + lb) - 1e-9),
    chars AS MATERIALIZED (
        SELECT ord, ch, i, count(*) OVER (PARTITION BY ord, ch) AS often
        FROM (SELECT ord, unnest(string_split(k, '')) AS ch, generate_subscripts(string_split(k, ''), 1) - 1 AS i FROM x)),
    -- characters that may begin a block
    plain AS MATERIALIZED (SELECT lo, hi, i, ch FROM cand JOIN chars ON ord = hi WHERE lb < 200 OR often <= lb // 100 + 1),
    cells AS (SELECT lo, hi, a.i AS i, b.i AS j FROM plain b JOIN chars a ON a.ord = lo AND a.ch = b.ch),
    packed AS MATERIALIZED (
        SELECT lo, hi, ka, kb, lb, coalesce(runs, []) AS core FROM cand LEFT JOIN (
            SELECT lo, hi, list({{'i': i, 'j': j, 'n': n}}) AS runs FROM (
                SELECT lo, hi, min(i) AS i, min(j) AS j, count(*) AS n
                FROM (SELECT *, i - row_number() OVER (PARTITION BY lo, hi, i - j ORDER BY i) AS island FROM cells)
                GROUP BY lo, hi, i - j, island) GROUP BY lo, hi) USING (lo, hi)),
    found AS (
        {blocks("SELECT lo, hi, 0 AS alo, la AS ahi, 0 AS blo, lb AS bhi FROM cand")}
        UNION ALL
        {blocks('''SELECT lo, hi, v.alo, v.ahi, v.blo, v.bhi FROM (
                SELECT lo, hi, unnest([{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j}, {'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi}]) AS v
                FROM found WHERE n > 0) WHERE v.alo < v.ahi AND v.blo < v.bhi''')})
    SELECT lo, hi, similarity FROM (
        SELECT lo, hi, 2.0::DOUBLE * sum(n) / any_value(la + lb) AS similarity FROM found JOIN cand USING (lo, hi) GROUP BY lo, hi)
    WHERE similarity >= {threshold}::DOUBLE"""


def _fuzzy(rows: str, edges: str, final: str) -> str:
    """Greedy keep-first over ``rows``; ``final`` reads t (rows) and matches."""
    return f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT *, {_norm("title")} AS norm FROM ({rows})),
    reps AS MATERIALIZED (SELECT norm, min(ord) AS ord FROM t WHERE norm <> '' GROUP BY norm),
    x AS MATERIALIZED (SELECT ord, {ONE_BYTE} AS k, length(norm) AS len,
                              list_distinct(string_split(norm, ' ')) AS w FROM reps),
    edges AS MATERIALIZED ({edges}),
    nodes AS MATERIALIZED (
        SELECT ord, row_number() OVER (ORDER BY ord) AS rn
        FROM (SELECT lo AS ord FROM edges UNION SELECT hi FROM edges)),
    pre AS MATERIALIZED (
        SELECT n.rn, n.ord, coalesce(list(e.lo) FILTER (WHERE e.lo IS NOT NULL), []::BIGINT[]) AS los
        FROM nodes n LEFT JOIN edges e ON e.hi = n.ord GROUP BY n.rn, n.ord),
    walk AS (
        SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept
        UNION ALL
        SELECT w.rn + 1, CASE WHEN len(list_intersect(p.los, w.kept)) > 0 THEN w.kept
                              ELSE list_append(w.kept, p.ord) END
        FROM walk w JOIN pre p ON p.rn = w.rn + 1),
    kept AS MATERIALIZED (SELECT unnest(arg_max(kept, rn)) AS ord FROM walk),
    hits AS MATERIALIZED (
        SELECT hi, min(lo) AS lo, arg_min(similarity, lo) AS similarity
        FROM edges WHERE lo IN (SELECT ord FROM kept) GROUP BY hi),
    matches AS MATERIALIZED (
        SELECT t.ord AS member, coalesce(h.lo, r.ord) AS leader,
               round(coalesce(h.similarity, 1.0), 6) AS similarity
        FROM t JOIN reps r USING (norm) LEFT JOIN hits h ON h.hi = r.ord
        WHERE h.lo IS NOT NULL OR t.ord <> r.ord)
    {final}"""


PAIRS_SQL = """SELECT m.leader AS ord1, m.member AS ord2, a.title AS title1, b.title AS title2, m.similarity
    FROM matches m JOIN t a ON a.ord = m.leader JOIN t b ON b.ord = m.member"""


def _tokens(rows: str, column: str) -> str:
    t = f"regexp_replace(lower({column}), '[^a-z0-9''\\-]+', ' ', 'g')"
    for pattern, new in [
        ("--+", " "),
        ("\\b(can)(not)\\b|\\b(gim|lem)(me)\\b", "\\1\\3 \\2\\4"),
        ("\\b(gon|wan)(na)\\b|\\b(got)(ta)\\b", "\\1\\3 \\2\\4"),
        ("''t(is|was)\\b", " \\1"),
        ("n''t\\b|''(s|m|d|ll|re|ve)\\b", " "),
        ("(^|\\s)''+|''+(\\s|$)", " "),
    ]:
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    words = f"list_filter(string_split_regex({t}, ' +'), lambda w: w <> '')"
    return f"""SELECT ord, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word
        FROM (SELECT ord, {words} AS ws FROM ({rows}))"""


STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
TEXTS = "SELECT doc_id AS ord, text FROM documents"


def _top(rows: str, column: str, lemmas: bool, final: str = "") -> str:
    rules = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(NOUN_SUFFIXES))
    lemma = (
        f"""SELECT word, arg_min(lemma, length(lemma) * 100 + rule) AS lemma FROM (
            SELECT v.word, r.rule, left(v.word, length(v.word) - length(r.old)) || r.new AS lemma
            FROM vocab v JOIN (VALUES {rules}) r(rule, old, new) ON suffix(v.word, r.old))
            WHERE lemma IN (SELECT word FROM vocab) GROUP BY word"""
        if lemmas
        else "SELECT word, word AS lemma FROM vocab"
    )
    final = final or f"""SELECT row_number() OVER (ORDER BY freq DESC, seen) AS rank, word, freq
        FROM counts ORDER BY freq DESC, seen LIMIT {TOP}"""
    return f"""
    WITH vocab AS MATERIALIZED (
        SELECT word, count(*) AS freq, min(ord::HUGEINT * 10000000000 + pos) AS seen
        FROM ({_tokens(rows, column)}) WHERE length(word) > 2 GROUP BY word),
    lemma AS MATERIALIZED ({lemma}),
    found AS (SELECT coalesce(l.lemma, v.word) AS word, v.freq, v.seen
              FROM vocab v LEFT JOIN lemma l ON l.word = v.word WHERE v.word NOT IN ({STOPS})),
    counts AS (SELECT word, sum(freq)::BIGINT AS freq, min(seen) AS seen FROM found
               WHERE word NOT IN ({STOPS}) AND length(word) > 2 AND regexp_full_match(word, '[a-z]+')
               GROUP BY word)
    {final}"""


LEXICON = """
    SELECT token, min(tag) AS tag FROM (
        SELECT split_part(p_name, ' ', 1) AS token, 'JJ' AS tag FROM part
        UNION ALL SELECT split_part(p_name, ' ', -1), 'NN' FROM part
        UNION ALL SELECT lower(p_type), 'VB' FROM part) GROUP BY token"""

RESULT_PAGES = f"""
    SELECT o_orderkey AS page_id, '{V.SITE}/scholar?q=order&start=' || (o_orderkey * 10) AS url,
        '<html><body><div class="gs_r gs_or"><h3 class="gs_rt"><span>[B]</span> <a href="/order/' || o_orderkey
        || '?v=1&amp;seg=' || c_mktsegment || '">Order <b>' || o_orderpriority || '</b> for ' || c_mktsegment
        || '</a></h3><div class="gs_a">' || c_name || ', B Author - Journal of ' || c_mktsegment || ', '
        || year(o_orderdate) || ' - lib.example</div><div class="gs_rs">Status ' || o_orderstatus
        || ' &amp; more</div><div class="gs_fl"><a href="/save">Save</a> <a href="/scholar?cites=' || o_orderkey
        || '&amp;hl=en">Cited by ' || o_custkey
        || '</a></div></div><div class="gs_r"><div class="gs_a">No title - 1999</div></div>'
        || '<a href="javascript:void(0)">x</a> <a href="/scholar?q=order&amp;start=' || ((o_orderkey + 1) * 10)
        || '">Next</a></body></html>' AS html
    FROM orders JOIN customer ON o_custkey = c_custkey"""

RESULT_BLOCKS = f"""
    SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS pos
    FROM (SELECT page_id, string_split_regex(html, '<div class="gs_r(?: gs_or)?"') AS b FROM ({RESULT_PAGES}))"""

RESULT_FIELDS = f"""
    SELECT page_id, pos, h, split_part(by_, ' - ', 1) AS who, by_, block,
           CASE WHEN contains(by_, ' - ') THEN split_part(by_, ' - ', -1) END AS journal
    FROM (SELECT page_id, pos, block, regexp_extract(block, '<h3 class="gs_rt">(.*?)</h3>', 1) AS h,
                 regexp_extract(block, '<div class="gs_a">(.*?)</div>', 1) AS by_
          FROM ({RESULT_BLOCKS}) WHERE pos > 0)"""

YEAR_SQL = "nullif(regexp_extract({c}, '\\b(?:19|20)\\d{{2}}\\b', 0), '')::INTEGER"

LINKS = f"""
    SELECT page_id, url, pos, {_decode("regexp_extract(a, '" + _quoted(M.HREF) + "', 1)")} AS href, {_text_of("a")} AS text
    FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos
          FROM (SELECT page_id, url, regexp_extract_all({NO_SCRIPT}, '{_quoted(M.ANCHOR)}') AS l FROM pages))"""

ORDER_ARTICLES = """
    SELECT o_orderkey AS ord, 'order ' || c_mktsegment || ' ' || o_orderpriority AS title, c_name AS authors,
           year(o_orderdate)::INTEGER AS year, c_mktsegment AS journal, coalesce(n, 0) AS citations,
           'status ' || o_orderstatus AS abstract
    FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""

DOC_ARTICLES = f"""
    SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title,
           string_split(' ' || {_norm("text")} || ' ', ' ') AS words FROM documents"""


def _hits(words: str, terms: str) -> str:
    return " + ".join(f"len(list_filter({words}, lambda w: w = '{t}'))" for t in terms.split())


DOC_HITS = f"""SELECT ord, title, {_hits("words", SEARCH)} AS hits FROM ({DOC_ARTICLES})
    WHERE {" AND ".join(f"list_contains(words, '{t}')" for t in SEARCH.split())}"""


def _order_words(terms: str) -> str:
    words = f"string_split({_norm(chr(39).join(['title || ', ' ', ' || abstract']))}, ' ')"
    return " AND ".join(f"list_contains({words}, '{t}')" for t in terms.split())


EDGES_SQL = """
    SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1"""

SEEDS_SQL = f"""
    SELECT s.title AS seed_title, min(p.p_partkey) AS seed
    FROM (SELECT DISTINCT title FROM (
            SELECT p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn
            FROM part) WHERE rn = 1) s
    JOIN part p ON {_norm("p.p_name")} = {_norm("s.title")} GROUP BY s.title"""

GRAPH = f"""
    WITH e AS MATERIALIZED ({EDGES_SQL}), s AS MATERIALIZED ({SEEDS_SQL}),
    cited_by AS (SELECT DISTINCT s.seed, e.src AS found, 1::BIGINT AS score FROM s JOIN e ON e.dst = s.seed WHERE e.src <> s.seed),
    refs AS (SELECT DISTINCT s.seed, e.dst AS found, 1::BIGINT AS score FROM s JOIN e ON e.src = s.seed WHERE e.dst <> s.seed),
    rel AS (SELECT s.seed, o.src AS found, count(*) AS score
            FROM (SELECT DISTINCT seed FROM s) s JOIN e m ON m.src = s.seed JOIN e o ON o.dst = m.dst
            WHERE o.src <> s.seed GROUP BY 1, 2),
    every AS (SELECT *, 'cited_by' AS direction FROM cited_by UNION ALL SELECT *, 'references' FROM refs
              UNION ALL SELECT *, 'related' FROM rel),
    capped AS (SELECT * FROM (SELECT seed, direction, found, score,
                 row_number() OVER (PARTITION BY seed, direction ORDER BY score DESC, found) AS rank FROM every)
               WHERE rank <= {CAP})
"""

# A walk carries the pages that it has been to.
CUSTOMER_WALKS = """
    WITH RECURSIVE o AS (
        SELECT o_orderkey AS page, o_orderstatus, c_mktsegment, o_custkey,
               lead(o_orderkey) OVER w AS following, first_value(o_orderkey) OVER w AS first
        FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    hops AS (SELECT page, CASE WHEN following IS NULL AND c_mktsegment = 'BUILDING' THEN first ELSE following END AS next FROM o),
    walk AS (
        SELECT arg_max(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS start, 0::BIGINT AS place, start AS page, [start] AS seen
        FROM orders GROUP BY o_custkey
        UNION ALL
        SELECT w.start, w.place + 1, h.next, list_append(w.seen, h.next)
        FROM walk w JOIN hops h ON h.page = w.page WHERE h.next IS NOT NULL AND NOT list_contains(w.seen, h.next))"""

MARKS = f"""SELECT *, ord <> kept_ord AS is_duplicate FROM (
    SELECT *, min(ord) OVER (PARTITION BY title) AS kept_ord FROM ({TITLES}))"""


def _library_sql() -> dict[str, str]:
    return {
        "dedup_exact": f"SELECT * FROM ({TITLES}) QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1",
        "dedup_exact_text": "SELECT min(doc_id) AS ord FROM documents GROUP BY text",
        "dedup_marks": MARKS,
        "dedup_report": f"SELECT ord, title, kept_ord FROM ({MARKS}) WHERE is_duplicate",
        "dedup_stats": f"SELECT count(*) AS total, count(*) - count(DISTINCT title) AS removed, count(DISTINCT title) AS kept FROM ({TITLES})",
        "dedup_stats_per_source": f"""SELECT source_file, count(*) AS total, count(*) - count(DISTINCT title) AS removed,
            count(DISTINCT title) AS kept FROM ({TITLES}) GROUP BY source_file""",
        "dedup_per_source": f"SELECT * FROM ({TITLES}) QUALIFY row_number() OVER (PARTITION BY source_file, title ORDER BY ord) = 1",
        "union_by_name": SHELF_SQL,
        "union_dedup": SHELF_EXACT,
        "title_norm": f"SELECT ord, {_norm('title')} AS norm FROM ({TITLES})",
        "title_lookup": f"SELECT title, min(ord) AS ord FROM ({TITLES}) GROUP BY title",
        "band_profile": f"""WITH c AS (SELECT length({_norm('title')}) AS len, count(*) AS titles FROM ({TITLES}) GROUP BY 1)
            SELECT a.len, a.titles, sum(b.titles)::BIGINT AS band_titles FROM c a JOIN c b ON abs(a.len - b.len) <= 20 GROUP BY 1, 2""",
        "fuzzy_pairs_lev": _fuzzy(TITLES, LEV_EDGES, PAIRS_SQL),
        "fuzzy_dedup_lev": _fuzzy(
            TITLES, LEV_EDGES, "SELECT ord, source_file, title FROM t WHERE ord NOT IN (SELECT member FROM matches)"
        ),
        "fuzzy_tags_lev": _fuzzy(
            TITLES,
            LEV_EDGES,
            """SELECT ord, source_file, title, leader IS NOT NULL AS is_duplicate, leader AS leader_id, similarity
            FROM t LEFT JOIN matches ON member = ord""",
        ),
        "fuzzy_stats_lev": _fuzzy(
            TITLES,
            LEV_EDGES,
            """SELECT n AS total, (
                SELECT count(*) FROM t i JOIN t j ON i.ord < j.ord AND length(j.norm) BETWEEN length(i.norm) - 20 AND length(i.norm) + 20
                LEFT JOIN matches m ON m.member = j.ord
                WHERE i.ord NOT IN (SELECT member FROM matches) AND (m.leader IS NULL OR i.ord <= m.leader)) AS comparisons,
            removed, n - removed AS kept, leaders, leaders + removed AS skipped
            FROM (SELECT count(*) AS n FROM t), (SELECT count(*) AS removed, count(DISTINCT leader) AS leaders FROM matches)""",
        ),
        "fuzzy_histogram_lev": _fuzzy(
            TITLES, LEV_EDGES, "SELECT floor(similarity * 20)::BIGINT AS step, count(*) AS pairs FROM matches GROUP BY 1"
        ),
        "fuzzy_scores_lev": _fuzzy(
            TITLES, LEV_EDGES, "SELECT lo, hi, round(similarity, 6) AS similarity FROM edges"
        ),
        "fuzzy_pairs_jaccard": _fuzzy(TITLES, JAC_EDGES, PAIRS_SQL),
        "fuzzy_pairs_ratcliff": _fuzzy(TITLES, _rat_edges(0.85), PAIRS_SQL),
        "fuzzy_dedup_ratcliff": _fuzzy(
            TITLES, _rat_edges(0.85, None), "SELECT ord, source_file, title FROM t WHERE ord NOT IN (SELECT member FROM matches)"
        ),
        "fuzzy_dedup_ratcliff_095": _fuzzy(
            TITLES, _rat_edges(0.95), "SELECT ord, source_file, title FROM t WHERE ord NOT IN (SELECT member FROM matches)"
        ),
        "screening": _fuzzy(
            SHELF_EXACT,
            _rat_edges(0.85),
            "SELECT file_rank, ord, source_file, title, url FROM t WHERE ord NOT IN (SELECT member FROM matches)",
        ),
        "screening_lev": _fuzzy(
            SHELF_EXACT,
            LEV_EDGES,
            "SELECT file_rank, ord, source_file, title, url FROM t WHERE ord NOT IN (SELECT member FROM matches)",
        ),
        "keyword_tokens": _tokens(TITLES, "title"),
        "keyword_counts": _top(TEXTS, "text", False, "SELECT word, freq FROM counts"),
        "keyword_top": _top(TEXTS, "text", False),
        "keyword_lemma_top": _top(TEXTS, "text", True),
        "keyword_title_top": _top(TITLES, "title", True),
        "keyword_lexicon_top": f"""
            SELECT row_number() OVER (ORDER BY freq DESC, seen) AS rank, word, freq FROM (
                SELECT word, count(*) AS freq, min(ord * 100 + pos) AS seen
                FROM ({_tokens("SELECT p_partkey AS ord, p_name FROM part", "p_name")})
                JOIN ({LEXICON}) ON token = word AND tag IN ('NN', 'JJ')
                WHERE length(word) > 2 AND word NOT IN ({STOPS}) GROUP BY word)
            ORDER BY freq DESC, seen LIMIT {TOP}""",
        "keyword_word_tags": f"""
            WITH words AS MATERIALIZED (SELECT DISTINCT word FROM ({_tokens(TEXTS, "text")}) WHERE length(word) > 2),
            lex AS MATERIALIZED (SELECT DISTINCT token, tag FROM ({LEXICON}) WHERE token <> ''),
            counted AS (SELECT right(token, n) AS suffix, tag, count(*) AS n
                        FROM lex, (SELECT unnest(range(1, 6)) AS n) WHERE n <= length(token) GROUP BY 1, 2),
            best AS (SELECT suffix, tag FROM counted QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, tag) = 1),
            learned AS (
                SELECT word, arg_max(tag, length(suffix)) AS tag, arg_max(suffix, length(suffix)) AS suffix
                FROM words, (SELECT unnest(range(1, 6)) AS n) JOIN best ON suffix = right(word, n) AND n <= length(word) GROUP BY word)
            SELECT word, coalesce(k.tag, l.tag, 'none') AS tag, CASE WHEN k.tag IS NOT NULL THEN 'lexicon' ELSE l.suffix END AS "by"
            FROM words LEFT JOIN (SELECT token AS word, min(tag) AS tag FROM lex GROUP BY 1) k USING (word) LEFT JOIN learned l USING (word)""",
        "keyword_word_class": f"""SELECT token, tag, CASE left(tag, 1) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r'
            ELSE 'n' END AS word_class FROM ({LEXICON})""",
        "page_blocks": f"""SELECT page_id, pos, length(block) + CASE WHEN starts_with(block, '>') AND pos = 1 THEN 7 ELSE 1 END AS n_chars
            FROM ({RESULT_BLOCKS}) WHERE pos > 0""",
        "page_records": f"""SELECT page_id, pos, title, {_text_of("regexp_extract(abs_m, '(?is)<p(?:[ ][^>]*)?>(.*?)(?:</p>|<p|</article>)', 1)")} AS abstract,
            0 AS citations FROM ({PAGE_TITLES})""",
        "result_records": f"""
            SELECT page_id, pos, {_text_of("h")} AS title, nullif(trim(split_part(who, ',', 1)), '') AS authors,
                   {YEAR_SQL.format(c="by_")} AS year, journal,
                   coalesce(try_cast(nullif(regexp_extract(block, 'cites=[^>]*>[^<0-9]*(\\d+)', 1), '') AS INTEGER), 0) AS citations,
                   {_text_of("regexp_extract(block, '<div class=" + chr(34) + "gs_rs" + chr(34) + ">(.*?)</div>', 1)")} AS abstract,
                   {_decode("regexp_extract(h, 'href=" + chr(34) + "([^" + chr(34) + "]*)', 1)")} AS url
            FROM ({RESULT_FIELDS}) WHERE h <> ''""",
        "result_rejected": f"""SELECT page_id, pos, trim(who) AS authors, {YEAR_SQL.format(c="by_")} AS year, 'no title' AS error
            FROM ({RESULT_FIELDS}) WHERE h = ''""",
        # straight from the columns: no markup is read
        "result_nested": """
            WITH o AS (SELECT *, year(o_orderdate)::INTEGER AS y FROM orders JOIN customer ON o_custkey = c_custkey)
            SELECT o_orderkey AS page_id, 1 AS pos, 'Order ' || o_orderpriority AS title, c_name AS authors, y AS year,
                   'lib.example' AS journal, o_custkey::INTEGER AS citations,
                   'Status ' || o_orderstatus || ' & more, end' AS abstract, '/order/' || o_orderkey AS url FROM o
            UNION ALL
            SELECT o_orderkey, 2, 'Open', c_name, 1999, '1999 gone', 0, 'gone', NULL FROM o""",
        "result_next_page": f"""
            WITH p AS (SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)
            SELECT a.k AS page_id, '{V.SITE}/scholar?q=order&start=' || ((a.k + 1) * 10) AS next_url, b.k AS next_page_id
            FROM p a LEFT JOIN p b ON b.k = a.k + 1""",
        "page_walk": """
            WITH RECURSIVE o AS (SELECT o_orderkey AS page, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
            walk AS (SELECT min(page) AS start, 0::BIGINT AS place, min(page) AS page FROM o GROUP BY c_mktsegment
                     UNION ALL SELECT w.start, w.place + 1, o.page FROM walk w JOIN o ON o.page = w.page + 1)
            SELECT * FROM walk""",
        "page_walk_cycles": CUSTOMER_WALKS + " SELECT start, place, page FROM walk",
        "page_walk_records": CUSTOMER_WALKS + """
            , stops AS (SELECT start, min(place) AS stop FROM walk JOIN o USING (page) WHERE o_orderstatus = 'P' GROUP BY start)
            SELECT start, page, 1 AS pos, (w.place + 1)::INTEGER AS place FROM walk w LEFT JOIN stops USING (start)
            WHERE w.place < coalesce(stop, 5) AND w.place < 5""",
        "page_links": f"SELECT page_id, pos, href, text FROM ({LINKS})",
        "link_by_text": f"""
            SELECT page_id, coalesce(arg_min(href, pos) FILTER (WHERE regexp_matches(text, '(?i)^TH')),
                                     arg_min(href, pos) FILTER (WHERE regexp_matches(href, '/[aeiou]'))) AS href
            FROM (SELECT page_id FROM pages) LEFT JOIN ({LINKS}) USING (page_id) GROUP BY page_id""",
        "absolute_links": f"""
            SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || href ELSE href END AS link
            FROM ({LINKS}) WHERE NOT starts_with(lower(href), 'javascript:')
              AND (starts_with(href, '/') OR contains(href, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)))""",
        "url_params": """
            SELECT page_id, CASE WHEN ok THEN array_to_string(list_sort(string_split(q, '&')), '&') ELSE '' END AS params,
                   CASE WHEN ok THEN coalesce(try_cast(nullif(regexp_extract(q, '(?:^|&)start=(\\d+)', 1), '') AS INTEGER), 0) ELSE 0 END AS start
            FROM (SELECT page_id, split_part(url, '?', 2) AS q,
                         regexp_full_match(split_part(url, '?', 2), '[^=&]*=[^=&]*(&[^=&]*=[^=&]*)*') AS ok FROM pages)""",
        "byline_fields": f"""
            SELECT ord, nullif(trim(split_part(split_part(b, ' - ', 1), ',', 1)), '') AS authors, {YEAR_SQL.format(c="b")} AS year,
                   CASE WHEN contains(b, ' - ') THEN split_part(b, ' - ', -1) END AS venue_last,
                   CASE WHEN contains(b, ' - ') THEN trim(split_part(split_part(b, ' - ', 2), ',', 1)) END AS venue_second
            FROM (SELECT o_orderkey AS ord, CASE left(o_orderpriority, 1)
                    WHEN '1' THEN c_name || ', W Chen - J ' || c_mktsegment || ', ' || year(o_orderdate) || ' - Wiley'
                    WHEN '2' THEN c_name || '- ' || year(o_orderdate) || ' - a.example'
                    WHEN '3' THEN c_name WHEN '4' THEN ' - J ' || c_mktsegment
                    ELSE c_name || ' - J ' || c_mktsegment || ', no year' END AS b
                  FROM orders JOIN customer ON o_custkey = c_custkey)""",
        "search_terms": f"SELECT ord, title, hits FROM ({DOC_HITS}) ORDER BY hits DESC, length(title) DESC, ord LIMIT 50",
        "search_filters": f"""SELECT ord, title, authors, year, citations FROM ({ORDER_ARTICLES})
            WHERE {_order_words("order building")} AND contains(lower(authors), 'customer#') AND year BETWEEN 1996 AND 1998
            ORDER BY citations DESC, ord LIMIT 200""",
        "search_by_date": f"""SELECT ord, title, year FROM ({ORDER_ARTICLES}) WHERE {_order_words("urgent")}
            ORDER BY year DESC NULLS LAST, ord LIMIT 100""",
        "search_page": f"""SELECT ord, title, year FROM ({ORDER_ARTICLES}) WHERE {_order_words("order")}
            ORDER BY year DESC NULLS LAST, ord LIMIT 10 OFFSET 30""",
        "search_matches": f"SELECT ord, hits FROM ({DOC_HITS})",
        "search_many": f"""
            WITH a AS MATERIALIZED (
                SELECT *, string_split({_norm(chr(39).join(['title || ', ' ', ' || abstract']))}, ' ') AS words FROM ({ORDER_ARTICLES})),
            r AS (
                SELECT ascii(c_mktsegment) * 10 + k AS request, k, k * 25 AS most,
                       list_distinct(string_split({_norm("'order ' || c_mktsegment || CASE WHEN k < 4 THEN ' ' || o_orderpriority ELSE '' END")}, ' ')) AS terms
                FROM (SELECT DISTINCT c_mktsegment, o_orderpriority, left(o_orderpriority, 1)::INTEGER AS k
                      FROM orders JOIN customer ON o_custkey = c_custkey)),
            hit AS (
                SELECT request, most, ord, list_sum(list_transform(terms, lambda t: len(list_filter(words, lambda w: w = t))))::BIGINT AS hits,
                       CASE WHEN k % 2 = 0 THEN year END AS y, CASE WHEN k % 2 = 1 THEN citations END AS n, k
                FROM r JOIN a ON list_has_all(words, terms)
                WHERE (k <> 2 OR contains(lower(authors), 'customer#00000000')) AND (k <= 2 OR year >= 1995) AND (k <> 5 OR year <= 1997)),
            ranked AS (
                SELECT *, row_number() OVER (PARTITION BY request ORDER BY y DESC NULLS LAST,
                          CASE WHEN k % 2 = 1 THEN hits END DESC NULLS LAST, n DESC NULLS LAST, ord)::INTEGER AS place FROM hit)
            SELECT request::BIGINT AS request, place, ord, hits FROM ranked WHERE place <= most""",
        "accumulate_pages": f"""
            WITH p AS (SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS site, page_id,
                              regexp_extract_all({NO_SCRIPT}, '(?i)<p\\b[^>]*>') AS r FROM pages),
            stop_at AS (SELECT site, min(page_id) AS stop_id FROM p WHERE len(r) = 0 GROUP BY site)
            SELECT * FROM (
                SELECT site, page_id, pos, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) AS place
                FROM (SELECT site, page_id, unnest(range(len(r))) AS pos FROM p) LEFT JOIN stop_at USING (site)
                WHERE stop_id IS NULL OR page_id < stop_id) WHERE place <= 200""",
        "select_order": f"SELECT title, authors, year, journal, citations, abstract FROM ({ORDER_ARTICLES})",
        "year_as_text": f"SELECT ord, year::VARCHAR AS year FROM ({ORDER_ARTICLES})",
        "result_name": f"SELECT ord, replace(substring(title, 1, 20), ' ', '_') AS name FROM ({TITLES})",
        "seed_resolve": SEEDS_SQL,
        "seed_best_score": f"""
            WITH eq AS ({SEEDS_SQL}), a AS (SELECT {_norm("p_name")} AS k, min(p_partkey) AS ord FROM part GROUP BY 1),
            s AS (SELECT seed_title || 'ish' AS seed_title, {_norm("seed_title || 'ish'")} AS k FROM eq),
            d AS (SELECT seed_title, ord, greatest(length(a.k), length(s.k))::DOUBLE AS longest, levenshtein(a.k, s.k) AS d
                  FROM s JOIN a ON length(a.k) BETWEEN length(s.k) - 20 AND length(s.k) + 20)
            SELECT seed_title, seed, 1.0::DOUBLE AS similarity FROM eq UNION ALL
            SELECT seed_title, ord, round(1 - d / longest, 6) FROM d WHERE d <= floor(0.15::DOUBLE * longest + 1e-9)
            QUALIFY row_number() OVER (PARTITION BY seed_title ORDER BY d / longest, ord) = 1""",
        "cited_by": GRAPH + "SELECT * FROM cited_by",
        "references": GRAPH + "SELECT * FROM refs",
        "related": GRAPH + "SELECT * FROM rel",
        "snowball_capped": GRAPH + "SELECT * FROM capped",
        "snowball_merged": GRAPH
        + "SELECT seed, found, string_agg(DISTINCT direction, ',' ORDER BY direction) AS directions FROM capped GROUP BY 1, 2",
    }
