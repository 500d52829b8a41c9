import itertools
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from litsieve.functions import markup as M
from litsieve.operators import extract as P

PAGE = """<div class="gs_r gs_or"><h3 class="gs_rt"><span>[BOOK]</span><a id=x href="/r?a=1&amp;b=2">Facilitating <b>design</b>-by-analogy</a></h3>
<div class="gs_a">D Lee, W Chen - J Mech, 2024 - Wiley</div><div class="gs_rs">Some &lt;text&gt; &eacute;</div>
<div class="gs_fl"><a href="/scholar?cites=12&amp;x">Cited by 85</a> <a href="/scholar?cites=13">Cited by 2</a></div></div>
<div class="gs_r"><div class="gs_a">no title</div></div>
<div class='gs_r'><h3 class='gs_rt'>Plain <b>broken</h3><div class='gs_fl gs_flb'><a href="/x">Cited by 9</a></div></div>"""


def records(spark, **rules):
    pages = spark.createDataFrame([(1, "https://s.example/p?start=20&q=a", PAGE)], "page_id long, url string, html string")
    return P.extract_records(pages, P.Rules(**rules)).orderBy("pos").collect()


def test_record_fields(spark):
    first, last = records(spark)
    assert (first.title, first.url) == ("[BOOK]Facilitating design-by-analogy", "/r?a=1&b=2")
    assert (first.authors, first.year, first.journal, first.citations) == ("D Lee", 2024, "Wiley", 85)
    assert first.abstract == "Some <text> &eacute;"
    assert (last.title, last.url, last.authors, last.year, last.citations) == ("Plain broken", None, None, None, 0)


def test_options(spark):
    first = records(spark, glue=True, every_entity=True, venue="second")[0]
    assert first.title == "[BOOK]Facilitatingdesign-by-analogy"
    assert first.journal == "J Mech" and first.abstract == "Some <text> é"


def test_rejected_blocks(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "<p>")], "page_id long, url string, html string")
    bad = P.extract_records(pages, keep_rejected=True).filter("error is not null").collect()
    assert [(r.page_id, r.pos) for r in bad] == [(1, 2)]


def test_bylines(spark):
    cases = ["D Lee, W Chen - J Mech, 2024 - Wiley", "JS Linsey- 2007 - search.example", "solo", "", None]
    b = F.col("b")
    df = spark.createDataFrame([(c,) for c in cases], "b string").select(
        P.first_author(b), P.year_of(b), P.venue_last(b), P.venue_second(b)
    )
    assert [tuple(r) for r in df.collect()] == [
        ("D Lee", 2024, "Wiley", "J Mech"),
        ("JS Linsey- 2007", 2007, "search.example", "search.example"),
        ("solo", None, None, None),
        (None, None, None, None),
        (None, None, None, None),
    ]
    clean = spark.createDataFrame([(cases[1],)], "b string").select(P.first_author(b, r"\s*[  ]?-\s+"))
    assert clean.first()[0] == "JS Linsey"


def test_urls(spark):
    urls = ["https://s.example/p?q=a&start=10", "https://s.example/p", "x?a", "x?start=z&a=b", None, "x?a=1&a=2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(M.url_params(F.col("u")).alias("m"), M.start_of(F.col("u")).alias("s")).collect()
    assert [r.m for r in got] == [{"q": "a", "start": "10"}, {}, {}, {"start": "z", "a": "b"}, {}, {"a": "2"}]
    assert [r.s for r in got] == [10, 0, 0, 0, 0, 0]
    hrefs = ["/scholar?start=10", "https://s.example/x", "javascript:void(0)", "no query", "JavaScript:/"]
    h = F.col("h")
    df = spark.createDataFrame([(x,) for x in hrefs], "h string")
    got = df.select(M.usable_href(h, "s.example"), M.absolute_url(h, F.lit("https://s.example/a?b"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]
    assert got[0][1] == "https://s.example/scholar?start=10" and got[1][1] == hrefs[1]


def test_links_and_next_page(spark):
    html = '<a href="/a">Cited BY 3</a><a href="/scholar?cites=5">x</a> <a class="n" href="/p?start=10">2</a>'
    rows = [(1, "https://s.example/p", html), (2, "https://s.example/p?start=10", "<a href='/q'>3</a>"), (3, "z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = M.links(F.col("html"))
    got = df.select(M.link_by_text(found, "(?:cited by)"), M.link_by_text(found, "nothing", r"/scholar\?cites=\d+")).collect()
    assert [tuple(r) for r in got] == [("/a", "/scholar?cites=5"), (None, None), (None, None)]
    hops = {r.page_id: (r.next_url, r.next_page_id) for r in P.follow_next(df, "s.example").collect()}
    assert hops == {1: ("https://s.example/p?start=10", 2), 2: ("https://s.example/q", None), 3: (None, None)}


def test_script_strings_are_no_markup(spark):
    html = '<script>var t="<article><h1>no</h1>"</script><article><h1>Yes</h1><p>one<p>two</article>'
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = P.extract_records(df, P.ARTICLE_PAGE).collect()
    assert [(r.title, r.abstract) for r in got] == [("Yes", "one")]


class Tree(HTMLParser):
    """Contents of the elements of one tag and class, by a stack of open tags."""

    def __init__(self, text: str, tag: str, css: str):
        super().__init__(convert_charrefs=False)
        self.text, self.tag, self.css, self.open, self.found = text, tag, css, [], []
        self.lines = [0, *itertools.accumulate(len(x) + 1 for x in text.split("\n"))]
        self.feed(text)
        self.close()
        for _, at in reversed(self.open):
            if at is not None:
                self.found.append((at, text[at:]))

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        hit = tag == self.tag and self.css in (dict(attrs).get("class") or "").split()
        self.open.append((tag, self.here() + len(self.get_starttag_text()) if hit else None))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while True:
                name, at = self.open.pop()
                if at is not None:
                    self.found.append((at, self.text[at : self.here()]))
                if name == tag:
                    return


def test_nested_elements_against_a_tree(spark):
    rng = random.Random(4)

    def tree(depth: int) -> str:
        parts = []
        for _ in range(rng.randrange(4)):
            kind = rng.choice(["text", "div", "DIV", "b", "x", "open", "self"]) if depth else "text"
            if kind == "x":
                parts.append(f"<div class='gs_a y'>{tree(depth - 1)}</div>")
            elif kind in ("div", "DIV"):
                parts.append(f"<{kind} id=1>{tree(depth - 1)}</{kind}>")
            else:
                word = f"t {rng.randrange(99)} "
                parts.append({"text": word, "b": f"<b>{word}</b>", "open": "<i>o", "self": "<div />"}[kind])
        return "".join(parts)

    cases = [f"lead <div>{tree(2)}</div><div class='q gs_a'>{tree(4)}</div>tail</div> more{tree(1)}" for _ in range(300)]
    cases += ["<div class=\"gs_a\">never <div>closed</div>", "<div class='gs_a'></div>x", "none", "<div class='gs_a'>"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = df.select("i", M.element_content(F.col("t"), M.Element("div", "gs_a")).alias("c")).collect()
    for r in got:
        wanted = sorted(Tree(cases[r.i], "div", "gs_a").found)
        assert r.c == (wanted[0][1] if wanted else None), cases[r.i]


def test_nested_fields(spark):
    page = """<div class="gs_r"><h3 class="gs_rt">T</h3><div class="gs_a"><div>D Lee</div>, W - J, <div><div>2020</div></div> - Wiley</div>
<div class="gs_rs">one <div>two <!-- </div></div> --></div> three</div><div class="gs_fl"><div>x</div><a href="/scholar?cites=1">Cited by 4</a></div></div>"""
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    (r,) = P.extract_records(df).collect()
    assert (r.authors, r.year, r.journal, r.abstract, r.citations) == ("D Lee", 2020, "Wiley", "one two  three", 4)


def plain_walk(hops: dict[int, int], start: int) -> list[int]:
    seen = [start]
    while (page := hops.get(seen[-1])) is not None and page not in seen:
        seen.append(page)
    return seen


def test_walks_against_following(spark):
    rng = random.Random(2)
    hops = {i: rng.randrange(60) for i in range(60) if i % 7}  # merging, with cycles and ends
    hops |= {i: i + 1 for i in range(100, 1300)} | {2000: 2000, 2001: 2002, 2002: 2001, 3000: 9999}
    starts = [*range(60), 100, 101, 700, 1300, 2000, 2001, 3000, 77777, 5, None]
    pages = spark.createDataFrame([*hops.items(), (4000, None), (None, 3)], "page_id long, next_page_id long").repartition(5)
    got = {}
    for r in P.walk_pages(pages, spark.createDataFrame([(x,) for x in starts], "start long")).collect():
        got.setdefault(r.start, []).append((r.place, r.page))
    wanted = {x: list(enumerate(plain_walk(hops, x))) for x in starts if x is not None}
    assert {k: sorted(v) for k, v in got.items()} == wanted
    none = spark.createDataFrame([], "page_id long, next_page_id long")
    assert P.walk_pages(none, none.select(F.col("page_id").alias("start"))).collect() == []


def test_records_along_a_walk(spark):
    walks = spark.createDataFrame([(9, 0, 9), (9, 1, 3), (9, 2, 5), (9, 3, 1), (7, 0, 7)], "start long, place long, page long")
    records = spark.createDataFrame([(9, 1), (9, 2), (3, 1), (3, 4), (1, 1)], "page_id long, pos int")
    got = sorted(map(tuple, P.walk_records(walks, records, 3).collect()))
    assert got == [(9, 3, 1, 3), (9, 9, 1, 1), (9, 9, 2, 2)]
    assert len(P.walk_records(walks, records, 9).collect()) == 4  # page 5 is empty, page 1 lies behind it
