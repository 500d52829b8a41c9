"""Markup expressions: elements, text, links and URLs. All JVM-side."""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Named entities decoded without leaving the JVM; "amp" is last.
ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "middot": "·",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "hellip": "…",
    "amp": "&",
}


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(c: Column, every: bool = False) -> Column:
    """Decode the entities above, or every entity there is (a Pandas UDF)."""
    if every:
        return _unescape(c)
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{entity};"), F.lit(char))
    return c


def without_scripts(page: Column) -> Column:
    """Drop script and style blocks: their strings may hold tags."""
    return F.regexp_replace(page, r"(?is)<(?:script|style)\b.*?</(?:script|style)>", "")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when nothing matches."""
    found = F.regexp_substr(c, F.lit(pattern))
    return found if group == 0 else F.regexp_extract(found, pattern, group)


def element(tag: str, css_class: str | None = None) -> str:
    """Pattern of an element's content, up to its tag's first end tag (see ``Element``)."""
    if css_class is None:
        return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    return (
        rf"(?is)<{tag}\s(?:[^>]*\s)?class=[\x22'](?:[^\x22'>]*\s)?{css_class}(?:\s[^\x22'>]*)?[\x22']"
        rf"[^>]*>(.*?)</{tag}>"
    )


@dataclass(frozen=True)
class Element:
    """An element that may hold elements of its own tag."""

    tag: str
    css_class: str | None = None

    @property
    def opening(self) -> str:
        """Pattern of its start tag."""
        whole = element(self.tag, self.css_class)
        return whole[: whole.index("(.*?)")]


def element_content(markup: Column, wanted: Element) -> Column:
    """Content of the first such element, up to the end tag of the same depth.

    Depth counts elements of the same tag, so an inner element left open by another tag
    does no harm; one that is never closed goes to the end of the markup, as in a
    browser. Comments are no markup. The counting runs only where an element of the
    tag stands inside.
    """
    tag = wanted.tag
    bare = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    head = F.regexp_substr(bare, F.lit(wanted.opening))
    tail = bare.substr(F.regexp_instr(bare, F.lit(wanted.opening)) + F.length(head), F.length(bare))
    first = F.regexp_extract(tail, rf"(?is)^(.*?)</{tag}\s*>", 1)
    closes = tail.rlike(rf"(?i)</{tag}\s*>")
    return F.when(closes & ~first.rlike(rf"(?i)<{tag}(?=[\s>/])"), first).otherwise(_by_depth(tail, tag))


def _by_depth(tail: Column, tag: str) -> Column:
    """``tail`` up to the end tag that no start tag in it answers."""
    pieces = F.split(tail, rf"(?i)(?=</?{tag}[\s>/])")

    def step(at: Column, piece: Column) -> Column:
        change = F.when(piece.startswith("</"), -1).when(piece.rlike(r"^<[^>]*/>"), 0).otherwise(1)
        depth = at["depth"] + change
        inside = at["inside"] & (depth >= 0)
        return F.struct(
            depth.alias("depth"), (at["taken"] + inside.cast("int")).alias("taken"), inside.alias("inside")
        )

    # The first piece stands before any such tag, unless the tail begins with one.
    leads = F.element_at(pieces, 1).rlike(rf"(?i)^</?{tag}[\s>/]")
    rest = F.when(leads, pieces).otherwise(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(True).alias("inside"))
    taken = F.aggregate(rest, start, step)["taken"] + F.when(leads, 0).otherwise(1)
    return F.array_join(F.slice(pieces, 1, taken), "")


def content(markup: Column, wanted: str | Element) -> Column:
    """Content by an element, or the first group of a pattern; null where there is none."""
    return first_match(markup, wanted) if isinstance(wanted, str) else element_content(markup, wanted)


HREF = r"(?is)<a\s(?:[^>]*\s)?href=[\x22']([^\x22'>]*)[\x22']"
ANCHOR = r"(?is)<a\s(?:[^>]*\s)?href=[\x22'][^\x22'>]*[\x22'][^>]*>.*?</a>"


def text_of(markup: Column, glue: bool = False, every_entity: bool = False) -> Column:
    """Text without tags, trimmed. ``glue`` strips the blanks around each tag."""
    tags = r"\s*<[^>]*>\s*" if glue else r"<[^>]*>"
    bare = F.regexp_replace(F.regexp_replace(markup, tags, ""), r"^\s+|\s+$", "")
    return decode_entities(bare, every_entity)


def links(markup: Column) -> Column:
    """All anchors in order: array of (href, text)."""
    return F.transform(
        F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(0)),
        lambda a: F.struct(
            decode_entities(F.regexp_extract(a, HREF, 1)).alias("href"), text_of(a).alias("text")
        ),
    )


def link_by_text(found: Column, text_pattern: str, href_pattern: str | None = None) -> Column:
    """href of the first link whose text matches (any case), else whose href does."""
    by_text = F.get(F.filter(found, lambda x: x["text"].rlike(f"(?i){text_pattern}")), F.lit(0))
    if href_pattern is None:
        return by_text["href"]
    by_href = F.get(F.filter(found, lambda x: x["href"].rlike(href_pattern)), F.lit(0))
    return F.coalesce(by_text["href"], by_href["href"])


def url_params(url: Column) -> Column:
    """Query string as a map; no or malformed query gives an empty map."""
    query = F.get(F.split(url, r"\?"), F.lit(1))
    sound = query.rlike(r"^[^=&]*=[^=&]*(?:&[^=&]*=[^=&]*)*$")
    # The last of a repeated name counts, as when a map is filled in order.
    pairs = F.transform(F.split(query, "&"), lambda p: F.split(p, "="))
    names = F.array_distinct(F.transform(pairs, lambda p: p[0]))
    filled = F.map_from_entries(
        F.transform(
            names,
            lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p[0] == k), -1)[1]),
        )
    )
    return F.when(sound, filled).otherwise(F.create_map().cast("map<string,string>"))


def start_of(url: Column) -> Column:
    """The ``start`` parameter as a number, 0 by default."""
    return F.coalesce(F.try_element_at(url_params(url), F.lit("start")).try_cast("int"), F.lit(0))


def usable_href(href: Column, host: str | Column) -> Column:
    """Not a script, and relative to the site root or on the site itself."""
    site = F.lit(host) if isinstance(host, str) else host
    return ~F.lower(href).startswith("javascript:") & (href.startswith("/") | href.contains(site))


def absolute_url(href: Column, page_url: Column) -> Column:
    """Prefix the page's site when the link starts at the root."""
    site = F.regexp_extract(page_url, r"^[a-zA-Z]+://[^/?#]+", 0)
    return F.when(href.startswith("/"), F.concat(site, href)).otherwise(href)


def next_page_link(found: Column, page_url: Column, step: int = 10) -> Column:
    """href of the following page: ``start`` = current + step, else by number."""
    start = start_of(page_url) + step
    number = (F.floor(start / step) + 1).cast("string")
    by_start = F.get(
        F.filter(found, lambda x: x["href"].contains(F.concat(F.lit("start="), start.cast("string")))),
        F.lit(0),
    )
    by_number = F.get(F.filter(found, lambda x: x["text"] == number), F.lit(0))
    return F.coalesce(by_start["href"], by_number["href"])
