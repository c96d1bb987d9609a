"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions import patterns as P
from jobweave.functions.patterns import java

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that f uses many times, with the column evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def matches(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs; not in a null."""
    return F.coalesce(occurs(c, pattern), F.lit(False))


def occurs(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs; null in a null.  Without its word edges it runs much faster, and rarely matches where it doesn't with them."""
    exact = c.rlike(java(pattern))
    return c.rlike(pattern.replace(r"\b", "")) & exact if r"\b" in pattern else exact


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), P.SPACE + "+", " "))


def filled(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.when(c != "", c)


def top_meta(text: Column) -> Column:
    """Values of labels at the top of a text (first 600 characters): a struct of the labels, null where there is none."""
    return once(F.substring(text, 1, 600), _labels)


def _labels(head: Column) -> Column:
    def grab(label: str) -> Column:
        rest = F.when(occurs(head, "(?i)" + label), F.regexp_extract(head, java(f"(?is){label}(.*)"), 1))
        value = collapse(F.split(rest, java(P.LABEL_STOP), 2)[0])
        return filled(F.regexp_replace(value, r"[.;]+$", ""))

    return F.struct(*[grab(p).alias(k) for k, p in P.LABELS.items()])


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    """Number of a month by its first three letters, as text; null for other words."""
    at = F.call_function("instr", F.lit(MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when((at > 0) & (at % 3 == 1) & (F.length(name) >= 3), ((at + 2) / 3).cast("int").cast("string"))


def _century(year: Column) -> Column:
    return F.when(F.length(year) == 2, F.concat(F.when(year < "50", "20").otherwise("19"), year)).otherwise(year)


def parse_deadline(raw: Column) -> Column:
    """The first date in a text, at midnight UTC: month name and day in either order, year-month-day, or
    numbers with slashes (month first, day first where that is no date).  Other forms give null."""
    return once(F.regexp_replace(raw, r"(\d{1,2})(?i:st|nd|rd|th)\b", "$1"), _first_date).cast("timestamp")


def _first_date(c: Column) -> Column:
    part = lambda pattern, i: F.regexp_extract(c, pattern, i)
    name_first, day_first = r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s*(\d{4})", r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s*(\d{4})"
    iso, slashes = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
    year = _century(part(slashes, 3))
    return F.coalesce(
        F.when(c.rlike(name_first), _date(part(name_first, 3), _month(part(name_first, 1)), part(name_first, 2))),
        F.when(c.rlike(day_first), _date(part(day_first, 3), _month(part(day_first, 2)), part(day_first, 1))),
        F.when(c.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3))),
        F.when(c.rlike(slashes), F.coalesce(_date(year, part(slashes, 1), part(slashes, 2)), _date(year, part(slashes, 2), part(slashes, 1)))),
    )


def find_deadline(text: Column) -> Column:
    """A deadline in prose: behind a label within 80 characters (found but unreadable: none), behind "no later
    than" or "on or before", or behind "by" or "before" where the text is about applying."""
    label = "(?i)" + P.DEADLINE_LABEL
    near = F.substring(F.regexp_extract(text, java(f"(?is){P.DEADLINE_LABEL}.*"), 0), 1, 80)
    labelled = occurs(text, label) & near.rlike(P.DATE_TOKEN)
    token = (
        F.when(labelled, F.regexp_extract(near, P.DATE_TOKEN, 1))
        .when(occurs(text, P.STRONG_DEADLINE), F.regexp_extract(text, java(P.STRONG_DEADLINE), 1))
        .when(occurs(text, P.ABOUT_APPLYING), F.regexp_extract(text, java(P.WEAK_DEADLINE), 1))
    )
    return parse_deadline(token)


def detect_paid(title: Column, text: Column) -> Column:
    """False, true or unknown (null) by the title and the first 1500 characters; unpaid wins."""
    head = F.concat_ws("\n", F.lower(title), F.lower(F.substring(text, 1, 1500)))
    return once(head, lambda h: F.when(occurs(h, P.UNPAID), False).when(occurs(h, P.PAID), True))


def extract_stipend(text: Column) -> Column:
    """The first figure of money, if words about pay stand up to 80 characters before or 40 behind it."""
    value = F.regexp_extract(text, java(P.STIPEND), 0)
    at = F.instr(text, value)
    near = F.substring(text, F.greatest(at - 80, F.lit(1)), F.least(at - 1, F.lit(80)) + F.length(value) + 40)
    return F.when((value != "") & near.rlike(P.STIPEND_CONTEXT), F.regexp_replace(collapse(value), r"[\s.,;:–—-]+$", ""))


def org_from_title(title: Column) -> Column:
    name = F.regexp_extract(title, java(P.AT_ORG), 1)
    return filled(F.trim(F.regexp_replace(name, r"[.,;]+$", "")))


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), r"\(\s*\d+\s*(required|positions?|posts?|vacancies|needed)\s*\)", " ")
    t = F.regexp_replace(t, r"^\s*(internship|intern)\s*[:\-–]\s*", "")
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    t = F.regexp_replace(t, r"\b(internships?|interns?)\b", " ")  # only ASCII is left
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_location(location: Column) -> Column:
    first = F.substring_index(F.lower(F.coalesce(location, F.lit(""))), ",", 1)
    return F.trim(F.regexp_replace(first, r"[^a-z0-9]+", " "))


def normalize_org_name(name: Column) -> Column:
    n = F.replace(F.lower(name), F.lit("&"), F.lit("and"))
    n = F.regexp_replace(n, java(r"\b(the|inc|ltd|plc|ngo|organization|organisation)\b"), "")
    return F.trim(F.regexp_replace(n, r"[^a-z0-9]+", " "))


def description_tokens(text: Column) -> Column:
    """Distinct words of four or more ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 4))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def without(html: Column, elements: tuple[str, ...]) -> Column:
    """Markup without these elements and all they hold."""
    for tag in elements:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return html


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, breaks and block edges become line feeds, cell ends become spaces,
    entities are decoded, blanks collapse."""
    t = F.regexp_replace(without(html, ("script", "style", "noscript")), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:td|th)\s*>", "\t")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.regexp_replace(t, r"[\t\x0B\f\r \x{a0}]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


# Block elements and named entities.
BLOCKS = "p|div|section|article|aside|header|footer|main|h1|h2|h3|h4|h5|h6|ul|ol|li|dl|dt|dd|table|caption|tr|blockquote|figure|figcaption|pre|address|fieldset|hr"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


#: Tags that show markup, and the entities that a payload stored twice escaped is read with, in this order.
SHOWN_TAGS = "p|div|br|ul|ol|li|h[1-6]|b|strong|i|em|u|a|span|blockquote|table"
ESCAPES = ((r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#0?39;", "'"), (r"&nbsp;", " "), (r"&amp;", "&"))


def has_markup(c: Column) -> Column:
    return matches(c, rf"(?i)<(?:{SHOWN_TAGS})\b")


def source_markup(html: Column, text: Column) -> Column:
    """What the reader renders, once cleaned: markup in the page column, else markup that it holds escaped, else markup in the
    text, else markup escaped there, else nothing ("")."""
    page, plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"^\s+|\s+\z", ""), F.coalesce(text, F.lit(""))
    escaped = lambda c: matches(c, rf"(?i)&lt;(?:{SHOWN_TAGS})\b")

    def read(c: Column) -> Column:
        for entity, char in ESCAPES:
            c = F.regexp_replace(c, entity, char)
        return c

    return F.when(has_markup(page), page).when(escaped(page), read(page)).when(has_markup(plain), plain).when(escaped(plain), read(plain)).otherwise("")


def clamp(c: Column, most: int) -> Column:
    """A text without white space around it, cut to ``most`` characters with an ellipsis as the last."""
    t = F.regexp_replace(c, r"^\s+|\s+\z", "")
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"\s+\z", ""), F.lit("…"))).otherwise(t)
