"""Text clean-up, dates, phrases and small value conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR = r"(?:20|19)\d\d"
_DAY = r"\d\d?"
YEAR = rf"\b({_YEAR})\b"
FULL_DATE = rf"\b({_YEAR}-\d\d-\d\d|{_DAY}/{_DAY}/{_YEAR}|\w+ {_DAY},? {_YEAR})\b"
DATE_ATTRIBUTES = "date event_date year start_date end_date".split()
#: Filler that a description should not hold; matched whatever the case.
FILLER = [
    *(rf"\b{w}ing\b" for w in ("highlight", "indicat", "suggest", "underscor")),
    *(rf"this {w}s\b" for w in ("highlight", "indicate", "suggest")),
    *(f"is {w}" for w in ("a key figure", "associated with", "identified as", "mentioned in", "noted for", "significant as")),
    r"played a \w+ role", "played a (?:pivotal|crucial) role", "as evidenced by", "in the context of", "records show", "served as", "the documents reveal", "the source material indicates",
]


def ocr_normalized(text: Column) -> Column:
    """Words joined over a hyphen at a line's end, runs of blank lines cut to one, lines joined before a small letter."""
    steps = {r"(\w)-\n(\w)": "$1$2", r"\n\n\n+": "\n\n", r"(?<!\n)\n(?=[a-z])": " ", r"^\s+|\s+$": ""}
    for pattern, put in steps.items():
        text = F.regexp_replace(text, pattern, put)
    return text


def pages_text(pages: Column) -> Column:
    """Pages (page_number, text) as one text, each under its number; blank pages are left out."""
    inked = F.filter(pages, lambda p: F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != "")
    return F.array_join(F.transform(inked, lambda p: F.concat(F.lit("[PAGE "), p["page_number"].cast("string"), F.lit("]\n"), p["text"])), "\n\n")


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))


def date_in(text: Column) -> Column:
    """The first full date, else the first year, else null."""
    full, year = F.regexp_extract(text, FULL_DATE, 1), F.regexp_extract(text, YEAR, 1)
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(year, F.lit("")))


def filler_phrases(text: Column) -> Column:
    """All filler found, pattern by pattern."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?i)({p})"), F.lit(1)) for p in FILLER]))


def is_placeholder(label: Column) -> Column:
    return label.rlike(r"^Community \d+$")


def support_documents(c: Column) -> Column:
    """A ``;``-separated string as a list without blanks."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def support_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(c.try_cast("int"), F.lit(1)))


def aliases(attributes: Column) -> Column:
    """``aliases``, else ``also_known_as``: a JSON list or a plain string, as a list."""
    raw = F.coalesce(F.nullif(F.try_element_at(attributes, F.lit("aliases")), F.lit("")), F.try_element_at(attributes, F.lit("also_known_as")))
    parsed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(parsed, F.array(raw))).otherwise(F.array(raw))


def type_names(c: Column) -> Column:
    return F.transform(F.filter(c, lambda x: F.trim(x) != ""), lambda x: F.upper(F.trim(x)))


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(8.0), F.least(F.lit(50.0), 6 + degree * 2.5))


def edge_width(support: Column) -> Column:
    return F.least(F.lit(10.0), 1.5 + 2.0 * support)


def rgb(hexa: Column) -> Column:
    return F.struct(*[F.conv(F.substring(hexa, at, 2), 16, 10).cast("int").alias(n) for n, at in (("r", 2), ("g", 4), ("b", 6))])


def community_order(label: Column) -> list[Column]:
    """Sort columns by which ``Community 12`` follows ``Community 2``."""
    return [F.regexp_replace(label, r"\d+$", ""), F.regexp_extract(label, r"(\d+)$", 1).try_cast("int"), label]
