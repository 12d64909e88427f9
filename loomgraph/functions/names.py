"""Names, ids and keys as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MANY = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
_ONE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
for _c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
    _plain = "".join(x for x in unicodedata.normalize("NFKD", chr(_c)) if not unicodedata.combining(x))
    if len(_plain) == 1 and _plain.isascii() and chr(_c) not in _ONE:
        _ONE[chr(_c)] = _plain

#: Honorifics that don't tell one person from another, by kind.
TITLES = sorted(
    (
        "mr mr. mrs mrs. ms ms. miss sir dame lord lady dr dr. doctor prof. professor "
        "judge justice hon. honorable attorney atty. counsel esq. esquire "
        "governor gov. senator sen. representative rep. president "
        "father brother sister rev. reverend "
        "agent deputy chief captain cpt. lieutenant lt. sergeant sgt. officer detective det."
    ).split()
    + ["vice president", "special agent"],
    key=lambda t: (-len(t), t),
)
_TITLE_RUN = "^((" + "|".join(re.escape(t) for t in TITLES) + ") +)+"


def transliterated(c: Column) -> Column:
    """Latin letters without their marks; what has no plain form stays."""
    out = c
    for a, b in _MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "".join(_ONE), "".join(_ONE.values()))


def entity_id(name: Column, entity_type: Column) -> Column:
    slug = F.regexp_replace(transliterated(F.lower(F.trim(name))), "[^a-z0-9]+", "_")
    return F.concat(F.lower(entity_type), F.lit(":"), F.btrim(slug, F.lit("_")))


def relation_id(source: Column, relation_type: Column, target: Column, document: Column) -> Column:
    return F.concat_ws("|", source, relation_type, target, document)


def canonical_key(source: Column, relation_type: Column, target: Column) -> Column:
    return F.concat_ws("|", source, relation_type, target)


def name_key(c: Column) -> Column:
    return F.trim(F.lower(c))


def without_titles(c: Column) -> Column:
    """Leading honorifics of a lower-case name removed, one after another."""
    return F.trim(F.regexp_replace(F.trim(c), _TITLE_RUN, ""))


def without_titles_cased(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(transliterated(c)), "(?i)" + _TITLE_RUN, ""))


def normalized(c: Column) -> Column:
    return without_titles(F.trim(F.lower(transliterated(c))))


def person_sort_key(c: Column) -> Column:
    full = normalized(c)
    return F.concat(F.element_at(F.split(full, " +"), -1), F.lit(" "), full)


_IRREGULAR = {"people": "person", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "geese": "goose", "feet": "foot", "teeth": "tooth", "criteria": "criterion", "phenomena": "phenomenon", "analyses": "analysis", "theses": "thesis", "hypotheses": "hypothesis", "crises": "crisis", "matrices": "matrix", "indices": "index", "vertices": "vertex", "data": "datum", "media": "medium", "lives": "life", "wives": "wife", "knives": "knife", "wolves": "wolf", "shelves": "shelf", "leaves": "leaf", "halves": "half"}
_SAME = {"series", "species", "news", "physics", "mathematics", "economics", "politics", "ethics", "athletics", "statistics", "gas", "bus", "lens", "alias", "atlas", "bias", "canvas", "chaos", "always", "texas", "kansas", "paris", "james", "thomas", "us", "is", "was", "has", "this", "its", "his", "plus", "yes"}


def singular(word: str) -> str:
    """An English noun's singular by rule; a word that is none, or is singular, stays."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if word in _SAME or len(word) < 4 or not word.endswith("s") or word.endswith(("ss", "us", "is")):
        return word
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("sses", "shes", "ches", "xes", "zes")):
        return word[:-2]
    return word[:-1]


@F.pandas_udf(StringType())
def _singular_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        known = {v: None if v is None else " ".join(map(singular, v.split())) for v in s.unique()}
        yield s.map(known)


def dedup_key(c: Column) -> Column:
    """Names of one key are variants: case, marks, titles and number apart they are the same."""
    return _singular_words(normalized(c))
