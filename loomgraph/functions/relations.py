"""Relation types: passive forms, synonyms, labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACTIVE = (
    "AUTHORIZES CAUSES CONSTRAINS CONTROLS CREATES EMPLOYS ENABLES ENFORCES FUNDS GOVERNS INFLUENCES "
    "INVESTIGATES MAINTAINS MANAGES MONITORS OPERATES OPPOSES OWNS REGULATES SUPPORTS"
).split()


def _participle(verb: str) -> str:
    stem = verb[:-1]
    return stem + ("D" if stem.endswith("E") else "LED" if stem == "CONTROL" else "ED")


PASSIVE = {_participle(v) + "_BY": v for v in _ACTIVE} | {"ENABLEDBY": "ENABLES"}

SYNONYMS = {
    old: new
    for new, olds in {
        "ASSOCIATED_WITH": "SUBPOENAED TOLD_TO SENT_TO GAVE_TO INVESTIGATED MARRIED_TO FRIEND_OF REPRESENTS DEFENDS",
        "LOCATED_IN": "REGISTERED_AT", "OWNS": "OWNED", "PARTICIPATED_IN": "DEFENDANT_IN", "RESIDED_AT": "STAYED_AT", "TRAVELED_TO": "TRAVELED_FROM",
    }.items()
    for old in olds.split()
}

_INVERSE = {"GOVERNS": "governed by", "CONTRADICTS": "contradicted by", "INVOLVES": "involved in", "ENABLED_BY": "enables", "RESPONSIBLE_FOR": "under responsibility of", "ASSOCIATED_WITH": "associated with"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def active_form(relation_type: Column) -> Column:
    """Active type of a passive one, null for any other: by table, else ``…ED_BY`` to ``…ES`` (``…IED_BY`` to ``…IES``) to the letter."""
    rule = F.when(
        relation_type.rlike("^[A-Z]+ED_BY$"),
        F.when(relation_type.rlike("IED_BY$"), F.regexp_replace(relation_type, "IED_BY$", "IES")).otherwise(F.regexp_replace(relation_type, "ED_BY$", "ES")),
    )
    return F.coalesce(F.try_element_at(_map(PASSIVE), relation_type), rule)


def synonym(relation_type: Column) -> Column:
    return F.try_element_at(_map(SYNONYMS), relation_type)


def label(relation_type: Column) -> Column:
    return F.lower(F.replace(relation_type, F.lit("_"), F.lit(" ")))


def inverse_label(relation_type: Column) -> Column:
    """The relation seen from its target."""
    key = F.upper(F.regexp_replace(relation_type, r"\s+", "_"))
    low = label(relation_type)
    verb = F.when(low.rlike("[^s]s$"), F.concat(F.regexp_replace(low, "s$", ""), F.when(low.rlike("es$"), F.lit("d by")).otherwise(F.lit("ed by"))))
    return F.coalesce(F.try_element_at(_map(_INVERSE), key), verb, F.concat(low, F.lit(" (inverse)")))
