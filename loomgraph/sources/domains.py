"""Vocabularies of entity and relation types: bundled ones, YAML files, and ones found in the documents."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import lru_cache

import yaml

from ..operators.clean import Ends
from ..schemas import FALLBACK_RELATION


@dataclass
class EntityType:
    description: str = ""
    extraction_hints: list[str] = field(default_factory=list)
    canonical_names: list[str] = field(default_factory=list)
    canonical_fallback_type: str | None = None


@dataclass
class RelationType:
    source_types: list[str] = field(default_factory=list)
    target_types: list[str] = field(default_factory=list)
    review_required: bool = False
    symmetric: bool = False
    description: str = ""
    extraction_hints: list[str] = field(default_factory=list)


@dataclass
class Domain:
    name: str
    entity_types: dict[str, EntityType] = field(default_factory=dict)
    relation_types: dict[str, RelationType] = field(default_factory=dict)
    system_context: str | None = None
    fallback_relation: str | None = None
    schema_free: bool = False
    description: str = ""
    version: str = "1.0.0"

    def rules(self) -> dict[str, Ends]:
        return {k: (r.source_types, r.target_types, r.symmetric) for k, r in self.relation_types.items()}

    def review_types(self) -> tuple[str, ...]:
        return tuple(k for k, r in self.relation_types.items() if r.review_required)

    def closed(self) -> dict[str, tuple]:
        """Entity types that allow only listed names, and the type that others get."""
        return {k: (e.canonical_names, e.canonical_fallback_type) for k, e in self.entity_types.items() if e.canonical_names}


def _types(v) -> list[str]:
    return [str(x).strip().upper() for x in v or [] if str(x).strip()]


def _config(v) -> dict:
    return {"description": v} if isinstance(v, str) else dict(v or {})


def parsed(raw: dict) -> Domain:
    """A domain from its YAML: a type may be a plain description, end types are put in capitals."""
    raw = raw.get("domain", raw)
    if not isinstance(raw, dict) or not raw.get("name"):
        raise ValueError("a domain needs a name")
    known = lambda cls, c: {k: v for k, v in c.items() if k in cls.__dataclass_fields__ and v is not None}
    entities = {k.upper(): EntityType(**known(EntityType, _config(v))) for k, v in (raw.get("entity_types") or {}).items()}
    for e in entities.values():
        e.canonical_fallback_type = e.canonical_fallback_type.upper() if e.canonical_fallback_type else None
    relations = {}
    for k, v in (raw.get("relation_types") or {}).items():
        c = known(RelationType, _config(v))
        relations[k.upper()] = RelationType(**(c | {x: _types(c.get(x)) for x in ("source_types", "target_types")}))
    plain = {k: raw[k] for k in ("name", "version", "description", "system_context", "fallback_relation", "schema_free") if raw.get(k) is not None}
    return Domain(**plain, entity_types=entities, relation_types=relations)


@lru_cache(maxsize=64)
def _loaded(path: str) -> Domain:
    with open(path, encoding="utf-8") as f:
        return parsed(yaml.safe_load(f) or {})


def loaded(path: str) -> Domain:
    if not os.path.isfile(path):
        raise ValueError(f"no domain file {path}")
    return _loaded(os.path.realpath(path))


#: kind: bundled name -> entity types, and relation types as "NAME sources > targets" with ~ for symmetric, ! for review.
_P, _O, _L = "PERSON", "ORGANIZATION", "LOCATION"
_ORGS = "ORGANIZATION SHELL_COMPANY"
_IDEAS = "THEORY CONCEPT METHOD SYSTEM"
_BUNDLED = {
    "general": (
        "PERSON ORGANIZATION LOCATION DOCUMENT EVENT",
        f"""ASSOCIATED_WITH {_P} {_O} {_L} > {_P} {_O} {_L} ~
MEMBER_OF {_P} > {_O}
EMPLOYED_BY {_P} > {_O}
LOCATED_IN {_O} {_L} EVENT > {_L}
PARTICIPATED_IN {_P} {_O} > EVENT
MENTIONED_IN {_P} {_O} {_L} EVENT > DOCUMENT
OWNS {_P} {_O} > {_O} {_L}
CREATED {_P} {_O} > DOCUMENT {_O}
RELATED_TO {_P} > {_P} ~""",
    ),
    "osint": (
        "PERSON ORGANIZATION SHELL_COMPANY FINANCIAL_ACCOUNT LOCATION DOCUMENT EVENT",
        f"""BENEFICIAL_OWNER_OF {_P} > {_ORGS} !
DIRECTOR_OF {_P} > {_ORGS}
SHAREHOLDER_OF {_P} {_ORGS} > {_ORGS}
TRANSACTED_WITH {_P} {_ORGS} FINANCIAL_ACCOUNT > {_P} {_ORGS} FINANCIAL_ACCOUNT !
SUBSIDIARY_OF {_ORGS} > {_ORGS}
REGISTERED_IN {_ORGS} > {_L}
SIGNATORY_OF {_P} > FINANCIAL_ACCOUNT DOCUMENT
ASSOCIATED_WITH {_P} {_ORGS} > {_P} {_ORGS} ~
LOCATED_IN {_P} {_ORGS} FINANCIAL_ACCOUNT > {_L}
MENTIONED_IN {_P} {_ORGS} FINANCIAL_ACCOUNT {_L} EVENT > DOCUMENT""",
    ),
    "academic": (
        "CONCEPT THEORY METHOD FINDING PHENOMENON RESEARCHER PUBLICATION SYSTEM FIELD",
        f"""SUPPORTS FINDING PUBLICATION SYSTEM METHOD CONCEPT > {_IDEAS} FINDING PHENOMENON
CONTRADICTS FINDING PUBLICATION SYSTEM METHOD > {_IDEAS} FINDING !
EXTENDS {_IDEAS} > {_IDEAS}
IMPLEMENTS SYSTEM > {_IDEAS}
USES_METHOD PUBLICATION FINDING SYSTEM METHOD THEORY > METHOD SYSTEM CONCEPT
INVESTIGATES PUBLICATION RESEARCHER METHOD SYSTEM CONCEPT > PHENOMENON CONCEPT SYSTEM
EXPLAINS {_IDEAS} > PHENOMENON FINDING CONCEPT METHOD SYSTEM
PROPOSED_BY {_IDEAS} FINDING PUBLICATION > RESEARCHER PUBLICATION
APPLIED_TO {_IDEAS} > PHENOMENON FIELD SYSTEM
BELONGS_TO CONCEPT THEORY METHOD PHENOMENON RESEARCHER > FIELD
MENTIONED_IN {_IDEAS} FINDING PHENOMENON RESEARCHER FIELD > PUBLICATION
ASSOCIATED_WITH {_IDEAS} FINDING PHENOMENON RESEARCHER PUBLICATION FIELD > {_IDEAS} FINDING PHENOMENON RESEARCHER PUBLICATION FIELD ~""",
    ),
}


def bundled_names() -> list[str]:
    return sorted([*_BUNDLED, "schema-free"])


def bundled(name: str = "schema-free") -> Domain:
    if name == "schema-free":
        return Domain(name, schema_free=True)
    if name not in _BUNDLED:
        raise ValueError(f"no bundled domain {name!r}; there are {', '.join(bundled_names())}")
    kinds, lines = _BUNDLED[name]
    relations = {}
    for line in lines.splitlines():
        head, _, target = line.partition(" > ")
        kind, *sources = head.split()
        targets = [t for t in target.split() if t not in "~!"]
        relations[kind] = RelationType(source_types=sources, target_types=targets, symmetric="~" in target, review_required="!" in target)
    return Domain(name, entity_types={k: EntityType() for k in kinds.split()}, relation_types=relations, fallback_relation=FALLBACK_RELATION)


def selected(path: str | None, name: str = "schema-free") -> Domain:
    """The file where a path is given and there is one, a bundled domain of that name where there is none, else ``name``."""
    if path:
        return loaded(path) if os.path.isfile(path) else bundled(path)
    return bundled(name)


def found_domain(folder: str) -> Domain | None:
    """The vocabulary found in the documents, if it has been saved and can be read."""
    try:
        return loaded(f"{folder}/discovered_domain.yaml")
    except (ValueError, TypeError, yaml.YAMLError):
        return None


def save(domain: Domain, path: str) -> None:
    plain = lambda x: {k: v for k, v in vars(x).items() if v}
    out = plain(domain) | {k: {n: plain(t) for n, t in getattr(domain, k).items()} for k in ("entity_types", "relation_types") if getattr(domain, k)}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(out, f, sort_keys=False, allow_unicode=True)
    _loaded.cache_clear()
