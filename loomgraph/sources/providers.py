"""Who extracts entities and relations from a chunk: rules, replayed answers, or a language model behind a callable."""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable
from typing import Protocol

from .domains import Domain
from .ingest import json_object

TRIES = 3
MAX_WAIT = 60
MAX_LIMITED = 8


class RateLimited(Exception):
    """The service asks to wait."""


class Provider(Protocol):
    model: str

    def answer(self, prompt: str) -> str: ...


class Limiter:
    """At most ``rpm`` calls in any 60 seconds, for one task; give each task its share."""

    def __init__(self, rpm: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rpm, self.clock, self.sleep, self.calls = rpm, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= 60:
            self.calls.popleft()
        if len(self.calls) >= self.rpm:
            self.sleep(60 - (now - self.calls[0]))
            now = self.clock()
            while self.calls and now - self.calls[0] >= 60:
                self.calls.popleft()
        self.calls.append(now)


class Remote:
    """Any ``call(prompt) -> text`` with retries: on errors, on empty answers, and with growing waits where it is rate limited."""

    def __init__(self, model: str, call: Callable[[str], str], rpm: int = 40, sleep: Callable[[float], None] = time.sleep) -> None:
        self.model, self.call, self.limiter, self.sleep = model, call, Limiter(rpm, sleep=sleep), sleep
        self.calls = 0

    def answer(self, prompt: str) -> str:
        failed = limited = 0
        while True:
            self.limiter.wait()
            self.calls += 1
            try:
                if (found := self.call(prompt)).strip():
                    return found
                error: Exception = ValueError("empty answer")
            except RateLimited as e:
                limited += 1
                if limited > MAX_LIMITED:
                    raise
                self.sleep(min(MAX_WAIT, 5 * 2 ** (limited - 1)))
                error = e
                continue
            except Exception as e:  # noqa: BLE001 - whatever the service's client raises
                error = e
            failed += 1
            if failed >= TRIES:
                raise error
            self.sleep(2**failed)


class Replay:
    """Stored answers by chunk text; an unknown chunk has an empty one."""

    model = "replay/answers"

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def answer(self, prompt: str) -> str:
        text = prompt.rsplit("\nTEXT:\n", 1)[-1]
        return self.answers.get(text, '{"entities": [], "relations": []}')


_NAME = re.compile(r"\b[A-Z][\w'-]+(?: (?:of |de |van )?[A-Z][\w'-]+)*")
_ORG = re.compile(r"\b(?:Corp|Inc|Ltd|LLC|Company|University|Institute|Bank|Group|Agency|Department)\b")


class Rules:
    """Capitalised names are entities; two in one sentence are associated."""

    model = "rules/capitals"

    def answer(self, prompt: str) -> str:
        text = prompt.rsplit("\nTEXT:\n", 1)[-1]
        entities, relations = {}, []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            names = list(dict.fromkeys(m.group() for m in _NAME.finditer(sentence) if m.start() or " " in m.group()))
            for n in names:
                kind = "ORGANIZATION" if _ORG.search(n) else "PERSON" if " " in n else "CONCEPT"
                entities.setdefault(n, {"name": n, "entity_type": kind, "confidence": 0.6, "context": sentence.strip()})
            relations += [{"relation_type": "ASSOCIATED_WITH", "source_entity": a, "target_entity": b, "confidence": 0.5, "evidence": sentence.strip()} for a, b in zip(names, names[1:])]
        return json.dumps({"entities": list(entities.values()), "relations": relations})


def extraction_prompt(text: str, domain: Domain, context: str = "") -> str:
    """What a language model is asked for one chunk."""
    lines = ["Find the entities and relations in the text. Answer with one JSON object:", '{"entities": [{"name", "entity_type", "attributes", "confidence", "context"}], "relations": [{"relation_type", "source_entity", "target_entity", "confidence", "evidence"}]}']
    if domain.system_context:
        lines.append(domain.system_context)
    if domain.entity_types:
        lines.append("Entity types: " + "; ".join(f"{k} {e.description} {' '.join(e.extraction_hints)}".strip() for k, e in domain.entity_types.items()))
        lines += [f"{k} may only be one of: {', '.join(e.canonical_names)}" + (f"; any other is {e.canonical_fallback_type}" if e.canonical_fallback_type else "") for k, e in domain.entity_types.items() if e.canonical_names]
    else:
        lines.append("Choose fitting types in capitals, and use the same type for the same kind of thing.")
    for k, r in domain.relation_types.items():
        ends = f" ({'/'.join(r.source_types)} to {'/'.join(r.target_types)})" if r.source_types and r.target_types else ""
        lines.append(f"Relation {k}{ends}{', either way round' if r.symmetric else ''} {r.description} {' '.join(r.extraction_hints)}".rstrip())
    if domain.fallback_relation:
        lines.append(f"Where none fits use {domain.fallback_relation}.")
    if context:
        lines.append(f"About the document: {context}")
    return "\n".join(lines) + f"\nTEXT:\n{text}"


def _number(v, default: float = 0.5) -> float | None:
    try:
        f = default if v is None else float(v)
    except (TypeError, ValueError):
        return None
    return f if 0 <= f <= 1 else None


def read_answer(answer: str) -> tuple[list[tuple], list[tuple]]:
    """(entities, relations) of an answer; items that don't fit are left out, an answer without JSON has none."""
    try:
        found = json_object(answer)
    except ValueError:
        return [], []
    entities, relations = [], []
    for e in found.get("entities") or []:
        if isinstance(e, dict) and isinstance(e.get("name"), str) and e["name"].strip() and (c := _number(e.get("confidence"))) is not None:
            attrs = e.get("attributes") if isinstance(e.get("attributes"), dict) else {}
            text = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in attrs.items() if v is not None}
            entities.append((e["name"], str(e.get("entity_type") or "UNKNOWN"), text, c, str(e.get("context") or "")))
    for r in found.get("relations") or []:
        if isinstance(r, dict) and r.get("source_entity") and r.get("target_entity") and (c := _number(r.get("confidence"))) is not None:
            relations.append((str(r.get("relation_type") or "ASSOCIATED_WITH"), str(r["source_entity"]), str(r["target_entity"]), c, str(r.get("evidence") or "")))
    return entities, relations


def discover_domain(samples: list[str], provider: Provider) -> Domain:
    """A vocabulary designed from at most five samples of 3000 characters."""
    from .domains import parsed

    prompt = "Design 5 to 15 entity types and 8 to 20 relation types for these documents. Answer with one JSON object: " '{"entity_types": {NAME: {"description"}}, "relation_types": {NAME: {"description", "source_types", "target_types"}}}' + "\nTEXT:\n" + "\n---\n".join(s[:3000] for s in samples[:5])
    found = json_object(provider.answer(prompt))
    return parsed({"name": "discovered"} | {k: found[k] for k in ("entity_types", "relation_types") if isinstance(found.get(k), dict)})
