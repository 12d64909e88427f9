"""Settings in layers: arguments, then environment, then a ``.env`` file, then the project's YAML, then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

import yaml

PREFIX = "LOOM_"
OCR_BACKENDS = tuple("tesseract easyocr paddleocr gcv".split())
EXTRACTORS = ("rich", "legacy")
#: Providers that run here and need no key.
KEYLESS = ("rules", "replay", "local", "ollama")


@dataclass
class Config:
    domain: str | None = None
    model: str = "rules/capitals"
    output: str = "output"
    extractor: str = "rich"
    ocr: bool = False
    ocr_backend: str = "tesseract"
    ocr_language: str = "eng"
    chunk_size: int = 10_000
    rpm: int = 40
    review_threshold: float = 0.7


def _env_file(path: str) -> dict[str, str]:
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def _project(path: str) -> dict:
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    inner = raw.pop("extraction", None) or {}
    return raw | {{"backend": "extractor", "language": "ocr_language"}.get(k, k): v for k, v in inner.items()}


def _typed(value, kind: str):
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float}.get(kind, str)(value)


def load(folder: str = ".", **given) -> Config:
    """The settings for a project folder; a value out of its list is a ValueError."""
    dotenv, project = _env_file(os.path.join(folder, ".env")), _project(os.path.join(folder, "loom.yaml"))
    values = {}
    for f in fields(Config):
        key = PREFIX + f.name.upper()
        for v in (given.get(f.name), os.environ.get(key), dotenv.get(key), project.get(f.name)):
            if v is not None:
                values[f.name] = _typed(v, str(f.type).split(" ")[0])
                break
    c = Config(**values)
    if c.extractor not in EXTRACTORS:
        raise ValueError(f"extractor must be one of {', '.join(EXTRACTORS)}")
    if c.ocr_backend not in OCR_BACKENDS:
        raise ValueError(f"OCR backend must be one of {', '.join(OCR_BACKENDS)}")
    c.output = os.path.abspath(os.path.join(folder, c.output))
    os.makedirs(c.output, exist_ok=True)
    return c


def check_key(model: str) -> None:
    """A provider that is reached over the network needs a key in the environment."""
    provider = model.split("/", 1)[0]
    if provider not in KEYLESS and not os.environ.get(f"{provider.upper()}_API_KEY"):
        raise ValueError(f"model {model} needs {provider.upper()}_API_KEY")
