"""Documents from folders: discovery, text extraction by format, OCR rules."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import mimetypes
import os
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TEXT = set(".txt .md .rst .log .tex .org .bib".split())
LEGACY = set(".docx .htm .html .md .pdf .txt".split())
RICH = LEGACY | TEXT | set(".csv .eml .epub .json .jsonl .odt .pptx .svg .tsv .xlsx .xml .yaml .yml .zip".split())
MIME = {x: mimetypes.types_map.get(x) or "text/markdown" for x in LEGACY}
MIN_PAGE_CHARS = 15
MIN_OCR_CHARS = 50


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    """Visible text: nothing of script, style and head, a line for each text node."""
    p = _Visible()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


@F.pandas_udf(StringType())
def visible_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html_text)


def decoded(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _xml_paragraphs(data: bytes, paragraph: str, run: str) -> list[str]:
    root = ElementTree.fromstring(data)
    return [t for p in root.iter() if p.tag.endswith("}" + paragraph) and (t := "".join(r.text or "" for r in p.iter() if r.tag.endswith("}" + run))).strip()]


def _office(data: bytes, prefix: str, paragraph: str, run: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if n.startswith(prefix) and n.endswith(".xml")), key=lambda n: (len(n), n))
        return "\n\n".join(t for n in names for t in _xml_paragraphs(z.read(n), paragraph, run))


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(_xml_paragraphs(z.read("word/document.xml"), "p", "t"))


def pdf_pages(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs a PDF library") from e
    return [(p.extract_text() or "") for p in PdfReader(io.BytesIO(data)).pages]


def near_empty(pages: list[str]) -> bool:
    """Too little text to be more than a scan."""
    return not pages or sum(len(p.strip()) for p in pages) / len(pages) < MIN_PAGE_CHARS


def _email(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    return "\n".join(x for x in (m["subject"], html_text(text) if body and body.get_content_subtype() == "html" else text) if x)


def _zip(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(parse(n, z.read(n), "rich") for n in sorted(z.namelist()) if suffix(n) in RICH - {".zip"})


def _sheet(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "xl/sharedStrings.xml" not in z.namelist():
            return ""
        return "\n".join(_xml_paragraphs(z.read("xl/sharedStrings.xml"), "si", "t"))


def _epub(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(html_text(decoded(z.read(n))) for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm")))


def suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


PARSERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(TEXT | {".json", ".jsonl", ".yaml", ".yml"}, decoded), ".html": lambda d: html_text(decoded(d)), ".htm": lambda d: html_text(decoded(d)),
    ".xml": lambda d: "\n".join(t.strip() for t in ElementTree.fromstring(d).itertext() if t.strip()), ".svg": lambda d: "\n".join(t.strip() for t in ElementTree.fromstring(d).itertext() if t.strip()),
    ".csv": lambda d: "\n".join(", ".join(r) for r in csv.reader(io.StringIO(decoded(d)))), ".tsv": lambda d: "\n".join(", ".join(r) for r in csv.reader(io.StringIO(decoded(d)), delimiter="\t")),
    ".docx": docx_text, ".pptx": lambda d: _office(d, "ppt/slides/slide", "p", "t"), ".xlsx": _sheet, ".odt": lambda d: _odt(d), ".epub": _epub, ".eml": _email, ".zip": _zip, ".pdf": lambda d: "\n\n".join(pdf_pages(d)),
}


def _odt(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n\n".join(t for p in root.iter() if p.tag.endswith(("}p", "}h")) and (t := "".join(p.itertext())).strip())


def supported(backend: str = "rich") -> set[str]:
    if backend not in ("rich", "legacy"):
        raise ValueError(f"unknown extractor {backend!r}; there are rich and legacy")
    return RICH if backend == "rich" else LEGACY


def parse(path: str, data: bytes, backend: str = "rich") -> str:
    """The text of one file; a format that isn't supported, or a file that can't be read, is a ValueError."""
    ext = suffix(path)
    if ext not in supported(backend):
        raise ValueError(f"unsupported file type {ext!r}")
    try:
        return PARSERS[ext](data)
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"can't read {path}: {e}") from e


def discovered(spark: SparkSession, folder: str, backend: str = "rich") -> DataFrame:
    """(path, content, length, …) of all supported files below ``folder``, by path."""
    if "://" not in folder and not os.path.isdir(folder):
        raise ValueError(f"no such folder: {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(*sorted(supported(backend))))


def needs_ocr(extension: Column, text: Column, ocr: bool, ocr_backend: str) -> Column:
    """Whether cloud OCR should read the file: a PDF with next to no text."""
    return F.lit(ocr and ocr_backend == "gcv") & (F.lower(extension) == ".pdf") & (F.length(F.trim(text)) < MIN_OCR_CHARS)


def documents(spark: SparkSession, folder: str, backend: str = "rich", ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(doc_id, path, mime_type, text, error) of a folder; ``ocr`` reads a PDF without text."""
    supported(backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                text = error = None
                try:
                    text = parse(path, bytes(data), backend)
                    if ocr and suffix(path) == ".pdf" and len(text.strip()) < MIN_OCR_CHARS:
                        text = ocr(bytes(data))
                except ValueError as e:
                    error = str(e)
                rows.append((os.path.splitext(os.path.basename(path))[0], path, MIME.get(suffix(path)), text, error))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "mime_type", "text", "error"])

    return discovered(spark, folder, backend).select("path", "content").mapInPandas(run, "doc_id string, path string, mime_type string, text string, error string")


def json_object(text: str) -> dict:
    """The JSON object in a model's answer: all of it, what a code fence holds, or the first balanced braces; else a ValueError."""
    t = text.strip()
    if t.startswith("```"):
        t = t.split("\n", 1)[1] if "\n" in t else ""
        t = t.rsplit("```", 1)[0].strip()
    try:
        found = json.loads(t)
        if isinstance(found, dict):
            return found
    except json.JSONDecodeError:
        pass
    decoder, at = json.JSONDecoder(), t.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(t, at)
            if isinstance(found, dict):
                return found
        except json.JSONDecodeError:
            pass
        at = t.find("{", at + 1)
    raise ValueError("no JSON object in the answer")
