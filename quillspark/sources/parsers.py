"""Zipped office files as array UDFs, and tolerant maps as a column function."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECTION = "array<struct<title:string,content:string,level:int>>"
Section = tuple[str, str, int]


def parsed(docs: DataFrame, parse: Callable[[object], list[Section]], key: str = "path", content: str = "content") -> DataFrame:
    """docs through a parser of one document, batch by batch; a document that cannot be read has no sections."""

    @F.pandas_udf(_SECTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = []
            for raw in series:
                try:
                    out.append([{"title": t, "content": c, "level": n} for t, c, n in parse(raw)] if raw is not None else [])
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    out.append([])
            yield pd.Series(out, dtype=object)

    rows = docs.select(key, F.posexplode(run(F.col(content))).alias("place", "s"))
    return rows.select(key, "place", "s.title", "s.content", "s.level")


def tolerant_map(text: Column) -> Column:
    """A flat map from JSON, from the first {...} in prose, or from `key: value` lines."""
    whole = F.from_json(text, "map<string,string>")
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "map<string,string>")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    key = lambda x: F.regexp_replace(F.trim(F.substring_index(x, ":", 1)), r"^[\"'\-* ]+|[\"'\-* ]+$", "")
    value = lambda x: F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), r"^[\"',]+|[\"',]+$", "")
    pairs = F.filter(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))), lambda p: p["key"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.coalesce(whole, inner, F.map_from_entries(last))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t")


def header_row(rows: list[list[str]]) -> bool:
    """A first row of short, filled cells is a header if numbers follow or the sheet is long."""
    if len(rows) < 2 or not all(c and len(c) < 100 for c in rows[0]):
        return False
    return len(rows) > 10 or any(re.fullmatch(r"-?\d+(\.\d+)?", c or "") for r in rows[1:5] for c in r)


def xlsx_sections(raw: bytes, size: int = 100, cell: int = 50) -> list[Section]:
    """Sheets as text tables of `size` rows; empty rows are dropped and long cells cut."""
    out: list[Section] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(s) == "si"] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        titles = [s.get("name", "") for s in book.iter() if _tag(s) == "sheet"]
        for k, title in enumerate(titles, 1):
            path = f"xl/worksheets/sheet{k}.xml"
            if path not in names:
                continue
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(path)).iter() if _tag(r) == "row"):
                cells = []
                for c in (c for c in row if _tag(c) == "c"):
                    v = next((x.text or "" for x in c if _tag(x) == "v"), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else _texts(c) if c.get("t") == "inlineStr" else v)
                if any(x.strip() for x in cells):
                    rows.append([x.strip() for x in cells])
            head, body = (rows[0], rows[1:]) if header_row(rows) else ([], rows)
            for a in range(0, len(body), size):
                lines = [" | ".join(x[:cell] for x in r) for r in ([head] if head else []) + body[a : a + size]]
                out.append((f"{title} (rows {a + 1}-{min(a + size, len(body))})", "\n".join(lines), 1))
    return out


def pptx_sections(raw: bytes) -> list[Section]:
    """A section per slide: its first short text is the title; tables and speaker notes are marked."""
    out: list[Section] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for k, name in enumerate(slides, 1):
            root, texts = ElementTree.fromstring(z.read(name)), []
            inside = {p for t in root.iter() if _tag(t) == "tbl" for p in t.iter()}
            for e in root.iter():
                if _tag(e) == "p" and e not in inside and _texts(e).strip():
                    texts.append(_texts(e).strip())
                elif _tag(e) == "tbl":
                    texts.append("[TABLA]\n" + "\n".join(" | ".join(_texts(c).strip() for c in r if _tag(c) == "tc") for r in e if _tag(r) == "tr"))
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in z.namelist() and (said := _texts(ElementTree.fromstring(z.read(notes))).strip()):
                texts.append(f"[NOTAS DEL ORADOR]\n{said}")
            title = texts.pop(0) if texts and len(texts[0]) < 100 else f"Slide {k}"
            out.append((title, "\n".join(texts), 1))
    return out


def docx_blocks(raw: bytes) -> list[tuple[str, int, str]]:
    """(kind, level, text) of each block in order: heading, paragraph or table (cells by bars, rows by lines)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _tag(e) == "body")
    out = []
    for e in body:
        if _tag(e) == "p":
            style = next((v for x in e.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            m = re.fullmatch(r"(?:Heading|T[ií]tulo)\s*([1-6])", style)
            if text := _texts(e).strip():
                out.append(("heading" if m else "paragraph", int(m[1]) if m else 0, text))
        elif _tag(e) == "tbl":
            rows = [" | ".join(" ".join(_texts(p) for p in c.iter() if _tag(p) == "p").strip() for c in r if _tag(c) == "tc") for r in e if _tag(r) == "tr"]
            out.append(("table", 0, "\n".join(rows)))
    return out


def docx_sections(raw: bytes) -> list[Section]:
    """Blocks between headings; the title is the trail of headings down to the section."""
    out, trail, held, level = [], {}, [], 0
    for kind, n, text in [*docx_blocks(raw), ("heading", 0, "")]:
        if kind != "heading":
            held.append(text)
            continue
        if held:
            out.append((" > ".join(trail[k] for k in sorted(trail)) or "Introduction", "\n".join(held), level))
        trail = {k: v for k, v in trail.items() if k < n} | {n: text}
        held, level = [], n
    return out


