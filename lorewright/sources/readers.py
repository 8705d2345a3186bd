"""Reading documents from files."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorewright.functions.text import normalize_text, strip
from lorewright.operators.pages import html_blocks, is_structural
from lorewright.schemas import PROFILES

SUPPORTED = ("txt", "pdf", "docx", "epub")
MIB = 1 << 20
# Limits of packed books and uploads.
EPUB_MEMBERS, EPUB_MEMBER_BYTES, EPUB_BYTES, EPUB_RATIO = 10_000, 8 * MIB, 200 * MIB, 500
UPLOAD_BYTES, DOCX_BYTES = 20 * MIB, 100 * MIB


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and format (by suffix) of files; A1."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "length", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))


def problems(f: DataFrame) -> DataFrame:
    """Path and problem of files that can't be taken; deeper checks of packed files are the readers'."""
    head = F.hex(F.substring("content", 1, 5))
    text = F.col("content").cast("string")
    problem = (
        F.when(~F.col("format").isin(*SUPPORTED), F.lit("unsupported format; one of " + ", ".join(SUPPORTED)))
        .when(F.col("length") > UPLOAD_BYTES, "too large")
        .when((F.col("format") == "pdf") & (head != "255044462D"), "not a PDF")
        .when((F.col("format") == "txt") & ~F.expr("is_valid_utf8(cast(content AS string))"), "not UTF-8")
        .when((F.col("format") == "txt") & text.contains("\x00"), "holds NUL")
        .when((F.col("format") == "txt") & (strip(text) == ""), "empty")
        .when(F.col("format").isin("docx", "epub") & ~head.startswith("504B0304"), "not a packed file")
    )
    return f.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def read_text(f: DataFrame, keep_layout: bool = True) -> DataFrame:
    """A2, A3: path, text, problem of text files, decoded strictly; keep_layout normalises, else only the ends are stripped."""
    t = f.where("format = 'txt'")
    ok = F.expr("is_valid_utf8(cast(content AS string))")
    raw = F.when(ok, F.col("content").cast("string"))
    text = normalize_text(raw) if keep_layout else strip(raw)
    return t.select("path", text.alias("text")).withColumn("problem", F.when(F.col("text").isNull(), "not UTF-8").when(F.col("text") == "", "empty"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def _xml(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data[:4096].upper() or b"<!ENTITY" in data.upper():
        raise ValueError("document types and entities aren't read")
    return ET.fromstring(data)


def docx_blocks(content: bytes) -> tuple[str | None, list[dict]]:
    """(title, blocks) of a DOCX file; tables and pictures are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > DOCX_BYTES:
            raise ValueError("expands beyond the limit")
        body = _xml(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in _xml(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        title = None
        if "docProps/core.xml" in z.namelist():
            found = _xml(z.read("docProps/core.xml")).find(f"{_DC}title")
            title = (found.text or "").strip() or None if found is not None else None
    blocks = []
    for n, p in enumerate(body.findall(f"{_W}p"), 1):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
        parts, marks = [], set()
        for run in p.iter(f"{_W}r"):
            text = "".join("\n" if x.tag == f"{_W}br" else x.text or "" for x in run if x.tag in (f"{_W}t", f"{_W}br"))
            parts.append(text)
            if text.strip():
                marks |= {name for tag, name in (("b", "bold"), ("i", "italic")) if run.find(f"{_W}rPr/{_W}{tag}") is not None}
        text = "".join(parts).strip()
        if not text:
            continue
        if style.lower() == "title" and title is None:
            title = text
        level = re.fullmatch(r"(?:heading|t[ií]tulo)\s*([1-9])", style, re.I)
        blocks.append({"pos": len(blocks), "text": text, "heading_level": int(level[1]) if level else None, "emphasis": sorted(marks), "scene_break": bool(re.fullmatch(r"\*\s*\*\s*\*|---|§", text)), "source_reference": f"docx:paragraph-{n}"})
    return title, blocks


def member_name(value: str) -> str:
    """A10: a safe name inside an archive; raises otherwise."""
    name = unquote(value)
    if not name or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", name) or "\\" in name or "\x00" in name or name.startswith("/") or ":" in name or ".." in name.split("/"):
        raise ValueError(f"unsafe name in the archive: {value!r}")
    return "/".join(x for x in name.split("/") if x not in ("", "."))


def open_epub(content: bytes) -> zipfile.ZipFile:
    """The archive of an EPUB file within all limits; raises otherwise."""
    z = zipfile.ZipFile(io.BytesIO(content))
    members = z.infolist()
    names = [member_name(i.orig_filename.rstrip("/") or "/") if not i.is_dir() else i.filename for i in members]
    if len(members) > EPUB_MEMBERS or sum(i.file_size for i in members) > EPUB_BYTES or any(i.file_size > EPUB_MEMBER_BYTES for i in members):
        raise ValueError("the archive is too large")
    if len(set(names)) != len(names):
        raise ValueError("names repeat in the archive")
    for i in members:
        if i.flag_bits & 1 or (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError("encrypted members and links aren't read")
        if i.file_size > EPUB_RATIO * max(1, i.compress_size):
            raise ValueError("a member expands too much")
    if not {"mimetype", "META-INF/container.xml"} <= set(names) or "META-INF/encryption.xml" in names:
        raise ValueError("no readable EPUB structure")
    if z.read("mimetype").strip() != b"application/epub+zip":
        raise ValueError("the archive doesn't say that it is an EPUB")
    return z


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def epub_sections(content: bytes) -> tuple[dict, list[dict]]:
    """(metadata, sections in reading order) of an EPUB file."""
    with open_epub(content) as z:
        root = next(e.get("full-path") for e in _xml(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
        package = _xml(z.read(member_name(root)))
        base = root.rsplit("/", 1)[0] + "/" if "/" in root else ""
        meta = {}
        for e in package.iter():
            if e.tag.startswith(_DC) and (e.text or "").strip():
                meta.setdefault(_local(e), e.text.strip())
        items = {e.get("id"): e for e in package.iter() if _local(e) == "item"}
        spine = [(items[e.get("idref")], e.get("linear", "yes")) for e in package.iter() if _local(e) == "itemref" and e.get("idref") in items] or [(e, "yes") for e in items.values()]
        navs = [e for e in items.values() if "nav" in (e.get("properties") or "").split()]
        titles: dict[str, str] = {}
        for nav in navs:
            page = z.read(member_name(base + nav.get("href"))).decode("utf-8", "replace")
            for href, label in re.findall(r"<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", page, re.S | re.I):
                titles.setdefault(member_name(href.split("#", 1)[0]) if href.split("#", 1)[0] else "", re.sub(r"<[^>]+>", "", label).strip())
        sections = []
        for e, linear in spine:
            if "html" not in (e.get("media-type") or ""):
                continue
            href = member_name(e.get("href"))
            blocks, removed = html_blocks(z.read(member_name(base + href)).decode("utf-8", "replace"))
            is_nav = any(e is n for n in navs)
            if not blocks and not is_nav:
                continue
            levels = [i for i, b in enumerate(blocks) if b["heading_level"] in (1, 2)]
            if len(levels) > 1:
                top = min(blocks[i]["heading_level"] for i in levels)
                levels = [i for i in levels if blocks[i]["heading_level"] == top]
            if not levels:
                levels = [i for i, b in enumerate(blocks) if is_structural(b["text"]) and not b["scene_break"]]
            starts = sorted({0, *levels}) if len(levels) > 1 else [0]
            own = titles.get(href) or next((b["text"] for b in blocks if b["heading_level"]), None) or f"Section {len(sections) + 1}"
            for part, start in enumerate(starts):
                piece = blocks[start : starts[part + 1] if part + 1 < len(starts) else len(blocks)]
                title = piece[0]["text"] if len(starts) > 1 and start in levels else own
                sections.append({
                    "number": len(sections) + 1, "title": title, "text": "\n\n".join(b["text"] for b in piece) or ("Table of Contents" if is_nav else ""), "reference": f"{href}#section-{part + 1}",
                    "selected_for_processing": not is_nav and linear != "no", "narrate": not is_nav, "removed": removed, "blocks": json.dumps(piece, ensure_ascii=False),
                })
        if not sections:
            raise ValueError("no section with text")
        return meta, sections


_PARTS = "path string, title string, author string, language string, number int, section_title string, text string, reference string, selected_for_processing boolean, narrate boolean, problem string"


def read_packed(f: DataFrame) -> DataFrame:
    """Sections of EPUB and DOCX files; a file that can't be read is one row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PARTS.split(", ")]
        for pdf in batches:
            out = []
            for path, content, kind in zip(pdf["path"], pdf["content"], pdf["format"]):
                try:
                    if kind == "epub":
                        meta, sections = epub_sections(bytes(content))
                        out += [(path, meta.get("title"), meta.get("creator"), meta.get("language"), s["number"], s["title"], s["text"], s["reference"], s["selected_for_processing"], s["narrate"], None) for s in sections]
                    else:
                        title, blocks = docx_blocks(bytes(content))
                        out += [(path, title, None, None, b["pos"] + 1, None, b["text"], b["source_reference"], True, True, None) for b in blocks]
                except Exception as e:  # a broken file is data, not a failure of the job
                    out.append((path, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=names).astype({"number": "Int32", "selected_for_processing": "boolean", "narrate": "boolean"})

    return f.where("format IN ('epub', 'docx')").select("path", "content", "format").mapInPandas(run, _PARTS)


def read_voice_models(spark: SparkSession, path: str) -> DataFrame:
    """Voices of model descriptions; a model with several speakers gives one row each, '<model>::<speaker>'."""
    j = spark.read.option("multiLine", True).schema("language struct<code:string>, speaker_id_map map<string,int>").json(path)
    j = j.withColumn("model", F.regexp_replace(F.input_file_name(), r"^.*/|\.onnx\.json$", ""))
    many = F.size(F.coalesce("speaker_id_map", F.expr("map()"))) > 1
    ids = F.when(many, F.transform(F.map_entries("speaker_id_map"), lambda e: F.concat("model", F.lit("::"), e.key))).otherwise(F.array("model"))
    return j.select(F.explode(ids).alias("voice_id"), F.col("language.code").alias("language"))


def with_defaults(df: DataFrame, newest: int = 2) -> DataFrame:
    """Rows of older versions with the fields they lack; a newer version raises."""
    version = F.coalesce("schema_version", F.lit(1))
    checked = F.when(version > newest, F.raise_error(F.lit("written by a newer version")).cast("int")).otherwise(version)
    conf = F.when(~F.isnan("confidence"), F.col("confidence"))
    return df.withColumn("schema_version", checked).withColumn("review_needed", F.coalesce("review_needed", (F.col("speaker") == "Unknown") | F.coalesce(conf < 0.85, F.lit(False))))


def read_pdf(f: DataFrame) -> DataFrame:
    """A4: path, page, text, problem of PDF pages, where the library for it is installed; else each file is a row with that problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if PdfReader is None:
                        raise ValueError("no library for PDF is installed")
                    reader = PdfReader(io.BytesIO(bytes(content)))
                    if reader.is_encrypted and not reader.decrypt(""):
                        raise ValueError("the file is encrypted")
                    texts = [p.extract_text() or "" for p in reader.pages]
                    if not any(t.strip() for t in texts):
                        raise ValueError("the pages hold no text; they need OCR")
                    out += [(path, n, t, None) for n, t in enumerate(texts, 1)]
                except Exception as e:
                    out.append((path, None, None, str(e)[:300]))
            yield pd.DataFrame(out, columns=["path", "page", "text", "problem"]).astype({"page": "Int32"})

    return f.where("format = 'pdf'").select("path", "content").mapInPandas(run, "path string, page int, text string, problem string")


def read_profiles(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Voice profiles of a JSON file, checked (D14); more than ``most`` raise."""
    rows = spark.read.option("multiLine", True).schema(PROFILES).json(path)
    n = rows.select(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"), "*")
    checked = F.when(F.col("n") > most, F.raise_error(F.lit("too many profiles")).cast("string")).otherwise(F.col("id"))
    speed, volume = F.coalesce("settings.speed", F.lit(1.0)), F.coalesce("settings.volume", F.lit(1.0))
    ok = speed.between(0.5, 2.0) & volume.between(0.0, 2.0)
    return n.where(ok).select(checked.alias("voice_id"), "base_voice_id", "name", "language", F.lit(None).cast("string").alias("gender"), "provider", "strategy", speed.alias("speed"), volume.alias("volume"))


class BookSource(DataSource):
    """A11 as a source: spark.read.format("epub").load(folder) after spark.dataSource.register(BookSource). One partition per file."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return _PARTS

    def reader(self, schema):
        return _BookReader(self.options["path"])


class _BookReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        paths = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".epub"))
        return [InputPartition(p) for p in paths] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        try:
            with open(partition.value, "rb") as f:
                meta, sections = epub_sections(f.read())
            for s in sections:
                yield (partition.value, meta.get("title"), meta.get("creator"), meta.get("language"), s["number"], s["title"], s["text"], s["reference"], s["selected_for_processing"], s["narrate"], None)
        except Exception as e:
            yield (partition.value, *[None] * 9, f"{type(e).__name__}: {e}"[:300])
