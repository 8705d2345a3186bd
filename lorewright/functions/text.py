"""Column functions over text: normalisation, headings, names, slugs (C1, C5, C13, C14, J)."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Line ends that split a text into lines, as one Java pattern.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
SCENE_BREAK = r"^(?:\*\s*\*\s*\*|---|§)$"
DASH = "—"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    # A single blank is left as it is, so that most texts aren't built anew.
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_ENDS, -1)


def word_count(c: Column) -> Column:
    """Number of tokens between white space; 0 for blank text."""
    s = squeeze(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition. Only text with characters from U+0300 on can need it, so no other row's text is sent to Python."""
    doubtful = c.rlike("[^\\x00-\\u02ff]")
    return F.when(doubtful, _nfc(F.when(doubtful, c))).otherwise(c)


def normalize_text(c: Column) -> Column:
    """The ordered clean-up shared by all document readers."""
    c = nfc(c)
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.translate(c, " ―﻿​⁠­", " —")
    c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n[ \t]+", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(c)


# Number words, chapter words and special headings.
NUMBER_WORDS = "seventeen|thirteen|fourteen|eighteen|nineteen|fifteen|sixteen|eleven|twelve|twenty|three|seven|eight|four|five|nine|one|two|six|ten"
CHAPTER_HEADING = rf"^(?:cap[ií]tulo|chapter|episodio|episode|parte|part|volumen|volume)\s+(?:\d+|[ivxlcdm]+|{NUMBER_WORDS})(?:\s*[:.\-–—]\s*|\s+)?(?:.+)?$"
NUMBERED_HEADING = r"^\d+\s*(?:\.|[-–—:])\s+\S.+$"
SPECIAL_HEADING = r"^(?:pr[oó]logo|ep[ií]logo)$"


def _is_contents(line: Column) -> Column:
    return line.rlike(r"\.{3,}\s*\d*\s*$")


def _unmarked(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^#{1,6}\s*", ""))


def _unbracketed(bare: Column) -> Column:
    return F.when(bare.rlike(r"^\[.*\]$"), strip(F.regexp_replace(bare, r"^\[|\]$", ""))).otherwise(bare)


def _reads_as_heading(bare: Column) -> Column:
    capitals = (F.length(bare) <= 80) & (bare == F.upper(bare)) & (F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) >= 2) & (word_count(bare) <= 10) & ~bare.rlike("^[—-]") & ~bare.rlike("[.!?;,]$")
    return capitals | bare.rlike("(?iu)" + CHAPTER_HEADING) | bare.rlike(NUMBERED_HEADING) | bare.rlike("(?iu)" + SPECIAL_HEADING)


def is_chapter_heading(c: Column) -> Column:
    """Chapter word and number, numbered title, prologue or epilogue, or a short line in capitals; never a contents entry."""
    line = squeeze(c)
    return ~_is_contents(line) & _reads_as_heading(_unbracketed(_unmarked(line)))


def with_headings(lines: Column) -> Column:
    """C5 over an array of lines: structs of the line x and whether it is a heading h. Step by step, since what a lambda uses twice it computes twice."""
    steps = F.transform(lines, lambda x: F.struct(x.alias("x"), squeeze(x).alias("q")))
    steps = F.transform(steps, lambda y: F.struct(y.x.alias("x"), _is_contents(y.q).alias("c"), _unmarked(y.q).alias("q")))
    steps = F.transform(steps, lambda y: F.struct(y.x.alias("x"), y.c.alias("c"), _unbracketed(y.q).alias("q")))
    return F.transform(steps, lambda y: F.struct(y.x.alias("x"), (~y.c & _reads_as_heading(y.q)).alias("h")))


@functools.lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    """All characters that combine with the one before."""
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")


#: Characters that fold one by one: ASCII, the letters of Western Europe but for sharp s, quotation marks and dashes.
_WESTERN = "[\\x00-\\x7fÀ-ÖØ-Þà-öø-ÿ¡¿«»–—‘-”]"
_ACCENTED = [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, range(0xE0, 0x100)) if unicodedata.normalize("NFKD", c) != c]


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else _marks().sub("", unicodedata.normalize("NFKD", n)).casefold())


def name_key(c: Column) -> Column:
    """Identity key of a name: blanks collapsed, accents and case levelled. Names of ASCII and Western letters stay in the JVM."""
    s = squeeze(c)
    plain = s.rlike(f"^{_WESTERN}*$")
    return F.when(plain, F.translate(F.lower(s), *map("".join, zip(*_ACCENTED)))).otherwise(_folded(F.when(~plain, s)))


def safe_filename(c: Column, fallback: str = "untitled") -> Column:
    """Portable lower-case ASCII slug of at most 80 characters."""
    ascii_only = F.regexp_replace(name_key(c), r"[^\x00-\x7f]", "")
    slug = F.regexp_replace(F.regexp_replace(ascii_only, "[^a-zA-Z0-9]+", "_"), r"^[_.]+|[_.]+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit(fallback)).otherwise(F.lower(F.left(slug, F.lit(80))))


def upload_name(c: Column, allowed: tuple[str, ...] = ("txt", "pdf", "docx", "epub")) -> Column:
    """C14: base name as a slug with its suffix in lower case; null where the suffix isn't allowed."""
    base = F.regexp_extract(F.translate(c, "\\", "/"), r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    return F.when(suffix.isin(*allowed), F.concat(safe_filename(F.regexp_replace(base, r"\.[^.]*$", ""), "document"), F.lit("."), suffix))


def safe_member(c: Column) -> Column:
    """A10: whether a packed file's name stays inside its archive."""
    d = F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    d = F.coalesce(d, c)
    return (d != "") & ~d.contains("\\") & ~d.contains("\x00") & ~d.contains(":") & ~d.startswith("/") & ~d.rlike(r"(^|/)\.\.(/|$)")


def spaced_heading(c: Column) -> Column:
    """A7: 'C a p í t u l o  1' gets its letters back together; gaps of two blanks stay gaps of words."""
    hit = c.rlike(r"(?iu)^\s*C\s+a\s+p\s+[ií]\s+t\s+u\s+l\s+o(?![\p{L}\p{N}_])")
    words = F.transform(F.split(strip(c), r"\s{2,}"), lambda w: F.regexp_replace(w, r"\s+", ""))
    return F.when(hit, F.array_join(words, " ")).otherwise(c)


# The first list that matches names the section, in this order.
SECTION_KINDS = [
    ("copyright", ["copyright", "derechos reservados"]),
    ("cover", ["cover", "portada"]),
    ("title_page", ["titlepage", "title-page"]),
    ("dedication", ["dedication", "dedicatoria"]),
    ("acknowledgements", ["acknowledg", "agradecimientos"]),
    ("appendix", ["appendix", "apéndice"]),
    ("table_of_contents", ["table of contents", "contents.xhtml", "índice"]),
]


def section_kind(c: Column) -> Column:
    """Kind of a section by key words, the first list that matches; null for the body."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for kind, words in reversed(SECTION_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def chapter_id(book_format: Column, number: Column, reference: Column) -> Column:
    """Stable id from format, number and source reference."""
    return F.concat(F.lit("ch_"), F.substring(F.sha2(F.concat_ws(":", book_format, number.cast("string"), reference), 256), 1, 16))
