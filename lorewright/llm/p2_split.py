"""Problem 2: cutting oversized texts into overlapping pieces at natural boundaries.

Method: every position of a text gets a boundary strength; a sparse table answers
"strongest boundary in this window, rightmost on ties" in constant time; the
cutter asks it for the window of permissible piece lengths, cuts there, and
steps back by the overlap.

Defined results: null and empty texts give no piece; a text within the limit
is one piece; pieces are numbered from 0; consecutive pieces share exactly ``overlap``
code points, so dropping the first ``overlap`` of every later piece gives the text back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.session import exploded, spread, table

CHAPTER_LIMIT, CHAPTER_OVERLAP = 4000, 200
SEGMENT_LIMIT, SEGMENT_OVERLAP = 400, 40

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE, INSIDE = 6, 5, 4, 3, 2, 1, 0

#: (strength, pattern whose end is the boundary), weakest first so that stronger ones overwrite.
_CLOSERS = r"[\"'”’»›」』）\)\]\}】]*"
_BOUNDARIES = [
    (WORD, regex.compile(r"\s+")),
    (CLAUSE, regex.compile(r"[,;:،؛、，；：]" + _CLOSERS + r"\s*")),
    (SENTENCE, regex.compile(r"(?:[.!?…؟।]+" + _CLOSERS + r"(?=\s)\s+|[。！？｡]+" + _CLOSERS + r"\s*)")),
    (LINE, regex.compile(r"[ \t]*(?:\r\n|[\n\r \u0085])")),
    (PARAGRAPH, regex.compile(r"(?:[ \t]*(?:\r\n|[\n\r ])){2,}| ")),
]
_INSIDE = regex.compile(r"(?<=.)(?=[\p{M}‍︀-️\U0001f3fb-\U0001f3ff])|(?<=‍)|(?<=\r)(?=\n)", regex.S)

#: Positions indexed at a time, so that the index of a huge text stays within a few MB.
_BLOCK = 1 << 16


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before position p, for p = 0..len(text)."""
    out = np.full(len(text) + 1, NONE, dtype=np.int64)
    for strength, pattern in _BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text)]
        if ends:
            out[ends] = strength
    inside = [m.start() for m in _INSIDE.finditer(text)]
    if inside:
        out[inside] = INSIDE
    return out


class RangeMax:
    """Sparse table over strengths[base:base+n]; ties go to the right."""

    def __init__(self, values: np.ndarray, base: int, widest: int):
        self.base = base
        keys = (values << 40) | np.arange(base, base + len(values), dtype=np.int64)
        self.levels = [keys]
        span = 1
        while 2 * span <= min(widest, len(keys)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-span], last[span:]))
            span *= 2

    def strongest(self, lo: int, hi: int) -> int:
        """Position in [lo, hi]."""
        lo, hi = lo - self.base, hi - self.base
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k) + 1])) & ((1 << 40) - 1)


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be smaller than half the limit")
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    values = strengths(text)
    out, start, index = [], 0, None
    shortest = max(limit // 2, overlap + 1)
    while n - start > limit:
        lo, hi = start + shortest, start + limit
        if index is None or hi >= index.base + len(index.levels[0]):
            index = RangeMax(values[lo : lo + _BLOCK + limit], lo, limit + 1)
        end = index.strongest(lo, hi)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


_PIECES = "array<struct<n_pieces:int,piece_start:int,piece_end:int,piece:string>>"


def split_column(text, limit: int, overlap: int):
    """Pieces of a text column as an array; texts within the limit never leave the JVM."""

    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        cuts = [[] if t is None else cut_points(t, limit, overlap) for t in texts]
        return pd.Series([[{"n_pieces": len(c), "piece_start": a, "piece_end": b, "piece": t[a:b]} for a, b in c] for t, c in zip(texts, cuts)], dtype=object)

    whole = F.array(F.struct(F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), F.char_length(text).alias("piece_end"), text.alias("piece")))
    length = F.char_length(text)
    return F.when(length > limit, cut(F.when(length > limit, text))).when(length > 0, whole)


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """One row per piece: the id, piece_no, n_pieces, piece_start, piece_end (code points) and piece."""
    pieces = spread(df.select(id_col, text_col)).select(F.col(id_col).alias(id_col), split_column(F.col(text_col), limit, overlap).alias("_p"))
    return exploded(pieces, [id_col], F.col("_p"), "piece_no", "_x").select(id_col, "piece_no", "_x.n_pieces", "_x.piece_start", "_x.piece_end", "_x.piece")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        split_texts(table(spark, sf_dir, name, "row_id", "text"), "row_id", "text", limit, overlap).select(F.lit(name).alias("item_table"), "*")
        for name, limit, overlap in (("chapters", CHAPTER_LIMIT, CHAPTER_OVERLAP), ("segments", SEGMENT_LIMIT, SEGMENT_OVERLAP))
    ]
    return parts[0].unionByName(parts[1])


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chapter and segment."""
    return _both(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that had to be cut."""
    return _both(spark, sf_dir).where((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select("item_table", "row_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {
    "p2_found": "SELECT 'chapters' AS item_table, row_id FROM chapters WHERE length(text) > 4000 UNION ALL SELECT 'segments' AS item_table, row_id FROM segments WHERE length(text) > 400",
}
