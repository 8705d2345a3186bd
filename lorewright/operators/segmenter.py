"""Splitting text into typed utterances."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lorewright.functions.text import DASH, LINE_ENDS, SCENE_BREAK, split_lines, strip
from lorewright.session import exploded, spread

#: Opening mark, closing mark, type of what they hold. Double marks enclose speech, single marks thought.
QUOTES = [("“", "”", "dialogue"), ("«", "»", "dialogue"), ('"', '"', "dialogue"), ("‘", "’", "internal_thought"), ("'", "'", "internal_thought")]
UTTERANCE = ArrayType(StructType([StructField("type", StringType()), StructField("text", StringType()), StructField("scene_break_before", BooleanType())]))
_ENDS, _SCENE = re.compile(LINE_ENDS), re.compile(SCENE_BREAK)


def _quoted(line: str):
    """(start, end, type, inner text) of each quotation of a line, left to right, none inside another."""
    at = 0
    while at < len(line):
        opener = next((q for q in QUOTES if line[at] == q[0]), None)
        end = line.find(opener[1], at + 1) if opener else -1
        ok = end > at + 1
        if ok and opener[0] == "'":
            # An apostrophe inside a word neither opens nor closes.
            while end > 0 and end + 1 < len(line) and (line[end + 1].isalnum() or line[end + 1] == "_"):
                end = -1
            ok = end > at + 1 and not (at and (line[at - 1].isalnum() or line[at - 1] == "_"))
        if ok:
            yield at, end + 1, opener[2], line[at + 1 : end]
            at = end + 1
        else:
            at += 1


def utterances(text: str) -> list[tuple[str, str, bool]]:
    """(type, text, scene break before) of a chapter's text."""
    out, scene = [], False

    def emit(kind: str, piece: str) -> None:
        nonlocal scene
        out.append((kind, piece, scene))
        scene = False

    for line in map(str.strip, _ENDS.split(text)):
        if not line:
            continue
        if _SCENE.match(line):
            scene = True
        elif line[0] == DASH:
            # Odd and even pieces alternate; an empty one is skipped but still counts.
            for n, piece in enumerate(line.split(DASH)[1:]):
                if piece.strip():
                    emit("narration" if n % 2 else "dialogue", piece.strip())
        else:
            at = 0
            for start, end, kind, inner in _quoted(line):
                if line[at:start].strip():
                    emit("narration", line[at:start].strip())
                emit(kind, inner.strip())
                at = end
            if line[at:].strip():
                emit("narration", line[at:].strip())
            scene = False
    return out


@F.pandas_udf(UTTERANCE)
def _segmented(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"type": k, "text": x, "scene_break_before": s} for k, x, s in utterances(t)] for t in texts], dtype=object)


def segment_text(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per utterance: keys, pos from 0, type, text, speaker, scene_break_before. Null and blank texts have none."""
    rows = exploded(spread(df.select(*dict.fromkeys([*keys, text]))), keys, _segmented(F.col(text)), "pos", "u")
    speaker = F.when(F.col("u.type") == "narration", "Narrator").otherwise("Unknown").alias("speaker")
    return rows.select(*keys, "pos", "u.type", "u.text", speaker, "u.scene_break_before")


def dash_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """C7, dash branch, and C17: pieces of the lines that open with a dash, without leaving the JVM."""
    lines = exploded(df, keys, F.transform(split_lines(F.col(text)), strip), "line_no", "line").where(F.col("line").startswith(DASH))
    pieces = exploded(lines, [*keys, "line_no"], F.expr(f"slice(split(line, '{DASH}'), 2, size(split(line, '{DASH}')))"), "frag_no", "frag")
    kind = F.when(F.col("frag_no") % 2 == 0, "dialogue").otherwise("narration")
    return pieces.select(*keys, "line_no", "frag_no", kind.alias("type"), strip(F.col("frag")).alias("text")).where("text != ''")


def segment_ids(df: DataFrame, mode: str = "global") -> DataFrame:
    """C11: ids and orders, over the whole book ('global') or within each chapter ('chapter')."""
    n = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy("seg_order", "row_id"))
    if mode == "chapter":
        return df.select("row_id", F.format_string("b%d_c%d_seg_%06d", "book_id", "chapter", n).alias("new_id"), (F.col("chapter").cast("bigint") * F.lit(1_000_000_000) + n - 1).cast("bigint").alias("new_order"))
    # The book's count is the chapter's own plus those of the chapters before, so that no task sorts a whole book.
    sizes = df.groupBy("book_id", "chapter").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("book_id").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("_n", n).join(sizes.withColumn("_before", before), ["book_id", "chapter"])
    place = (F.col("_before") + F.col("_n")).cast("bigint")
    return rows.select("row_id", F.format_string("seg_%06d", place).alias("new_id"), place.alias("new_order"))


def context_strings(df: DataFrame, size: int = 4, most: int = 2000) -> DataFrame:
    """Texts of up to four neighbours on either side of speech, within the chapter."""
    w = Window.partitionBy("book_id", "chapter").orderBy("seg_order", "row_id")
    text = F.coalesce("text", F.lit(""))
    before = F.array_join(F.collect_list(text).over(w.rowsBetween(-size, -1)), "\n")
    after = F.array_join(F.collect_list(text).over(w.rowsBetween(1, size)), "\n")
    rows = df.select("row_id", "type", F.right(before, F.lit(most)).alias("before"), F.left(after, F.lit(most)).alias("after"))
    return rows.where(F.col("type").isin("dialogue", "internal_thought")).drop("type")


def emphasis_projection(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments with the union of the emphasis of blocks of equal text in their chapter."""
    marks = blocks.groupBy("book_id", "chapter", "text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("emphasis")))).alias("marks"))
    return segments.join(marks, ["book_id", "chapter", "text"], "left").select("row_id", F.coalesce(F.array_join("marks", ","), F.lit("")).alias("emphasis"))


def page_diagnostics(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per text, its lines, dash lines and quotation marks."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(split_lines(t), strip), lambda x: x != "")
    count: list[Column] = [(F.length(t) - F.length(F.translate(t, marks, ""))).cast("bigint").alias(name) for name, marks in (("double_marks", '"“'), ("single_marks", "'‘"))]
    return df.select(*keys, F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: x.startswith(DASH))).cast("bigint").alias("dash_lines"), *count)
