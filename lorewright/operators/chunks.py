"""Speech chunks, pauses and audio plans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import squeeze, strip
from lorewright.session import exploded

_STOP = re.compile(r"(?<=[.!?…])\s+")
_GAP = re.compile(r"\n\s*\n")


def pack(text: str, most: int) -> list[str]:
    """Sentences packed up to ``most`` characters; longer ones by words, longer words by characters."""
    if most < 1:
        raise ValueError("most must be positive")
    out: list[str] = []
    for paragraph in [p.strip() for p in _GAP.split(text) if p.strip()]:
        held = ""
        for sentence in filter(None, map(str.strip, _STOP.split(paragraph))):
            if len(held) + len(sentence) + bool(held) <= most:
                held = f"{held} {sentence}" if held else sentence
                continue
            if held:
                out.append(held)
            held = ""
            # What doesn't fit is laid out word by word; the last piece stays open.
            for word in sentence.split():
                if len(word) > most:
                    out.extend(filter(None, [held]))
                    held = ""
                    out.extend(word[i : i + most] for i in range(0, len(word), most))
                elif held and len(held) + 1 + len(word) > most:
                    out.append(held)
                    held = word
                else:
                    held = f"{held} {word}" if held else word
            if not held and out:
                held = out.pop()
        if held:
            out.append(held)
    return out


def chunks_column(c: Column, most: int = 400) -> Column:
    """C9 as an array column; a text of one sentence group within the limit stays in the JVM."""
    s = squeeze(c)
    short = (F.length(strip(c)) <= most) & ~c.contains("\n") & (s == strip(c))

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pack(t, most) for t in texts], dtype=object)

    return F.when(short, F.filter(F.array(s), lambda x: x != "")).otherwise(packed(F.when(~short, c)))


def chunk_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """chunks per chapter and, with chapter null, per book: two levels in one shuffle by rollup."""
    n = F.coalesce(F.size(chunks_column(F.col(text))), F.lit(0))
    per = df.select("book_id", "chapter", F.when(n > 0, n).otherwise(0).alias("n")).groupBy("book_id", "chapter").agg(F.sum("n").alias("n"))
    return per.rollup("book_id", "chapter").agg(F.sum("n").cast("bigint").alias("chunks"), F.grouping_id().alias("g")).where("g < 3").drop("g")


def pause_plan(segments: DataFrame, scene_ms: int = 1000, paragraph_ms: int = 320, speaker_ms: int = 260, segment_ms: int = 180) -> DataFrame:
    """Chunks of a chapter in order with the silence before each."""
    # The speaker before is that of the segment before, whether it has text or not.
    w = Window.partitionBy("book_id", "chapter").orderBy("seg_order", "row_id")
    rows = segments.withColumn("_before", F.lag("speaker").over(w)).withColumn("_n", F.row_number().over(w))
    rows = exploded(rows, ["book_id", "chapter", "row_id", "_n", "speaker", "_before", F.coalesce("scene_break_before", F.lit(False)).alias("_scene"), F.coalesce(F.col("text").contains("\n\n"), F.lit(False)).alias("_gap")], chunks_column(F.col("text")), "chunk_no", "chunk")
    place = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy("_n", "chunk_no"))
    pause = (
        F.when(F.col("place") == 1, 0)
        .when(F.col("_scene") & (F.col("chunk_no") == 0), scene_ms)
        .when(F.col("chunk_no") > 0, F.when(F.col("_gap"), paragraph_ms).otherwise(segment_ms))
        .when(~F.col("_before").eqNullSafe(F.col("speaker")) & (F.col("_n") > 1), speaker_ms)
        .otherwise(segment_ms)
    )
    return rows.withColumn("place", place).withColumn("pause_ms", pause).select("book_id", "chapter", "place", "row_id", "chunk_no", "chunk", "speaker", "pause_ms")


def silence_frames(pause: Column, rate: int) -> Column:
    """Whole frames of a silence."""
    return F.floor(pause.cast("bigint") * rate / 1000).cast("bigint")


def chapter_gaps(done: DataFrame, pause_ms: int = 700) -> DataFrame:
    """Finished chapters in order with the silence between, none before the first."""
    w = Window.partitionBy("book_id").orderBy("chapter")
    return done.select("book_id", "chapter", F.row_number().over(w).alias("track")).withColumn("pause_ms", F.when(F.col("track") > 1, pause_ms).otherwise(0))


def cache_key(text: Column, voice: Column, provider: str = "local", model: str = "default", speed: float = 1.0, volume: float = 1.0) -> Column:
    """Key of an audible result: everything that changes it, nothing else."""
    return F.sha2(F.concat_ws("\x1f", F.lit("1"), F.coalesce(text, F.lit("")), F.coalesce(voice, F.lit("")), F.lit(provider), F.lit(model), F.lit(f"{speed:g}"), F.lit(f"{volume:g}")), 256)


def split_hits(wanted: DataFrame, cached: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of distinct keys by semi and anti join."""
    w = wanted.dropDuplicates([key])
    return w.join(cached.select(key), key, "left_semi"), w.join(cached.select(key), key, "left_anti")
