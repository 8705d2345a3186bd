"""The whole path from chapter texts to an audio plan, as one lazy plan (K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_text
from lorewright.operators.chunks import pause_plan
from lorewright.operators.segmenter import segment_text
from lorewright.plans.fold import resolve_speakers
from lorewright.session import cut


def analyze(chapters: DataFrame, **kw) -> DataFrame:
    """Utterances of chapters (book_id, chapter, text) with their speakers."""
    rows = segment_text(chapters.withColumn("text", normalize_text(F.col("text"))), ["book_id", "chapter"])
    rows = rows.withColumn("seg_order", (F.col("chapter").cast("bigint") * F.lit(1_000_000_000) + F.col("pos")).cast("bigint"))
    # The fold's rows are told apart by book and order; a hash of them as an id would double rows at large numbers.
    rows = rows.withColumn("row_id", F.col("seg_order"))
    empty = {"confidence": "double", "resolution_method": "string", "review_needed": "boolean", "new_character_candidate": "string"}
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    rows = cut(rows)
    return rows.drop("speaker", *empty).join(resolve_speakers(rows, **kw), ["book_id", "row_id"])


def audio_plan(chapters: DataFrame, **kw) -> DataFrame:
    return pause_plan(analyze(chapters, **kw))
