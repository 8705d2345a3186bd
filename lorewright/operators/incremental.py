"""Change detection and incremental recomputation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators.tables import UNKNOWN
from lorewright.session import cut

# The states of a chapter.
STATES = ["not_analyzed", "analyzing", "analyzed", "review_required", "ready_for_audio", "generating_audio", "completed", "failed"]


def fingerprints(segments: DataFrame, voices: DataFrame | None = None) -> DataFrame:
    """F16: SHA-256 per chapter over its utterances in order. Each row is hashed first, so what a chapter gathers is 64 characters a row."""
    rows = segments
    voice = F.lit("")
    if voices is not None:
        rows = rows.join(voices.select("book_id", F.col("canonical_name").alias("speaker"), F.col("voice_id").alias("_v")), ["book_id", "speaker"], "left")
        voice = F.coalesce("_v", F.lit(""))
    one = F.sha2(F.concat_ws("\x1f", F.coalesce("text", F.lit("")), F.coalesce("speaker", F.lit("")), voice, F.coalesce("scene_break_before", F.lit(False)).cast("string")), 256)
    per = rows.groupBy("book_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("seg_order", "row_id", one.alias("h")))).alias("x"))
    return per.select("book_id", "chapter", F.sha2(F.array_join(F.transform("x", lambda e: e.h), ""), 256).alias("fingerprint"))


def changed_chapters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chapters whose fingerprint differs, or that are new or gone."""
    a, b = old.withColumnRenamed("fingerprint", "before"), new.withColumnRenamed("fingerprint", "after")
    both = a.join(b, ["book_id", "chapter"], "full_outer").where("NOT (before <=> after)")
    return both.select("book_id", "chapter", F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("changed").alias("change"))


def chapter_status(segments: DataFrame) -> DataFrame:
    """a chapter needs review while any row does or has no speaker."""
    open_ = F.coalesce("review_needed", F.lit(False)) | F.coalesce(F.col("speaker") == UNKNOWN, F.lit(False))
    return segments.groupBy("book_id", "chapter").agg(F.when(F.bool_or(open_), "review_required").otherwise("ready_for_audio").alias("status"))


def continuity_warnings(chapters: DataFrame, changed: DataFrame) -> DataFrame:
    """Analysed chapters after a book's first changed one, with its number; the changed ones themselves excepted."""
    first = changed.groupBy("book_id").agg(F.min("chapter").alias("first_changed"))
    later = chapters.join(first, "book_id").where("chapter > first_changed AND status != 'not_analyzed'")
    return later.join(changed.select("book_id", "chapter"), ["book_id", "chapter"], "left_anti").select("book_id", "chapter", "first_changed")


def pending_chapters(chapters: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("book_id", "chapter")) -> DataFrame:
    """Selected chapters that aren't among those done (with the same fingerprint, if keys name it)."""
    return chapters.where("selected_for_processing AND narrate").join(done.select(*keys).distinct(), list(keys), "left_anti")


def recover_interrupted(chapters: DataFrame) -> DataFrame:
    """K5: busy chapters have failed when the engine starts."""
    busy = F.col("status").isin("analyzing", "generating_audio")
    return chapters.withColumn("recovered", F.when(busy, "failed").otherwise(F.col("status"))).withColumn("warning", F.when(busy, "interrupted").otherwise(F.col("consistency_warning")))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows and the old ones that none replaces."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def sum_diagnostics(runs: DataFrame) -> DataFrame:
    """counters (key, value) of several runs added up."""
    return runs.groupBy("key").agg(F.sum("value").alias("value"))


def last_states(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The state of each key after its last event; max_by aggregates before it shuffles."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("events"))


def changes_in_order(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Transitions between unlike states."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("previous", F.lag("event_type").over(w)).where("previous IS NULL OR previous != event_type")
    return rows.groupBy("previous", "event_type").agg(F.count(F.lit(1)).alias("n"))


def digests(df: DataFrame, *partitions: str) -> DataFrame:
    """Partitions, rows and a digest of all rows whatever their order: sums of two hashes, added up before the shuffle."""
    columns = sorted(c for c in df.columns if c not in partitions)
    h = [F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
    return df.groupBy(*partitions).agg(F.count(F.lit(1)).alias("rows"), F.sum(h[0]).alias("a"), F.sum(h[1]).alias("b"))


def changed_partitions(old: DataFrame, new: DataFrame, *partitions: str) -> DataFrame:
    """The partitions of new whose content isn't that of old."""
    a = digests(old, *partitions)
    same = digests(new, *partitions).join(a, [*partitions, "rows", "a", "b"], "left_semi")
    return new.select(*partitions).distinct().join(same, list(partitions), "left_anti")


def save_changed(df: DataFrame, path: str, *partitions: str) -> int:
    """Writes only the partitions that differ from what stands in the folder; the number of those written."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing saved yet
        old = None
    todo = df.select(*partitions).distinct() if old is None else changed_partitions(old.select(*df.columns), df, *partitions)
    todo = cut(todo)
    n = todo.count()
    if n:
        cut(df.join(todo, list(partitions), "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    return n


def document_index(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """One JSON index per book, bodies left out."""
    item = F.struct("chapter", "chapter_id", "title", "word_count", "status", "selected_for_processing", "narrate", "section_kind")
    per = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("chapters"))
    head = books.select("book_id", "title", "author", "language", "publisher", "identifier", "format")
    return head.join(per, "book_id", "left").select("book_id", F.to_json(F.struct(F.lit(3).alias("schema_version"), *head.columns, "chapters"), {"ignoreNullFields": "false"}).alias("manifest"))
