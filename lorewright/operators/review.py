"""The review query and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import name_key
from lorewright.operators.tables import NARRATOR, UNKNOWN, is_speech

ACCEPT = 0.85


def confidence(c: str = "confidence") -> Column:
    """NaN as delivered is no confidence."""
    return F.when(~F.isnan(c), F.col(c))


def filter_issue(df: DataFrame, issue: str, duplicates: DataFrame | None = None) -> DataFrame:
    """Speech rows with an issue. duplicates: book_id, speaker of suspected doubles."""
    rows = df.where(is_speech(F.col("type")))
    if issue == "all":
        return rows
    if issue == "unresolved":
        return rows.where(F.col("speaker") == UNKNOWN)
    if issue == "low_confidence":
        return rows.where(confidence() < ACCEPT)
    if issue == "new_characters":
        return rows.where("new_character_candidate IS NOT NULL")
    if issue == "duplicates":
        return rows.join(duplicates, ["book_id", "speaker"], "left_semi")
    raise ValueError(f"no such issue: {issue}")


def filter_speaker(df: DataFrame, speaker: str) -> DataFrame:
    """D6: 'all', 'unknown' or one speaker by name key."""
    if speaker == "all":
        return df
    if speaker == "unknown":
        return df.where(F.col("speaker") == UNKNOWN)
    return df.where(name_key(F.col("speaker")) == name_key(F.lit(speaker)))


def review_order() -> list[Column]:
    """H1: what needs review first, then the least confident, then the text's order."""
    return [F.coalesce("review_needed", F.lit(False)).desc(), F.coalesce(confidence(), F.lit(-1.0)), F.col("seg_order"), F.col("row_id")]


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """H2: one page per book in review order; a number beyond the last page gives the last."""
    number = max(1, number)
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(*review_order()))
    # No wanted row lies beyond this place, so each task keeps that many rows of a book before the shuffle.
    rows = df.withColumn("place", place).where(F.col("place") <= number * size)
    pages = df.groupBy("book_id").agg(F.least(F.lit(number), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size))).alias("_p"))
    return rows.join(pages, "book_id").where(F.ceil(F.col("place") / size) == F.col("_p")).drop("_p")


def character_metrics(segments: DataFrame, characters: DataFrame) -> DataFrame:
    """conditional counts per book over segments and profiles."""
    speech, unresolved = is_speech(F.col("type")), F.col("speaker").isin(UNKNOWN, NARRATOR)
    spoken = F.col("type") == "dialogue"
    s = segments.groupBy("book_id").agg(
        F.count_if(F.col("type") == "narration").alias("narration"), F.count_if(spoken).alias("dialogue"), F.count_if(F.col("type") == "internal_thought").alias("thought"),
        F.count_if(spoken & ~unresolved).alias("resolved"), F.count_if(spoken & unresolved).alias("unresolved"),
        F.count_if(speech & F.col("resolution_method").isin("rule", "conversation", "candidate")).alias("by_rule"),
        F.count_if(speech & (F.col("resolution_method") == "llm") & (F.col("speaker") != UNKNOWN)).alias("by_model"), F.count_if(speech & (F.col("resolution_method") == "manual")).alias("by_hand"),
        F.count_if(speech & (F.col("speaker") == UNKNOWN)).alias("unknown"), F.count_if(speech & (confidence() < ACCEPT)).alias("low_confidence"),
    )
    c = characters.where(F.col("canonical_name") != NARRATOR).groupBy("book_id").agg(F.count(F.lit(1)).alias("profiles"), F.count_if(~F.coalesce("pending", F.lit(False))).alias("detected"), *[F.count_if(F.col("importance") == x).alias(x) for x in ("major", "supporting", "minor")])
    return s.join(c, "book_id", "left").fillna(0)


def analysis_warnings(metrics: DataFrame) -> DataFrame:
    """books with speech but no character, and books with failed remote calls where such a count is given."""
    failed = F.col("errors") > 0 if "errors" in metrics.columns else F.lit(False)
    flags = F.array_compact(F.array(F.when((F.col("dialogue") > 0) & (F.col("detected") == 0), "no characters"), F.when(failed, "remote errors")))
    return metrics.select("book_id", F.array_join(flags, ",").alias("warnings")).where("warnings != ''")


def progress(done: Column, total: Column) -> Column:
    """whole percent, half to even, at most 100."""
    return F.least(F.lit(100), F.bround(done * 100.0 / F.greatest(total, F.lit(1)), 0)).cast("bigint")


def book_status(chapters: DataFrame) -> DataFrame:
    """Analysed and finished chapters, whether any is busy or failed."""
    return chapters.groupBy("book_id").agg(
        F.count_if(F.col("status") != "not_analyzed").alias("analyzed"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.coalesce(F.bool_or(F.col("status").isin("analyzing", "generating_audio")), F.lit(False)).alias("busy"), F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("failed"),
    )


def result_files(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """Finished files of chapters, by the number before the first underscore: an equi-join instead of a prefix comparison."""
    n = F.regexp_extract("file", "^0*([0-9]+)_", 1)
    return files.withColumn("chapter", F.when(n != "", n.cast("int"))).join(chapters.select("book_id", "chapter").distinct(), ["book_id", "chapter"])
