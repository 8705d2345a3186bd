"""Edits of characters, speakers and chapters as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import name_key, squeeze
from lorewright.operators.tables import NARRATOR, UNKNOWN


def register_names(characters: DataFrame, wanted: DataFrame) -> DataFrame:
    """M1: names (book_id, name, chapter) that no profile visible at their chapter has, as new profiles with the next ids.

    Blank names and Unknown register nothing; a name is registered once, at its first chapter.
    """
    names = wanted.select("book_id", squeeze(F.col("name")).alias("name"), "chapter").withColumn("key", name_key(F.col("name"))).where(f"key NOT IN ('', '{UNKNOWN.lower()}')")
    first = names.groupBy("book_id", "key").agg(F.min_by("name", F.struct("chapter", "name")).alias("name"), F.min("chapter").alias("chapter"))
    new = first.join(characters.select("book_id", name_key(F.col("canonical_name")).alias("key")).distinct(), ["book_id", "key"], "left_anti")
    last = characters.groupBy("book_id").agg(F.max(F.regexp_extract("char_id", r"(\d+)$", 1).cast("int")).alias("last"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter", "key"))
    return new.join(last, "book_id", "left").select("book_id", F.format_string("char_%06d", F.coalesce("last", F.lit(0)) + n).alias("char_id"), F.col("name").alias("canonical_name"), F.col("chapter").alias("first_seen_chapter"))


def add_aliases(aliases: DataFrame, characters: DataFrame, wanted: DataFrame) -> DataFrame:
    """M2: wanted (book_id, char_id, name, known_from_chapter) less blank names, chapters below one and names of another character."""
    ok = wanted.withColumn("key", name_key(F.col("name"))).where("key != '' AND known_from_chapter >= 1")
    owned = characters.select("book_id", "char_id", name_key(F.col("canonical_name")).alias("key")).unionByName(aliases.where("char_id IS NOT NULL").select("book_id", "char_id", name_key(F.col("name")).alias("key"))).distinct()
    others = owned.withColumnRenamed("char_id", "owner")
    refused = ok.join(others, ["book_id", "key"]).where("owner != char_id").select("book_id", "char_id", "key").distinct()
    return ok.join(refused, ["book_id", "char_id", "key"], "left_anti").groupBy("book_id", "char_id", "key").agg(F.min("name").alias("name"), F.max("known_from_chapter").alias("known_from_chapter")).drop("key")


def remove_aliases(aliases: DataFrame, unwanted: DataFrame) -> DataFrame:
    """M2: aliases less the unwanted ones (book_id, char_id, name), compared by name key."""
    gone = unwanted.select("book_id", "char_id", name_key(F.col("name")).alias("_key")).distinct()
    return aliases.withColumn("_key", name_key(F.col("name"))).join(gone, ["book_id", "char_id", "_key"], "left_anti").drop("_key")


def rename(characters: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: (profiles with new names, old names as new aliases). renames: book_id, char_id, new_name; blank ones do nothing."""
    wanted = renames.select("book_id", "char_id", squeeze(F.col("new_name")).alias("new_name")).where("new_name != ''")
    both = characters.join(wanted, ["book_id", "char_id"], "left")
    changed = F.col("new_name").isNotNull() & (name_key(F.col("new_name")) != name_key(F.col("canonical_name")))
    old = both.where(changed).select("book_id", "char_id", F.col("canonical_name").alias("name"), F.coalesce("first_seen_chapter", F.lit(1)).alias("known_from_chapter")).distinct()
    return both.withColumn("canonical_name", F.coalesce("new_name", "canonical_name")).drop("new_name"), old


def merge(characters: DataFrame, aliases: DataFrame, merges: DataFrame, known_from: int = 1) -> tuple[DataFrame, DataFrame]:
    """M4: (profiles, aliases) after source_id is merged into target_id per book.

    The target's own voice wins if chosen by hand, then a hand-chosen one of a source, then any; first
    seen is the least; the sources' names become aliases known from the later of both chapters.
    Merging the narrator, or a profile into itself, does nothing.
    """
    narrator = characters.where(F.col("canonical_name") == NARRATOR).select("book_id", F.col("char_id").alias("n")).distinct()
    ok = merges.join(narrator, "book_id", "left").where("source_id != target_id AND NOT (n <=> source_id) AND NOT (n <=> target_id)").select("book_id", "source_id", "target_id").distinct()
    moved = characters.join(ok.withColumnRenamed("source_id", "char_id"), ["book_id", "char_id"], "left").withColumn("target", F.coalesce("target_id", "char_id"))
    own = F.col("char_id") == F.col("target")
    manual = F.coalesce("voice_manual", F.lit(False))
    rank = F.struct(F.when(own & manual, 0).when(manual, 1).when(own & F.col("voice_id").isNotNull(), 2).when(F.col("voice_id").isNotNull(), 3).otherwise(4), "char_id")
    merged = moved.groupBy("book_id", F.col("target").alias("char_id")).agg(
        F.min_by("canonical_name", F.struct((~own).alias("x"), "row_id")).alias("canonical_name"), F.min("first_seen_chapter").alias("first_seen_chapter"),
        F.min_by("voice_id", rank).alias("voice_id"), F.bool_or(manual).alias("voice_manual"),
        (F.bool_and(F.coalesce("pending", F.lit(False))) & (F.count_distinct("char_id") == 1)).alias("pending"),
    )
    names = moved.where(~own).select("book_id", F.col("target").alias("char_id"), F.col("canonical_name").alias("name"), F.lit(known_from).alias("known_from_chapter"))
    carried = aliases.where("char_id IS NOT NULL").join(ok.withColumnRenamed("source_id", "char_id"), ["book_id", "char_id"], "left")
    carried = carried.select("book_id", F.coalesce("target_id", "char_id").alias("char_id"), "name", F.when(F.col("target_id").isNotNull(), F.greatest("known_from_chapter", F.lit(known_from))).otherwise(F.col("known_from_chapter")).alias("known_from_chapter"))
    return merged, names.unionByName(carried).distinct()


def override_speakers(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (row_id, speaker) win over what was found; the narrator can't be set."""
    ok = edits.where((F.trim("speaker") != "") & (name_key(F.col("speaker")) != NARRATOR.lower())).groupBy("row_id").agg(F.max("speaker").alias("_new"))
    new = F.col("_new").isNotNull()
    out = segments.join(ok, "row_id", "left")
    return out.select(
        "row_id", F.coalesce("_new", "speaker").alias("speaker"), F.when(new, 1.0).otherwise(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"),
        F.when(new, "manual").otherwise(F.col("resolution_method")).alias("resolution_method"), (F.coalesce("review_needed", F.lit(False)) & ~new).alias("review_needed"),
        F.when(~new, F.col("new_character_candidate")).alias("new_character_candidate"),
    )


def select_chapters(chapters: DataFrame, chosen: DataFrame) -> DataFrame:
    """M6: selected_for_processing is membership in chosen (book_id, chapter)."""
    hit = chosen.select("book_id", "chapter", F.lit(True).alias("_c")).distinct()
    return chapters.drop("selected_for_processing").join(hit, ["book_id", "chapter"], "left").withColumn("selected_for_processing", F.coalesce("_c", F.lit(False))).drop("_c")


def clear_chapter(cache: DataFrame, states: DataFrame, book_id: int, chapter: int) -> tuple[DataFrame, DataFrame]:
    """M9: (cache, chapter states) without one chapter's entries; its status is ready again."""
    here = (F.col("book_id") == book_id) & (F.col("chapter") == chapter)
    return cache.where(~here), states.withColumn("status", F.when(here & (F.col("status") == "completed"), "ready_for_audio").otherwise(F.col("status")))
