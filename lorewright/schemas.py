"""Explicit schemas of the data model, and version checks (section 1 of the blueprint)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOOKS = "book_id bigint, title string, source_path string, format string, author string, language string, publisher string, identifier string, source string, imported_at timestamp_ntz"
CHAPTERS = "row_id bigint, book_id bigint, chapter int, chapter_id string, title string, text string, source string, source_reference string, status string, selected_for_processing boolean, narrate boolean, section_kind string, word_count int, consistency_warning string, cleaning_notes array<string>, updated_at timestamp_ntz, loaded_at timestamp_ntz"
BLOCKS = "book_id bigint, pos int, text string, heading_level int, emphasis array<string>, scene_break boolean, source_reference string"
SEGMENTS = "row_id bigint, book_id bigint, chapter int, seg_order bigint, segment_id string, type string, text string, speaker string, confidence double, resolution_method string, review_needed boolean, new_character_candidate string, emphasis array<string>, scene_break_before boolean, context_before string, context_after string, lang string, updated_at timestamp_ntz, loaded_at timestamp_ntz"
CHARACTERS = "row_id bigint, book_id bigint, char_id string, canonical_name string, importance string, first_seen_chapter int, last_seen_chapter int, dialogue_count bigint, mention_count bigint, chapters_seen array<int>, activity array<struct<chapter:int,ord:bigint>>, pending boolean, voice_id string, voice_strategy string, voice_manual boolean, loaded_at timestamp_ntz"
ALIASES = "row_id bigint, book_id bigint, char_id string, name string, known_from_chapter int, source string, loaded_at timestamp_ntz"
VOICES = "voice_id string, name string, language string, gender string, provider string, strategy string"
PROFILES = "id string, name string, provider string, base_voice_id string, language string, reference_audio string, strategy string, settings struct<speed:double,volume:double,pitch:double,style:string>, metadata map<string,string>"
RESPONSE = "speaker string, confidence double, is_new_character boolean"

TYPES = ("narration", "dialogue", "internal_thought", "system_message")
SOURCES = ("system", "rule", "conversation", "candidate", "llm", "manual", "unknown")


def missing(df: DataFrame, schema: str) -> list[str]:
    """Fields of the schema that the table lacks or has in another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in StructType.fromDDL(schema).fields if have.get(f.name) != f.dataType]


def violations(segments: DataFrame) -> DataFrame:
    """Rows outside the closed sets of the model: row_id and the field."""
    bad = F.array_compact(F.array(F.when(~F.col("type").isin(*TYPES), "type"), F.when(~F.col("resolution_method").isin(*SOURCES), "resolution_method"), F.when(~F.col("confidence").between(0, 1), "confidence")))
    return segments.select("row_id", F.explode(bad).alias("field"))
