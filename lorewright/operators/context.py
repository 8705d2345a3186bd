"""Neighbourhoods of an utterance and attribution by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators.tables import NARRATOR, UNKNOWN, is_speech, named

# The verbs of speech, the gestures between name and verb, the words that are no name.
SPEECH_VERBS = "dijo respondió preguntó gritó susurró exclamó contestó añadió replicó murmuró ordenó comentó"
GESTURES = "abrió|se volvió|sonrió|asintió|se acercó"
NO_NAMES = ["La", "El", "Una", "Un", "Ella", "Él", NARRATOR, UNKNOWN]
REPLY_VERBS = "dijo respondió preguntó contestó replicó"
_CAP = "A-ZÁÉÍÓÚÜÑ"
_NAME = rf"[{_CAP}][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'-]*(?:\s+(?:(?:from|of|de|del|la)\s+)?[{_CAP}][A-Za-zÁÉÍÓÚÜÑáéíóúüñ'-]*)*"
_VERBS = "(?iu:" + SPEECH_VERBS.replace(" ", "|") + ")"
AFTER = rf"(?:^|[^\p{{L}}\p{{N}}_]){_VERBS}\s+({_NAME})"
BEFORE = rf"({_NAME})(?:\s+(?iu:{GESTURES})(?:[^\p{{L}}\p{{N}}_:;.!?][^:;.!?]{{0,99}}?)?\s+y)?\s+{_VERBS}\s*:\s*$"
THOUGHT = rf"({_NAME})\s+(?:pensó|se dijo)(?:\s+para sí)?[.:]?\s*$"
SELF = rf"(?:[Mm]i nombre es|[Yy]o,)\s+({_NAME})(?:[,!.?]|$)"


def with_scenes(df: DataFrame) -> DataFrame:
    """G1: scene_id, the number of scene breaks of the chapter up to the row."""
    w = Window.partitionBy("book_id", "chapter").orderBy("seg_order", "row_id")
    return df.withColumn("scene_id", F.sum(F.coalesce(F.col("scene_break_before"), F.lit(False)).cast("int")).over(w))


def context_windows(df: DataFrame, size: int = 4) -> DataFrame:
    """Arrays before and after (type, text, speaker) within the scene; later speakers are masked."""
    w = Window.partitionBy("book_id", "chapter", "scene_id").orderBy("seg_order", "row_id")
    item = F.struct("type", F.coalesce("text", F.lit("")).alias("text"), "speaker")
    masked = F.struct("type", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("type") == "narration", NARRATOR).otherwise(UNKNOWN).alias("speaker"))
    rows = with_scenes(df)
    return rows.withColumn("before", F.collect_list(item).over(w.rowsBetween(-size, -1))).withColumn("after", F.collect_list(masked).over(w.rowsBetween(1, size)))


def _found(text: Column, pattern: str) -> Column:
    name = F.regexp_extract(text, pattern, 1)
    return F.when(name != "", name)


def rule_speaker(df: DataFrame, scenes: bool = True) -> DataFrame:
    """L1: rule_speaker from the utterance and its direct neighbours; one window, no Python.

    scenes: neighbours end at a scene break (attribution); else at the chapter (F4).
    """
    if scenes:
        df = with_scenes(df)
    w = Window.partitionBy("book_id", "chapter", *["scene_id"] * scenes).orderBy("seg_order", "row_id")
    here = F.struct("type", "text")
    df = df.withColumn("_p", F.lag(here).over(w)).withColumn("_n", F.lead(here).over(w))
    thought = _found(F.col("_p.text"), THOUGHT)
    thought = F.when(~thought.isin("La", "El", "Una", "Un"), thought)
    after = F.when(F.col("_n.type") == "narration", _found(F.col("_n.text"), AFTER))
    before = F.when(F.col("_p.type") == "narration", _found(F.col("_p.text"), BEFORE))
    spoken = F.coalesce(after, before)
    spoken = F.coalesce(_found(F.col("text"), SELF), F.when(~spoken.isin(*NO_NAMES), spoken))
    return df.withColumn("rule_speaker", F.when(F.col("type") == "internal_thought", thought).when(F.col("type") == "dialogue", spoken)).drop("_p", "_n")


def rule_percent(df: DataFrame) -> DataFrame:
    """per book, speech, rule hits, percentage (half to even) and what would be left for a remote resolver."""
    s = rule_speaker(df, scenes=False).groupBy("book_id").agg(
        F.count_if(F.col("type") == "dialogue").alias("dialogues"), F.count_if(F.col("type") == "internal_thought").alias("thoughts"),
        F.count(F.lit(1)).alias("segments"), F.count("rule_speaker").alias("explicit"),
    )
    n = F.col("dialogues") + F.col("thoughts")
    return s.withColumn("percent", F.bround(F.col("explicit") * 100.0 / F.greatest(n, F.lit(1)), 0).cast("bigint")).withColumn("remote_calls", n - F.col("explicit"))


def previous_speakers(df: DataFrame, back: int = 8) -> DataFrame:
    """Named speakers of the last eight rows' dialogue; with a scene break among the last four, only those since it."""
    w = Window.partitionBy("book_id", "chapter").orderBy("seg_order", "row_id")
    rows = with_scenes(df)
    item = F.struct("type", "speaker", "scene_id")
    near = F.collect_list(item).over(w.rowsBetween(-back, -1))
    rows = rows.withColumn("_near", near).withColumn("_broken", F.max(F.coalesce(F.col("scene_break_before"), F.lit(False))).over(w.rowsBetween(-4, 0)))
    keep = lambda x: (x.type == "dialogue") & x.speaker.isNotNull() & ~x.speaker.isin(NARRATOR, UNKNOWN)
    all_ = F.filter("_near", keep)
    scene = F.filter(F.slice(F.reverse("_near"), 1, 4), lambda x: keep(x) & (x.scene_id == F.col("scene_id")))
    chosen = F.when(F.col("_broken"), F.reverse(scene)).otherwise(all_)
    return rows.withColumn("previous", F.transform(chosen, lambda x: x.speaker)).drop("_near", "_broken")


def alternation(df: DataFrame) -> DataFrame:
    """B in A-B-A for a short reply, where the scene's narration only reports speech."""
    rows = previous_speakers(df)
    w = Window.partitionBy("book_id", "chapter", "scene_id").orderBy("seg_order", "row_id")
    rows = rows.withColumn("_b", F.collect_list(F.struct("type", F.coalesce("text", F.lit("")).alias("text"))).over(w.rowsBetween(-4, -1)))
    last = F.slice("previous", F.greatest(F.size("previous") - 2, F.lit(1)), 3)
    s = [F.get(last, F.lit(i)) for i in range(3)]
    reports = ~F.exists("_b", lambda x: (x.type == "narration") & ~F.lower(F.ltrim(x.text)).rlike("^(?:" + REPLY_VERBS.replace(" ", "|") + ")"))
    hit = (F.col("type") == "dialogue") & (F.size("previous") >= 3) & (s[0] == s[2]) & (s[0] != s[1]) & (F.length("text") <= 220) & reports
    return rows.where(hit).select("row_id", s[1].alias("speaker_by_turn"))


def confidence_policy(df: DataFrame, review: float = 0.60, accept: float = 0.85) -> DataFrame:
    """D10, the part without state: what an answer (speaker, confidence, is_new) does to its row. NaN counts as no confidence."""
    conf = F.when(~F.isnan("confidence"), F.col("confidence"))
    usable = named(F.col("speaker")) & (conf >= review)
    is_new = F.col("new_character_candidate").isNotNull()
    speaker = F.when(usable & ~is_new, F.col("speaker")).otherwise(UNKNOWN)
    out = df.withColumn("decided", speaker).withColumn("candidate", F.when(usable & is_new, F.col("speaker")))
    return out.withColumn("review", (F.col("decided") == UNKNOWN) | conf.isNull() | (conf < accept))


def validated_response(c: Column) -> Column:
    """(speaker, confidence, is_new) from a JSON answer; null where any field breaks its contract."""
    j = F.from_json(c, "speaker string, confidence double, is_new_character boolean")
    raw = F.get_json_object(c, "$.confidence")
    speaker = F.trim(j.speaker)
    ok = (speaker != "") & (F.length(speaker) <= 100) & ~raw.isin("true", "false") & ~F.isnan(j.confidence) & j.confidence.between(0, 1)
    return F.when(ok, F.struct(speaker.alias("speaker"), j.confidence.alias("confidence"), F.coalesce(j.is_new_character, F.lit(False)).alias("is_new")))


def response_fits(answer: Column, candidates: Column, identities: Column, evidence: Column, key) -> Column:
    """The answer's speaker: identities, a map from name keys, gives a candidate's name for any of its names; a known
    one must be a candidate or Unknown, a new one must be none and stand in the evidence. Null where refused."""
    canonical = F.coalesce(F.element_at(identities, key(answer.speaker)), answer.speaker)
    among = lambda name: F.coalesce(F.array_contains(candidates, name), F.lit(False))
    new_ok = ~among(answer.speaker) & F.contains(key(evidence), key(answer.speaker))
    return F.when(answer.is_new, F.when(new_ok, answer.speaker)).when(among(canonical) | (canonical == UNKNOWN), canonical)


def accepted_answers(answers: DataFrame, segments: DataFrame, identities: DataFrame, key) -> DataFrame:
    """D12 over a table: row_id and the accepted speaker of every answer (row_id, answer) that fits its row's candidates and window."""
    windows = context_windows(segments).select("row_id", F.concat_ws(" ", F.transform("before", lambda x: x.text), F.coalesce("text", F.lit("")), F.transform("after", lambda x: x.text)).alias("_evidence"))
    rows = answers.join(windows, "row_id").join(identities.select("row_id", "candidates", "identities"), "row_id", "left")
    speaker = response_fits(F.col("answer"), F.col("candidates"), F.col("identities"), F.col("_evidence"), key)
    return rows.select("row_id", speaker.alias("accepted")).where("accepted IS NOT NULL")


def render_prompt(df: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """The utterance with its window, the last three speakers, and, where given, its candidates and their aliases, as one prompt with the contract's cuts."""
    lines = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("["), x.type, F.lit(" | "), F.coalesce(x.speaker, F.lit("Unknown")), F.lit("] "), F.left(x.text, F.lit(500)))), "\n")
    rows = context_windows(df).where(is_speech(F.col("type")))
    before = previous_speakers(df).select("row_id", F.slice("previous", F.greatest(F.size("previous") - 2, F.lit(1)), 3).alias("_previous"))
    rows = rows.join(before, "row_id")
    candidates, aliases = F.lit(""), F.lit("")
    if identities is not None:
        rows = rows.join(identities.select("row_id", F.col("candidates").alias("_c"), F.col("aliases").alias("_a")), "row_id", "left")
        candidates = F.coalesce(F.array_join("_c", ", "), F.lit(""))
        aliases = F.coalesce(F.array_join(F.transform("_a", lambda x: F.concat(x["alias"], F.lit(" = "), x["name"], F.lit(" ("), x.chapter.cast("string"), F.lit(")"))), ", "), F.lit(""))
    head = [F.concat(F.lit(f"{name} "), value) for name, value in (("CHAPTER", F.col("chapter").cast("string")), ("PREVIOUS", F.array_join("_previous", ", ")), ("CANDIDATES", candidates), ("ALIASES", aliases))]
    prompt = F.concat_ws("\n", *head, F.lit("BEFORE"), lines(F.col("before")), F.concat(F.lit("SEGMENT "), F.col("type")), F.left(F.coalesce("text", F.lit("")), F.lit(2000)), F.lit("AFTER"), lines(F.col("after")))
    return rows.select("row_id", prompt.alias("prompt"))
