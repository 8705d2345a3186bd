"""Characters and their names over time."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import name_key
from lorewright.operators.context import with_scenes
from lorewright.session import cut, exploded, fits, small
from lorewright.operators.tables import NARRATOR, UNKNOWN, is_speech, named


def names_over_time(characters: DataFrame, aliases: DataFrame, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """Every name with the chapter from which it is known: book_id, char_id, canonical_name, key, known_from."""
    profiles = characters.select("book_id", "char_id", "canonical_name", F.coalesce("first_seen_chapter", F.lit(0)).alias("seen"))
    own = profiles.select("book_id", "char_id", "canonical_name", key(F.col("canonical_name")).alias("key"), F.col("seen").alias("known_from"))
    other = aliases.where("char_id IS NOT NULL").join(profiles, ["book_id", "char_id"]).select(
        "book_id", "char_id", "canonical_name", key(F.col("name")).alias("key"), F.greatest(F.coalesce("known_from_chapter", F.lit(1)), "seen").alias("known_from")
    )
    return own.unionByName(other).groupBy("book_id", "char_id", "canonical_name", "key").agg(F.min("known_from").alias("known_from"))


def alias_lookup(segments: DataFrame, names: DataFrame, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """Each named row's character as of its chapter: equal key, known by then, the first registered wins.

    Speakers are reduced to distinct (book, key, chapter) before the join, so a hot speaker is looked up once per chapter.
    """
    rows = segments.where(named(F.col("speaker"))).select("row_id", "book_id", "chapter", key(F.col("speaker")).alias("key"))
    asked = rows.select("book_id", "chapter", "key").distinct()
    found = asked.join(names, ["book_id", "key"]).where("known_from <= greatest(chapter, 1)").groupBy("book_id", "chapter", "key").agg(F.min("char_id").alias("char_id"))
    return rows.join(found, ["book_id", "chapter", "key"], "left").select("row_id", "char_id")


_WORD, _OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_RUNS = rf"{_WORD}+|{_OTHER}+"


def _runs(text: Column) -> Column:
    """A text as runs of word characters and of others, in turn."""
    return F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))


def mentions(segments: DataFrame, names: DataFrame, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """book_id, row_id, char_id, n of whole-name mentions visible at the chapter, the folded name taken literally.

    A text meets only the names whose first word it holds: its words are looked up by (book, first word), and what
    follows is compared with the rest of the name. Names that fit are broadcast, so texts aren't shuffled; else only
    the words are, without their texts. Of a character's names the longest at the leftmost place counts, without overlap.
    """
    n = names.where("key != ''").select("book_id", "char_id", "known_from", F.col("key").alias("_name")).distinct()
    lead = F.regexp_extract("_name", rf"^{_OTHER}*", 0)
    n = n.withColumn("_lead", lead).withColumn("_rest", F.substr("_name", F.length("_lead") + 1)).withColumn("_word", F.regexp_extract("_rest", rf"^{_WORD}+", 0))
    n = cut(n.withColumn("_m", F.size(_runs(F.col("_rest")))).withColumn("_closed", F.col("_rest").rlike(_WORD + "$")))
    texts = segments.where("text IS NOT NULL").select("row_id", "book_id", F.greatest("chapter", F.lit(1)).alias("_chapter"), key(F.col("text")).alias("_text"))
    texts = texts.withColumn("_r", _runs(F.col("_text")))
    words = exploded(texts, ["row_id", "book_id", "_chapter", "_r"], F.col("_r"), "_at", "_word")
    by_word = n.where("_word != ''")
    if fits(by_word):
        near = words.join(F.broadcast(by_word), ["book_id", "_word"])
    else:
        # Words that begin no name go no further than the join; those that do are few, and meet their texts again.
        near = words.select("row_id", "book_id", "_at", "_word").join(by_word, ["book_id", "_word"]).join(texts.drop("book_id", "_text"), "row_id")
    tail = F.array_join(F.slice("_r", F.col("_at") + 1, F.greatest("_m", F.lit(1))), "")
    ends = F.when(F.col("_closed"), tail == F.col("_rest")).otherwise(F.startswith(tail, F.col("_rest")) & ((F.length(tail) > F.length("_rest")) | (F.col("_at") + F.col("_m") >= F.size("_r"))))
    before = F.get("_r", F.col("_at") - 1)
    begins = (F.col("_lead") == "") | F.coalesce(F.endswith(before, F.col("_lead")) & ((F.length(before) > F.length("_lead")) | (F.col("_at") == 1)), F.lit(False))
    start = F.length(F.array_join(F.slice("_r", F.lit(1), F.col("_at")), "")) - F.length("_lead")
    hits = near.where((F.col("known_from") <= F.col("_chapter")) & ends & begins).select("book_id", "row_id", "char_id", start.alias("_s"), F.length("_name").alias("_n"))
    # Names without any word character, as "???": every place of the texts of their book that hold them.
    odd = n.where("_word = ''").select("book_id", "char_id", "known_from", "_name")
    held = texts.select("row_id", "book_id", "_chapter", "_text").join(small(odd), "book_id").where(F.col("_text").contains(F.col("_name")) & (F.col("known_from") <= F.col("_chapter")))
    places = F.expr(f"filter(sequence(1, length(_text)), i -> substring(_text, i, length(_name)) = _name AND NOT (i > 1 AND substring(_text, i - 1, 1) RLIKE '{_WORD}') AND NOT substring(_text, i + length(_name), 1) RLIKE '{_WORD}')".replace("\\", "\\\\"))
    hits = hits.unionByName(held.select("book_id", "row_id", "char_id", F.explode_outer(places).alias("_i"), F.length("_name").alias("_n")).where("_i IS NOT NULL").select("book_id", "row_id", "char_id", (F.col("_i") - 1).alias("_s"), "_n"))
    per = hits.groupBy("book_id", "row_id", "char_id").agg(F.array_sort(F.collect_set(F.struct("_s", (-F.col("_n")).alias("_n")))).alias("_h"))
    state = F.struct(F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("c"))
    taken = F.aggregate("_h", state, lambda a, h: F.when(h["_s"] >= a.e, F.struct((h["_s"] - h["_n"]).cast("int").alias("e"), (a.c + 1).alias("c"))).otherwise(a), lambda a: a.c)
    return per.select("book_id", "row_id", "char_id", taken.alias("n"))


def activity_events(segments: DataFrame, names: DataFrame, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """One row per (row, character) with speech, thought or mention: what F5 adds up."""
    spoken = alias_lookup(segments.where(is_speech(F.col("type"))), names, key).where("char_id IS NOT NULL")
    rows = segments.select("row_id", "book_id", F.greatest("chapter", F.lit(1)).alias("chapter"), "seg_order", "type")
    said = spoken.join(rows, "row_id").select("row_id", "char_id", (F.col("type") == "dialogue").cast("bigint").alias("said"), F.lit(0).cast("bigint").alias("mentioned"))
    seen = mentions(segments, names, key=key).select("row_id", "char_id", F.lit(0).cast("bigint").alias("said"), F.col("n").alias("mentioned"))
    both = said.unionByName(seen).groupBy("row_id", "char_id").agg(F.max("said").alias("said"), F.sum("mentioned").alias("mentioned"))
    return both.join(rows, "row_id")


def character_statistics(events: DataFrame, ring: int = 64) -> DataFrame:
    """counts, chapters and the latest activity of every active character."""
    s = events.groupBy("book_id", "char_id").agg(
        F.sum("said").alias("dialogue_count"), F.sum("mentioned").alias("mention_count"), F.array_sort(F.collect_set("chapter")).alias("chapters"),
        F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"),
    )
    # Only the latest rows of a character are ever gathered.
    last = F.row_number().over(Window.partitionBy("book_id", "char_id").orderBy(F.col("chapter").desc(), F.col("seg_order").desc()))
    recent = events.withColumn("_n", last).where(F.col("_n") <= ring).groupBy("book_id", "char_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "seg_order"))).alias("activity"))
    return s.join(recent, ["book_id", "char_id"])


def importance(dialogues, mentions_, chapters, pending):
    """F6. The thresholds are fixed values."""
    return (
        F.when(pending, "unknown")
        .when((dialogues >= 30) | (chapters >= 5) & (dialogues >= 10), "major")
        .when((dialogues >= 5) | (chapters >= 3) | (mentions_ >= 20), "supporting")
        .when((dialogues > 0) | (mentions_ > 0), "minor")
        .otherwise("unknown")
    )


def active_characters(events: DataFrame, window: int = 12) -> DataFrame:
    """For every row with activity, how many characters were active within the last orders of its chapter.

    A range frame would count rows, not characters; each event is spread over the rows it reaches by an equi-join on buckets of the window's width.
    """
    size = window + 1
    a = events.select("book_id", "chapter", "seg_order", "char_id").distinct()
    rows = a.select("book_id", "chapter", F.col("seg_order").alias("at")).distinct().withColumn("b", F.floor(F.col("at") / size))
    spread = a.withColumn("b", F.explode(F.array(F.floor(F.col("seg_order") / size), F.floor(F.col("seg_order") / size) + 1)))
    near = rows.join(spread, ["book_id", "chapter", "b"]).where((F.col("seg_order") <= F.col("at")) & (F.col("at") - F.col("seg_order") <= window))
    return near.groupBy("book_id", "chapter", "at").agg(F.count_distinct("char_id").alias("active"))


def active_ranked(events: DataFrame, characters: DataFrame, window: int = 12) -> DataFrame:
    """For every row with activity, the names of the characters active within the last orders of its chapter, the
    latest first, names of equal place in reverse order; the narrator and pending ones are left out. book_id, chapter, at, active."""
    size = window + 1
    known = characters.where((F.col("canonical_name") != NARRATOR) & ~F.coalesce("pending", F.lit(False))).groupBy("book_id", "char_id").agg(F.min("canonical_name").alias("name"))
    a = events.select("book_id", "chapter", "seg_order", "char_id").distinct()
    rows = a.select("book_id", "chapter", F.col("seg_order").alias("at")).distinct().withColumn("b", F.floor(F.col("at") / size))
    reach = a.join(known, ["book_id", "char_id"]).withColumn("b", F.explode(F.array(F.floor(F.col("seg_order") / size), F.floor(F.col("seg_order") / size) + 1)))
    near = rows.join(reach, ["book_id", "chapter", "b"]).where((F.col("seg_order") <= F.col("at")) & (F.col("at") - F.col("seg_order") <= window))
    last = near.groupBy("book_id", "chapter", "at", "name").agg(F.max("seg_order").alias("last")).groupBy("book_id", "chapter", "at")
    return last.agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("last", "name")))), lambda x: x["name"]).alias("active"))


def candidate_scores(segments: DataFrame, names: DataFrame, characters: DataFrame, top: int = 6, key: Callable[[Column], Column] = name_key, window: int = 12) -> DataFrame:
    """Scored candidates of every speech row: mentions before it in the scene 4 / distance each, speakers of dialogue before it 2,
    mentions after it 2, and 1 for whoever was active within the last orders of the chapter. The narrator, pending and not yet seen people are none."""
    w = Window.partitionBy("book_id", "chapter", "scene_id").orderBy("seg_order", "row_id")
    rows = with_scenes(segments).withColumn("at", F.row_number().over(w)).select("row_id", "book_id", "chapter", "scene_id", "at", "type", "seg_order")
    mentioned = cut(mentions(segments, names, key=key))
    spoken = cut(alias_lookup(segments.where(is_speech(F.col("type"))), names, key).where("char_id IS NOT NULL"))
    said = mentioned.join(rows, ["book_id", "row_id"]).select("book_id", "chapter", "scene_id", "at", "seg_order", "char_id", F.col("n").cast("double").alias("mentioned"), F.lit(0.0).alias("spoke"))
    spoke = spoken.join(rows, "row_id").select("book_id", "chapter", "scene_id", "at", "seg_order", "char_id", F.lit(0.0).alias("mentioned"), F.when(F.col("type") == "dialogue", 1.0).otherwise(0.0).alias("spoke"))
    evidence = cut(said.unionByName(spoke).groupBy("book_id", "chapter", "scene_id", "at", "seg_order", "char_id").agg(F.sum("mentioned").alias("m"), F.max("spoke").alias("s")))
    # Evidence reaches four rows either way: eight copies joined by equality, not a range join.
    reach = evidence.drop("seg_order").withColumn("d", F.explode(F.sequence(F.lit(-4), F.lit(4)))).where("d != 0").withColumn("at", F.col("at") + F.col("d"))
    weight = F.when(F.col("d") > 0, F.col("m") * 4.0 / F.col("d") + F.col("s") * 2.0).otherwise(F.col("m") * 2.0)
    speech = rows.where(is_speech(F.col("type")))
    near = speech.join(reach, ["book_id", "chapter", "scene_id", "at"]).select("row_id", "book_id", "chapter", "char_id", F.round(weight, 6).alias("score"))
    # Activity of earlier rows of the chapter, spread over the rows it reaches by an equi-join on buckets of the window's width.
    size = window + 1
    bucket = F.floor(F.col("seg_order") / size)
    acts = evidence.select("book_id", "chapter", F.col("seg_order").alias("_o"), "char_id", F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    active = speech.withColumn("_b", bucket).join(acts, ["book_id", "chapter", "_b"]).where((F.col("_o") < F.col("seg_order")) & (F.col("seg_order") - F.col("_o") <= window))
    active = active.select("row_id", "book_id", "chapter", "char_id").distinct().withColumn("score", F.lit(1.0))
    scored = near.unionByName(active).groupBy("row_id", "book_id", "chapter", "char_id").agg(F.sum("score").alias("score")).where("score > 0")
    people = characters.where(~F.coalesce("pending", F.lit(False)) & ~F.col("canonical_name").isin(NARRATOR, UNKNOWN)).groupBy("book_id", "char_id").agg(F.min("canonical_name").alias("name"), F.min(F.coalesce("first_seen_chapter", F.lit(0))).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy(F.round("score", 4).desc(), "name", "char_id"))
    kept = scored.join(people, ["book_id", "char_id"]).where(F.col("seen") <= F.greatest("chapter", F.lit(1)))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("row_id", "book_id", "chapter", "char_id", "rank", "name", F.round("score", 4).alias("score"))


def candidate_identities(candidates: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """row_id, ``candidates`` (names by rank), ``identities`` (a map from every name key of theirs to the name) and ``aliases``
    (structs of name, alias, chapter: at most three per candidate, the earliest known first).

    candidates: rows of ``candidate_scores``. An alias goes before another candidate's own name of the same key.
    """
    keyed = names.select("book_id", "char_id", "key", "known_from", (F.col("key") != name_key(F.col("canonical_name"))).alias("alias"))
    both = candidates.join(keyed, ["book_id", "char_id"]).where("known_from <= greatest(chapter, 1)")
    n = F.row_number().over(Window.partitionBy("row_id", "char_id", "alias").orderBy("known_from", "key"))
    both = both.withColumn("_n", n).where(f"NOT alias OR _n <= {most}")
    item = F.struct(F.col("rank").alias("rank"), F.col("known_from").alias("chapter"), F.col("key").alias("alias"), F.col("name").alias("name"))
    aliases = both.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(F.col("alias"), item))).alias("_a"))
    ids = both.groupBy("row_id", "key").agg(F.min_by("name", F.struct((~F.col("alias")).alias("own"), "rank")).alias("name")).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "name"))).alias("identities"))
    own = candidates.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("candidates"))
    out = own.join(ids, "row_id", "left").join(aliases, "row_id", "left")
    return out.select("row_id", "candidates", "identities", F.transform("_a", lambda x: F.struct(x["name"].alias("name"), x["alias"].alias("alias"), x["chapter"].alias("chapter"))).alias("aliases"))


def duplicate_tokens(characters: DataFrame, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """E8, token part: pairs of profiles of a book of which one's key is a word of the other's. An equi-join on the word."""
    p = characters.where(F.col("canonical_name") != NARRATOR).groupBy("book_id", "char_id").agg(F.min("canonical_name").alias("name")).withColumn("key", key(F.col("name")))
    words = p.select("book_id", F.col("char_id").alias("other_id"), F.explode(F.array_distinct(F.split("key", " "))).alias("key"))
    hits = p.select("book_id", "char_id", "key").join(words, ["book_id", "key"]).where("char_id != other_id")
    return hits.select("book_id", F.least("char_id", "other_id").alias("left_id"), F.greatest("char_id", "other_id").alias("right_id")).distinct()


def duplicate_ratio(characters: DataFrame, least: float = 0.78) -> DataFrame:
    """E8, similarity part. A ratio r of matched characters needs 2 * shared / total >= r, so lengths and
    character counts prune pairs before the comparison, which runs in Arrow batches."""
    p = characters.where(F.col("canonical_name") != NARRATOR).groupBy("book_id", "char_id").agg(F.min("canonical_name").alias("name")).withColumn("key", name_key(F.col("name")))
    p = p.where("key != ''").withColumn("len", F.length("key"))
    # m matched characters of which no two are neighbours in both keys leave m - 1 others, so a pair without a common
    # bigram has m <= 1 / (3 - 2 / least): only short keys, which meet by their single characters too.
    matched = int(1 / (3 - 2 / least)) if least > 2 / 3 else None
    short = "true" if matched is None or matched > 1000 else f"len <= {int(2 * matched / least) - matched}"
    grams = p.withColumn("gram", F.explode(F.expr(f"array_distinct(concat(transform(sequence(1, greatest(len - 1, 1)), i -> substring(key, i, 2)), if({short}, split(key, ''), array())))")))
    a = grams.select("book_id", "gram", F.col("char_id").alias("left_id"), F.col("key").alias("a"), F.col("len").alias("la"))
    b = grams.select("book_id", "gram", F.col("char_id").alias("right_id"), F.col("key").alias("b"), F.col("len").alias("lb"))
    near = a.join(b, ["book_id", "gram"]).where((F.col("left_id") < F.col("right_id")) & (2.0 * F.least("la", "lb") >= least * (F.col("la") + F.col("lb")))).select("book_id", "left_id", "right_id", "a", "b").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return near.withColumn("ratio", F.round(ratio("a", "b"), 6)).where(F.col("ratio") >= least).select("book_id", "left_id", "right_id", "ratio")


#: Fixed value: what parts a name from an alias in narration, and the alias.
ALIAS_PHRASE = r",?\s+(?:también\s+)?(?:conocid[oa]\s+como|llamad[oa])\s+([A-ZÁÉÍÓÚÑ][\p{L}\p{N}_-]*(?:\s+(?:[A-ZÁÉÍÓÚÑ][\p{L}\p{N}_-]*|from|de|la|the)){0,3})"


def alias_evidence(segments: DataFrame, characters: DataFrame) -> DataFrame:
    """Aliases that narration gives outright ('NAME, conocida como ALIAS'): book_id, char_id, alias, known_from.

    One literal pattern finds the candidates. A name ends where the phrase begins, so the head's endings, as long as names
    of that book can be, are looked up by equality.
    """
    found = F.regexp_extract("text", "^(.*?)" + ALIAS_PHRASE, 1)
    hits = segments.where((F.col("type") == "narration") & F.col("text").rlike(ALIAS_PHRASE)).select("book_id", "chapter", found.alias("head"), F.regexp_extract("text", "^(.*?)" + ALIAS_PHRASE, 2).alias("alias")).where("alias != ''")
    people = characters.where("canonical_name IS NOT NULL AND canonical_name != ''").select("book_id", "char_id", F.col("canonical_name").alias("name")).distinct()
    sizes = people.select("book_id", F.length("name").alias("size")).distinct()
    ended = hits.join(sizes, "book_id").where(F.length("head") >= F.col("size")).withColumn("name", F.expr("right(head, size)"))
    return ended.join(people, ["book_id", "name"]).groupBy("book_id", "char_id", "alias").agg(F.min("chapter").alias("known_from"))


def duplicate_aliases(evidence: DataFrame, names: DataFrame, characters: DataFrame, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """E8, alias part: a character whose alias by evidence is another one's name: book_id, left_id, right_id, in the direction of the evidence."""
    other = names.groupBy("book_id", "key").agg(F.min("char_id").alias("right_id"))
    left = evidence.select("book_id", F.col("char_id").alias("left_id"), key(F.col("alias")).alias("key")).distinct()
    narrator = characters.where(F.col("canonical_name") == NARRATOR).select("book_id", F.col("char_id").alias("left_id")).distinct()
    return left.join(other, ["book_id", "key"]).where("left_id != right_id").join(narrator, ["book_id", "left_id"], "left_anti").select("book_id", "left_id", "right_id").distinct()


def rebuild_profiles(segments: DataFrame) -> DataFrame:
    """Profiles of all named speakers in the order of first appearance: book_id, char_id, canonical_name, first_seen_chapter."""
    first = segments.where(named(F.col("speaker"))).groupBy("book_id", "speaker").agg(F.min("chapter").alias("first_seen_chapter"))
    place = first_appearance(segments).where(F.col("speaker") != UNKNOWN)
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("position"))
    rows = place.withColumn("_n", number).join(first, ["book_id", "speaker"], "left")
    return rows.select("book_id", F.format_string("char_%06d", "_n").alias("char_id"), F.col("speaker").alias("canonical_name"), "first_seen_chapter")


def first_appearance(segments: DataFrame) -> DataFrame:
    """Speakers of a book by first appearance, the narrator first; position from 0."""
    s = segments.where("speaker IS NOT NULL").groupBy("book_id", "speaker").agg(F.min(F.struct("seg_order", "row_id")).alias("first"))
    narrator = segments.select("book_id").distinct().select("book_id", F.lit(NARRATOR).alias("speaker"))
    s = s.where(F.col("speaker") != NARRATOR).select("book_id", "speaker", "first", F.lit(1).alias("o")).unionByName(narrator.select("book_id", "speaker", F.lit(None).cast(s.schema["first"].dataType).alias("first"), F.lit(0).alias("o")))
    w = Window.partitionBy("book_id").orderBy("o", "first")
    return s.select("book_id", "speaker", (F.row_number().over(w) - 1).alias("position"))


def evidence_window(events: DataFrame, back: int = 8, least: int = 3) -> DataFrame:
    """The last rows that involve a character, for those with enough of them."""
    w = Window.partitionBy("book_id", "char_id").orderBy(F.col("seg_order").desc(), F.col("row_id").desc())
    rows = events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= back)
    return rows.groupBy("book_id", "char_id").agg(F.count(F.lit(1)).alias("rows"), F.min("seg_order").alias("from_order"), F.max("seg_order").alias("to_order")).where(F.col("rows") >= least)

