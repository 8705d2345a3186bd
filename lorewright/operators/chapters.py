"""Chapters of a book: detection, selection, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import chapter_id, is_chapter_heading, normalize_text, split_lines, strip, with_headings, word_count
from lorewright.session import exploded, once, spread


def text_blocks(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Non-blank lines as blocks, pos from 0 without gaps."""
    blocks = F.filter(F.transform(split_lines(F.col(text)), strip), lambda x: x != "")
    return exploded(df, keys, blocks, "pos", "block")


def split_chapters(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """C4 for books of one text each: keys, number, title, text of every chapter.

    A book is one row and stays one: its lines are an array, headings are places in it, chapters are slices between them.
    Nothing is shuffled. Headings are recognised as in C5; without one the book is one chapter, text before the first is the introduction.
    """
    lines = F.filter(F.transform(split_lines(F.col(text)), strip), lambda x: x != "")
    rows = once(spread(df.select(*keys, text)), keys, lines, "_x")
    rows = once(rows, keys, with_headings(F.col("_x")), "_l").where(F.size("_l") > 0)
    heads = F.filter(F.transform("_l", lambda x, i: F.when(x.h, i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("_s", heads)
    starts = F.when(F.get("_l", F.lit(0)).h, F.col("_s")).otherwise(F.concat(F.array(F.lit(1)), "_s"))
    rows = rows.select(*keys, "_l", (F.size("_s") > 0).alias("_any"), starts.alias("_s"))
    first = lambda at: F.get("_l", at - 1)
    title = lambda at: F.when(first(at).h, first(at).x).when(F.col("_any"), F.lit("Introduction")).otherwise(F.lit("Full document"))
    own = lambda at, k: F.slice("_l", at, F.coalesce(F.get("_s", k + 1), F.size("_l") + 1) - at)
    parts = F.transform("_s", lambda at, k: F.struct(title(at).alias("title"), F.array_join(F.transform(own(at, k), lambda x: x.x), "\n\n").alias("text")))
    out = exploded(rows, keys, parts, "number", "p").select(*keys, (F.col("number") + 1).alias("number"), "p.title", "p.text")
    return out.withColumn("text", normalize_text(F.col("text")))


def detect_chapters(blocks: DataFrame, key: str, heading_level: str | None = None) -> DataFrame:
    """Key, number, title, text of every chapter of a book given as ordered blocks, whose rows stand apart; see ``split_chapters``.

    Headings are recognised as in C5 or by a heading level. Without one the book is one
    chapter; text before the first is the introduction.
    """
    heading = is_chapter_heading(F.col("block"))
    if heading_level:
        heading = F.col(heading_level).isNotNull() | heading
    w = Window.partitionBy(key).orderBy("pos")
    marked = blocks.withColumn("_h", heading).withColumn("_g", F.sum(F.col("_h").cast("int")).over(w))
    parts = marked.groupBy(key, "_g").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("_blocks"))
    every = Window.partitionBy(key)
    parts = parts.withColumn("_last", F.max("_g").over(every)).withColumn("number", F.row_number().over(every.orderBy("_g")))
    first = F.col("_blocks")[0].block
    body = F.array_join(F.transform(F.slice("_blocks", 2, F.size("_blocks")), lambda x: x.block), "\n\n")
    whole = F.array_join(F.transform("_blocks", lambda x: x.block), "\n\n")
    title = F.when(F.col("_g") > 0, strip(first)).when(F.col("_last") == 0, F.lit("Full document")).otherwise(F.lit("Introduction"))
    text = F.when((F.col("_g") > 0) & (F.size("_blocks") > 1), F.concat(strip(first), F.lit("\n\n"), body)).otherwise(whole)
    return parts.select(key, "number", title.alias("title"), text.alias("text")).withColumn("text", normalize_text(F.col("text")))


def enrich_chapters(chapters: DataFrame, key: str, book_format: str = "txt") -> DataFrame:
    """Character span in the book, stable id, word count. Texts follow each other with two characters between."""
    w = Window.partitionBy(key).orderBy("number")
    length = F.length("text")
    start = F.coalesce(F.sum(length + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = chapters.withColumn("start", start.cast("bigint")).withColumn("end", (start + length).cast("bigint"))
    reference = F.concat(F.lit("txt:characters-"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return out.select(key, "number", "start", "end", reference.alias("reference"), chapter_id(F.lit(book_format), F.col("number"), reference).alias("chapter_id"), word_count(F.col("text")).cast("bigint").alias("words"))


def parse_range(expression: str, last: int) -> list[tuple[int, int]]:
    """D2: '1-10,25' as inclusive spans; raises where a span is malformed or out of bounds."""
    spans = []
    for part in expression.split(","):
        ends = [int(x) for x in part.strip().split("-")] if all(x.strip().isdigit() for x in part.split("-")) else []
        if len(ends) == 1:
            ends *= 2
        if len(ends) != 2 or not 0 < ends[0] <= ends[1] <= last:
            raise ValueError(f"not a range of chapters: {expression!r}")
        spans.append((ends[0], ends[1]))
    return spans


def select_range(df: DataFrame, expression: str, number: str = "chapter", last: int = 1_000_000) -> DataFrame:
    """Rows whose number lies in the range expression; the spans become one pushed-down predicate."""
    hit = F.lit(False)
    for lo, hi in parse_range(expression, last):
        hit = hit | F.col(number).between(lo, hi)
    return df.where(hit)


def search(df: DataFrame, q: str) -> DataFrame:
    """D3: title contains q in any case, or the number is q; an empty q takes all."""
    q = q.strip()
    return df if not q else df.where(F.lower(F.coalesce("title", F.lit(""))).contains(q.lower()) | (F.col("chapter").cast("string") == q))


def book_statistics(chapters: DataFrame, words_per_minute: int = 160) -> DataFrame:
    """per book, chapters and words, of all and of those selected for narration, reading minutes and size."""
    chosen = F.col("selected_for_processing") & F.col("narrate")
    words = F.coalesce("word_count", F.lit(0))
    s = chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapters"), F.count_if(chosen).alias("selected_chapters"),
        F.sum(words).cast("bigint").alias("total_words"), F.coalesce(F.sum(F.when(chosen, words)), F.lit(0)).cast("bigint").alias("selected_words"),
    )
    size = F.when(F.col("selected_words") < 10_000, "Small").when(F.col("selected_words") < 50_000, "Medium").when(F.col("selected_words") < 150_000, "Large").otherwise("Very large")
    return s.withColumn("minutes", F.bround(F.col("selected_words") / words_per_minute, 1)).withColumn("size_category", size)


def manifest_problems(chapters: DataFrame) -> DataFrame:
    """Index rows whose id is malformed, or shared by several chapters of the book, or whose number is below one."""
    shared = chapters.groupBy("book_id", "chapter_id").agg(F.count_distinct("chapter").alias("n")).where("n > 1").select("book_id", "chapter_id", F.lit(True).alias("shared"))
    rows = chapters.join(shared, ["book_id", "chapter_id"], "left")
    problem = F.when(~F.coalesce(F.col("chapter_id").rlike("^ch_[0-9a-f]{16}$"), F.lit(False)), "id").when(F.col("shared"), "shared id").when(F.col("chapter") < 1, "number")
    return rows.select("row_id", problem.alias("problem")).where("problem IS NOT NULL")
