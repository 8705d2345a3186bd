"""Queries of the core operators over the delivered tables, and the SQL that gives the same rows.

Each query runs over whole tables. Those without SQL use folding, sequential state or binary data
that the SQL engine can't express; their operators are tested against models in tests/.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright import schemas
from lorewright.functions import text as T
from lorewright.operators import audio, chapters, characters, chunks, context, edits, incremental, pages, review, segmenter, voices
from lorewright.operators.tables import is_speech, latest, named
from lorewright.plans import fold, project, remote
from lorewright.session import cut, exploded, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Shared pieces of the SQL.
_LC = "lc AS (SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY book_id, chapter ORDER BY loaded_at DESC, row_id DESC) = 1)"
_LS = "ls AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY book_id, segment_id ORDER BY loaded_at DESC, row_id DESC) = 1)"
_LP = "lp AS (SELECT * FROM characters QUALIFY row_number() OVER (PARTITION BY book_id, char_id ORDER BY loaded_at DESC, row_id DESC) = 1)"
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{_WS}+', ' ', 'g')"


def _alike(lo: int, hi: int) -> list[tuple[str, str]]:
    """Characters of a range whose compatibility form is another single character."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(lo, hi))]
    return [(c, d) for c, d in pairs if c != d and len(d) == 1]


# What folding does beyond accents: other widths and raised digits, the letters with a dot below of the Devanagari script, one sigma.
_SINGLE = [*_alike(0xFF01, 0xFFA0), *_alike(0x2070, 0x209D), *_alike(0xB2, 0xBB), ("‑", "‐"), ("ς", "σ")]
_SINGLE += [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, [*range(0x958, 0x960), 0x929, 0x931, 0x934])]
_DOUBLE = [("ß", "ss"), ("ẞ", "ss"), ("…", "..."), ("ﬁ", "fi"), ("ﬂ", "fl"), ("\u0e33", "\u0e4d\u0e32")]


def _key(x: str) -> str:
    """The folded name key. The engine's accent stripping takes vowel signs away too, so Devanagari and Thai lose only the marks that fold."""
    y = _squeeze(x)
    for a, b in _DOUBLE:
        y = f"replace({y}, '{a}', '{b}')"
    y = "lower(translate({}, '{}', '{}'))".format(y, *("".join(z).replace("'", "''") for z in zip(*_SINGLE)))
    fold = "CASE WHEN regexp_matches(x, '[\\x{900}-\\x{97f}]') THEN regexp_replace(x, '[\\x{93c}\\x{94d}]', '', 'g') WHEN regexp_matches(x, '[\\x{e00}-\\x{e7f}]') THEN regexp_replace(x, '[\\x{e38}-\\x{e3a}\\x{e48}-\\x{e4b}]', '', 'g') ELSE strip_accents(x) END"
    return f"list_transform([{y}], lambda x: {fold})[1]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return add


def _chapters(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "chapters", *{"book_id", "chapter", "row_id", "loaded_at", *cols}), "book_id", "chapter")


def _segments(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "segments", *{"book_id", "segment_id", "row_id", "loaded_at", *cols}), "book_id", "segment_id")


def _people(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "characters"), "book_id", "char_id")


_FULL = ("chapter", "seg_order", "type", "text", "speaker", "confidence", "resolution_method", "review_needed", "new_character_candidate", "scene_break_before")


# ---- utterances: C7, C8, C10, C11, C17, C18, F15 -------------------------------------------------------------


@query("speaker_type_counts", f"WITH {_LS} SELECT speaker, type, count(*) AS n FROM ls GROUP BY speaker, type")
def speaker_type_counts(spark, d):
    return _segments(spark, d, "speaker", "type").groupBy("speaker", "type").agg(F.count(F.lit(1)).alias("n"))


@query("segment_type_histogram", f"WITH {_LS} SELECT book_id, type, count(*) AS n FROM ls GROUP BY book_id, type")
def segment_type_histogram(spark, d):
    return _segments(spark, d, "type").groupBy("book_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("segment_ids_global", f"WITH {_LS}, n AS (SELECT row_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter, seg_order, row_id) AS k FROM ls) SELECT row_id, printf('seg_%06d', k) AS new_id, k AS new_order FROM n")
def segment_ids_global(spark, d):
    return segmenter.segment_ids(_segments(spark, d, "seg_order", "chapter"))


@query("segment_ids_by_chapter", f"WITH {_LS}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter ORDER BY seg_order, row_id) AS k FROM ls) SELECT row_id, printf('b%d_c%d_seg_%06d', book_id, chapter, k) AS new_id, CAST(chapter AS BIGINT) * 1000000000 + k - 1 AS new_order FROM n")
def segment_ids_by_chapter(spark, d):
    return segmenter.segment_ids(_segments(spark, d, "seg_order", "chapter"), "chapter")


@query("segment_dash_lines", f"""
WITH {_LC}, l AS (SELECT row_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS line_no FROM lc),
s AS (SELECT row_id, line_no, string_split({_strip('line')}, '—')[2:] AS f FROM l WHERE starts_with({_strip('line')}, '—')),
p AS (SELECT row_id, line_no, unnest(f) AS frag, generate_subscripts(f, 1) - 1 AS frag_no FROM s)
SELECT row_id, CAST(line_no AS INTEGER) AS line_no, CAST(frag_no AS INTEGER) AS frag_no, CASE WHEN frag_no % 2 = 0 THEN 'dialogue' ELSE 'narration' END AS type, {_strip('frag')} AS text FROM p WHERE {_strip('frag')} <> ''""")
def segment_dash_lines(spark, d):
    return segmenter.dash_lines(_chapters(spark, d, "text"), ["row_id"])


@query("segment_text")
def segment_text(spark, d):
    return segmenter.segment_text(_chapters(spark, d, "text"), ["book_id", "chapter"])


@query("legacy_dash_counts", f"""
WITH {_LC}, l AS (SELECT book_id, unnest({_LINES}) AS line FROM lc), s AS (SELECT book_id, string_split({_strip('line')}, '—')[2:] AS f FROM l WHERE starts_with({_strip('line')}, '—')),
p AS (SELECT book_id, unnest(f) AS frag, generate_subscripts(f, 1) - 1 AS frag_no FROM s)
SELECT book_id, CASE WHEN frag_no % 2 = 0 THEN 'dialogue' ELSE 'narration' END AS type, count(*) AS n FROM p WHERE {_strip('frag')} <> '' GROUP BY 1, 2""")
def legacy_dash_counts(spark, d):
    return segmenter.dash_lines(_chapters(spark, d, "text"), ["book_id"]).groupBy("book_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("segment_context_strings", f"""
WITH {_LS}, w AS (SELECT row_id, type,
 coalesce(array_to_string(list(coalesce(text, '')) OVER (PARTITION BY book_id, chapter ORDER BY seg_order, row_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), chr(10)), '') AS b,
 coalesce(array_to_string(list(coalesce(text, '')) OVER (PARTITION BY book_id, chapter ORDER BY seg_order, row_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), chr(10)), '') AS a FROM ls)
SELECT row_id, CASE WHEN length(b) > 2000 THEN substring(b, length(b) - 1999) ELSE b END AS before, left(a, 2000) AS after FROM w WHERE type IN ('dialogue', 'internal_thought')""")
def segment_context_strings(spark, d):
    return segmenter.context_strings(_segments(spark, d, "chapter", "seg_order", "text", "type"))


@query("emphasis_projection", f"""
WITH {_LS}, e AS (SELECT book_id, chapter, text, unnest(emphasis) AS m FROM ls), g AS (SELECT book_id, chapter, text, string_agg(DISTINCT m, ',' ORDER BY m) AS marks FROM e GROUP BY ALL)
SELECT ls.row_id, coalesce(g.marks, '') AS emphasis FROM ls LEFT JOIN g ON ls.book_id = g.book_id AND ls.chapter = g.chapter AND ls.text = g.text""")
def emphasis_projection(spark, d):
    s = _segments(spark, d, "chapter", "text", "emphasis")
    return segmenter.emphasis_projection(s.drop("emphasis"), s.where(F.size("emphasis") > 0).select("book_id", "chapter", "text", "emphasis"))


@query("page_diagnostics", f"""
WITH {_LC}, t AS (SELECT row_id, coalesce(text, '') AS text FROM lc), l AS (SELECT row_id, text, list_filter(list_transform({_LINES}, lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM t)
SELECT row_id, CAST(len(ls) AS BIGINT) AS lines, CAST(len(list_filter(ls, lambda x: starts_with(x, '—'))) AS BIGINT) AS dash_lines,
 CAST(length(text) - length(replace(replace(text, '"', ''), '“', '')) AS BIGINT) AS double_marks, CAST(length(text) - length(replace(replace(text, chr(39), ''), '‘', '')) AS BIGINT) AS single_marks FROM l""")
def page_diagnostics(spark, d):
    return segmenter.page_diagnostics(_chapters(spark, d, "text"), ["row_id"])


# ---- normalisation, chapters, statistics: C1-C6, C13-C15, D1-D3, F3, A7, A10, A14, A15 -------------------------


def _normal(x: str) -> str:
    gap = _WS.replace(r"\s", r"\t\f\r ")
    x = f"replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"translate(regexp_replace({x}, '[\x{{feff}}\x{{200b}}\x{{2060}}\x{{ad}}]', '', 'g'), chr(160) || '―', ' —')"
    x = rf"regexp_replace(regexp_replace({x}, '{gap}+(\n)', '\1', 'g'), '{gap}+$', '')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g')"
    return _strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query("normalize_documents", f"SELECT doc_id, {_normal('text')} AS text FROM documents")
def normalize_documents(spark, d):
    return spread(table(spark, d, "documents", "doc_id", "text")).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def _heading_sql(x: str) -> str:
    head, numbered, special = T.CHAPTER_HEADING, T.NUMBERED_HEADING, T.SPECIAL_HEADING
    return rf"""(NOT regexp_matches({x}, '\.{{3,}}\s*\d*\s*$') AND (regexp_matches(b, '(?i){head}') OR regexp_matches(b, '{numbered}') OR regexp_matches(b, '(?i){special}')
 OR (length(regexp_replace(b, '[^\p{{L}}]', '', 'g')) >= 2 AND length(b) <= 80 AND len(string_split({_squeeze('b')}, ' ')) <= 10 AND b = upper(b) AND NOT regexp_matches(b, '^[—-]') AND NOT regexp_matches(b, '[.!?;,]$'))))"""


_BARE = rf"CASE WHEN regexp_matches(c, '^\[.*\]$') THEN {_strip("c[2:-2]")} ELSE c END"
_HEADED = f"""
l AS (SELECT KEY, unnest(list_filter(list_transform({_LINES}, lambda x: {_strip('x')}), lambda x: x <> '')) AS block, generate_subscripts(list_filter(list_transform({_LINES}, lambda x: {_strip('x')}), lambda x: x <> ''), 1) - 1 AS pos FROM SRC),
s AS (SELECT *, {_squeeze('block')} AS q FROM l), h0 AS (SELECT *, {_strip(r"regexp_replace(q, '^#{1,6}\s*', '')")} AS c FROM s), h1 AS (SELECT *, {_BARE} AS b FROM h0), h AS (SELECT *, {_heading_sql('q')} AS heading FROM h1)"""


@query("heading_flags", f"WITH {_LC}, {_HEADED.replace('KEY', 'row_id').replace('SRC', 'lc')} SELECT row_id, CAST(pos AS INTEGER) AS pos, block FROM h WHERE heading")
def heading_flags(spark, d):
    blocks = chapters.text_blocks(_chapters(spark, d, "text"), ["row_id"])
    return blocks.where(T.is_chapter_heading(F.col("block")))


@query("text_blocks", f"SELECT doc_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, unnest(f) AS block FROM (SELECT doc_id, list_filter(list_transform({_LINES}, lambda x: {_strip('x')}), lambda x: x <> '') AS f FROM documents)")
def text_blocks(spark, d):
    return chapters.text_blocks(table(spark, d, "documents", "doc_id", "text"), ["doc_id"])


@query("chapters_detected", f"""
WITH {_HEADED.replace('KEY', 'doc_id').replace('SRC', 'documents')}, g AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM h),
p AS (SELECT doc_id, grp, first(block ORDER BY pos) AS head, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS body FROM g GROUP BY doc_id, grp),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS number, max(grp) OVER (PARTITION BY doc_id) AS last FROM p)
SELECT doc_id, CAST(number AS INTEGER) AS number, CASE WHEN grp > 0 THEN head WHEN last = 0 THEN 'Full document' ELSE 'Introduction' END AS title, {_normal('body')} AS text FROM n""")
def chapters_detected(spark, d):
    return chapters.split_chapters(table(spark, d, "documents", "doc_id", "text"), ["doc_id"])


@query("chapters_enriched", f"""WITH d AS ({SQL['chapters_detected']}), s AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM d),
r AS (SELECT *, a + length(text) AS z, 'txt:characters-' || a || '-' || (a + length(text)) AS reference FROM s)
SELECT doc_id, number, a AS start, z AS "end", reference, 'ch_' || left(sha256(concat_ws(':', 'txt', CAST(number AS VARCHAR), reference)), 16) AS chapter_id, CAST(CASE WHEN {_squeeze('text')} = '' THEN 0 ELSE len(string_split({_squeeze('text')}, ' ')) END AS BIGINT) AS words FROM r""")
def chapters_enriched(spark, d):
    return chapters.enrich_chapters(chapters_detected(spark, d), "doc_id")


@query("chapter_word_counts", f"WITH {_LC} SELECT row_id, CAST(CASE WHEN {_squeeze('text')} = '' THEN 0 ELSE len(string_split({_squeeze('text')}, ' ')) END AS BIGINT) AS words FROM lc")
def chapter_word_counts(spark, d):
    return _chapters(spark, d, "text").select("row_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query("chapter_ids", f"WITH {_LC} SELECT row_id, 'ch_' || left(sha256(concat_ws(':', 'txt', CAST(chapter AS VARCHAR), source_reference)), 16) AS new_id FROM lc")
def chapter_ids(spark, d):
    return _chapters(spark, d, "source_reference").select("row_id", T.chapter_id(F.lit("txt"), F.col("chapter"), F.col("source_reference")).alias("new_id"))


_STATS = f"""WITH {_LC}, s AS (SELECT book_id, count(*) AS chapters, count(*) FILTER (selected_for_processing AND narrate) AS selected_chapters, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS total_words,
 CAST(coalesce(sum(coalesce(word_count, 0)) FILTER (selected_for_processing AND narrate), 0) AS BIGINT) AS selected_words FROM lc GROUP BY book_id),
f AS (SELECT *, round_even(selected_words / 160.0, 1) AS minutes, CASE WHEN selected_words < 10000 THEN 'Small' WHEN selected_words < 50000 THEN 'Medium' WHEN selected_words < 150000 THEN 'Large' ELSE 'Very large' END AS size_category FROM s)"""


@query("book_statistics", _STATS + " SELECT * FROM f")
def book_statistics(spark, d):
    return chapters.book_statistics(_chapters(spark, d, "selected_for_processing", "narrate", "word_count"))


@query("size_categories", _STATS + " SELECT size_category, count(*) AS books, CAST(sum(selected_words) AS BIGINT) AS words FROM f GROUP BY size_category")
def size_categories(spark, d):
    return book_statistics(spark, d).groupBy("size_category").agg(F.count(F.lit(1)).alias("books"), F.sum("selected_words").alias("words"))


@query("chapter_selection_range", f"WITH {_LC}, w AS (SELECT DISTINCT unnest(generate_series(a, b)) AS n FROM (VALUES (1, 10), (25, 25), (100, 150)) v(a, b)) SELECT row_id, book_id, chapter FROM lc JOIN w ON chapter = n")
def chapter_selection_range(spark, d):
    return chapters.select_range(_chapters(spark, d), "1-10,25,100-150").select("row_id", "book_id", "chapter")


@query("chapter_search", f"WITH {_LC} SELECT row_id, title FROM lc WHERE contains(lower(coalesce(title, '')), '12') OR CAST(chapter AS VARCHAR) = '12'")
def chapter_search(spark, d):
    return chapters.search(_chapters(spark, d, "title"), "12").select("row_id", "title")


@query("manifest_problems", f"""WITH {_LC}, s AS (SELECT book_id, chapter_id FROM lc GROUP BY book_id, chapter_id HAVING count(DISTINCT chapter) > 1)
SELECT * FROM (SELECT row_id, CASE WHEN NOT coalesce(regexp_matches(chapter_id, '^ch_[0-9a-f]{{16}}$'), false) THEN 'id' WHEN EXISTS (SELECT 1 FROM s WHERE s.book_id = lc.book_id AND s.chapter_id = lc.chapter_id) THEN 'shared id' WHEN chapter < 1 THEN 'number' END AS problem FROM lc) WHERE problem IS NOT NULL""")
def manifest_problems(spark, d):
    return chapters.manifest_problems(_chapters(spark, d, "chapter_id"))


@query("section_kinds", f"WITH {_LC}, v AS (SELECT row_id, lower(concat_ws(' ', title, source_reference, section_kind)) AS v FROM lc) SELECT row_id, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(v, '{w}')''' for w in words)} THEN '{kind}'" for kind, words in T.SECTION_KINDS) + " END AS kind FROM v")
def section_kinds(spark, d):
    return _chapters(spark, d, "title", "source_reference", "section_kind").select("row_id", T.section_kind(F.concat_ws(" ", "title", "source_reference", "section_kind")).alias("kind"))


def _slug(x: str, fallback: str) -> str:
    slug = rf"regexp_replace(regexp_replace(regexp_replace({_key(x)}, '[^\x00-\x7f]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')"
    return f"CASE WHEN coalesce({slug}, '') = '' THEN '{fallback}' ELSE lower(left({slug}, 80)) END"


@query("safe_filenames", f"SELECT book_id, {_slug('title', 'untitled')} AS slug FROM books")
def safe_filenames(spark, d):
    return table(spark, d, "books").select("book_id", T.safe_filename(F.col("title")).alias("slug"))


@query("upload_names", rf"""WITH b AS (SELECT book_id, regexp_extract(replace(source_path, chr(92), '/'), '([^/]*)$', 1) AS base FROM books), x AS (SELECT *, lower(regexp_extract(base, '\.([^.]*)$', 1)) AS suffix, regexp_replace(base, '\.[^.]*$', '') AS stem FROM b)
SELECT book_id, CASE WHEN suffix IN ('txt', 'pdf', 'docx', 'epub') THEN {_slug('stem', 'document')} || '.' || suffix END AS name FROM x""")
def upload_names(spark, d):
    return table(spark, d, "books").select("book_id", T.upload_name(F.col("source_path")).alias("name"))


@query("chapter_file_names", f"WITH {_LC} SELECT row_id, printf('%02d_', chapter) || 'chapter.wav' AS file FROM lc")
def chapter_file_names(spark, d):
    return _chapters(spark, d).select("row_id", F.concat(F.format_string("%02d_", "chapter"), F.lit("chapter.wav")).alias("file"))


@query("safe_members", "SELECT book_id, source_path <> '' AND NOT contains(source_path, '\\') AND NOT contains(source_path, ':') AND NOT starts_with(source_path, '/') AND NOT regexp_matches(source_path, '(^|/)\\.\\.(/|$)') AS safe FROM books")
def safe_members(spark, d):
    return table(spark, d, "books").select("book_id", T.safe_member(F.col("source_path")).alias("safe"))


# ---- context and attribution: G1-G4, G6, C12, C16, D10-D12, L1, F4 ---------------------------------------------


_SCENE = f"{_LS}, sc AS (SELECT *, CAST(sum(CAST(coalesce(scene_break_before, false) AS INT)) OVER (PARTITION BY book_id, chapter ORDER BY seg_order, row_id) AS BIGINT) AS scene_id FROM ls)"


@query("scene_ids", f"WITH {_SCENE} SELECT row_id, scene_id FROM sc")
def scene_ids(spark, d):
    return context.with_scenes(_segments(spark, d, "chapter", "seg_order", "scene_break_before")).select("row_id", "scene_id")


@query("context_before_after", f"""WITH {_SCENE}, w AS (SELECT row_id,
 list(type || '|' || coalesce(speaker, '') || '|' || coalesce(text, '')) OVER (PARTITION BY book_id, chapter, scene_id ORDER BY seg_order, row_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b,
 list(type || '|' || CASE WHEN type = 'narration' THEN 'Narrator' ELSE 'Unknown' END || '|' || coalesce(text, '')) OVER (PARTITION BY book_id, chapter, scene_id ORDER BY seg_order, row_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a FROM sc)
SELECT row_id, coalesce(array_to_string(b, chr(10)), '') AS before, coalesce(array_to_string(a, chr(10)), '') AS after FROM w""")
def context_before_after(spark, d):
    rows = context.context_windows(_segments(spark, d, *_FULL))
    flat = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x.type, F.lit("|"), F.coalesce(x.speaker, F.lit("")), F.lit("|"), x.text)), "\n")
    return rows.select("row_id", flat("before").alias("before"), flat("after").alias("after"))


def _re2(p: str) -> str:
    return p.replace("(?iu:", "(?i:").replace("'", "''")


def _rule_sql(part: str) -> str:
    found = lambda x, p: f"nullif(regexp_extract({x}, '{_re2(p)}', 1), '')"
    no = ", ".join(f"'{x}'" for x in context.NO_NAMES)
    return f"""ru0 AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lead(type) OVER w AS nt, lead(text) OVER w AS nx FROM sc WINDOW w AS (PARTITION BY {part} ORDER BY seg_order, row_id)),
ru1 AS (SELECT *, {found('px', context.THOUGHT)} AS th, coalesce(CASE WHEN nt = 'narration' THEN {found('nx', context.AFTER)} END, CASE WHEN pt = 'narration' THEN {found('px', context.BEFORE)} END) AS sp, {found('text', context.SELF)} AS me FROM ru0),
ru AS (SELECT *, CASE type WHEN 'internal_thought' THEN CASE WHEN th NOT IN ('La', 'El', 'Una', 'Un') THEN th END WHEN 'dialogue' THEN coalesce(me, CASE WHEN sp NOT IN ({no}) THEN sp END) END AS rule_speaker FROM ru1)"""


@query("rule_attribution", f"WITH {_SCENE}, {_rule_sql('book_id, chapter, scene_id')} SELECT row_id, rule_speaker FROM ru WHERE rule_speaker IS NOT NULL")
def rule_attribution(spark, d):
    return context.rule_speaker(_segments(spark, d, *_FULL)).where("rule_speaker IS NOT NULL").select("row_id", "rule_speaker")


@query("rule_resolution_percent", f"""WITH {_SCENE}, {_rule_sql('book_id, chapter')}, s AS (SELECT book_id, count(*) FILTER (type = 'dialogue') AS dialogues, count(*) FILTER (type = 'internal_thought') AS thoughts, count(*) AS segments, count(rule_speaker) AS explicit FROM ru GROUP BY book_id)
SELECT *, CAST(round_even(explicit * 100.0 / greatest(dialogues + thoughts, 1), 0) AS BIGINT) AS percent, dialogues + thoughts - explicit AS remote_calls FROM s""")
def rule_resolution_percent(spark, d):
    return context.rule_percent(_segments(spark, d, *_FULL))


_PREV = f"""{_SCENE}, pv AS (SELECT *, list({{'t': type, 's': speaker, 'c': scene_id}}) OVER (PARTITION BY book_id, chapter ORDER BY seg_order, row_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS near,
 coalesce(bool_or(coalesce(scene_break_before, false)) OVER (PARTITION BY book_id, chapter ORDER BY seg_order, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS broken,
 list({{'t': type, 'x': coalesce(text, '')}}) OVER (PARTITION BY book_id, chapter, scene_id ORDER BY seg_order, row_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS bf FROM sc),
pp AS (SELECT *, coalesce(CASE WHEN broken THEN list_transform(list_filter(near[-4:], lambda x: x.t = 'dialogue' AND x.s IS NOT NULL AND x.s NOT IN ('Narrator', 'Unknown') AND x.c = scene_id), lambda x: x.s)
 ELSE list_transform(list_filter(near, lambda x: x.t = 'dialogue' AND x.s IS NOT NULL AND x.s NOT IN ('Narrator', 'Unknown')), lambda x: x.s) END, []) AS previous FROM pv)"""


@query("previous_speakers", f"WITH {_PREV} SELECT row_id, array_to_string(previous, '|') AS previous FROM pp WHERE type IN ('dialogue', 'internal_thought')")
def previous_speakers(spark, d):
    rows = context.previous_speakers(_segments(spark, d, *_FULL)).where(is_speech(F.col("type")))
    return rows.select("row_id", F.array_join("previous", "|").alias("previous"))


@query("alternation_candidates", f"""WITH {_PREV} SELECT row_id, previous[-2] AS speaker_by_turn FROM pp WHERE type = 'dialogue' AND len(previous) >= 3 AND previous[-3] = previous[-1] AND previous[-3] <> previous[-2] AND length(text) <= 220
 AND len(list_filter(coalesce(bf, []), lambda x: x.t = 'narration' AND NOT regexp_matches(lower(ltrim(x.x)), '^(?:dijo|respondió|preguntó|contestó|replicó)'))) = 0""")
def alternation_candidates(spark, d):
    return context.alternation(_segments(spark, d, *_FULL))


@query("confidence_policy", f"""WITH {_LS}, p AS (SELECT *, coalesce(speaker IS NOT NULL AND speaker NOT IN ('Narrator', 'Unknown') AND confidence >= 0.60, false) AS usable FROM ls),
q AS (SELECT *, CASE WHEN usable AND new_character_candidate IS NULL THEN speaker ELSE 'Unknown' END AS decided, CASE WHEN usable AND new_character_candidate IS NOT NULL THEN speaker END AS candidate FROM p)
SELECT row_id, decided, candidate, decided = 'Unknown' OR confidence IS NULL OR confidence < 0.85 AS review FROM q""")
def confidence_policy(spark, d):
    return context.confidence_policy(_segments(spark, d, "speaker", "confidence", "new_character_candidate")).select("row_id", "decided", "candidate", "review")


@query("llm_response_validation", f"""WITH {_LS}, a AS (SELECT row_id, trim(speaker) AS s, CASE WHEN row_id % 7 = 0 THEN confidence + 1 ELSE confidence END AS c FROM ls)
SELECT row_id, s AS speaker, c AS confidence FROM a WHERE s <> '' AND length(s) <= 100 AND c BETWEEN 0 AND 1""")
def llm_response_validation(spark, d):
    # Every seventh answer is out of range, so that the refusal shows.
    conf = F.when(F.col("row_id") % 7 == 0, F.col("confidence") + 1).otherwise(F.col("confidence"))
    answers = _segments(spark, d, "speaker", "confidence").select("row_id", F.to_json(F.struct("speaker", conf.alias("confidence"), F.lit(False).alias("is_new_character"))).alias("j"))
    return answers.select("row_id", context.validated_response(F.col("j")).alias("r")).where("r IS NOT NULL").select("row_id", "r.speaker", "r.confidence")


# ---- characters: E1, E2, E8, F5, F6, F13, G5, G12, H3, L3, L13 -------------------------------------------------


_NAMES = f"""{_LP}, pr AS (SELECT book_id, char_id, canonical_name, coalesce(first_seen_chapter, 0) AS seen FROM lp), la AS (SELECT DISTINCT book_id, char_id, name, known_from_chapter FROM aliases WHERE char_id IS NOT NULL),
nn AS (SELECT book_id, char_id, canonical_name, {_key('canonical_name')} AS key, seen AS known_from FROM pr UNION ALL SELECT la.book_id, la.char_id, pr.canonical_name, {_key('la.name')}, greatest(coalesce(la.known_from_chapter, 1), pr.seen) FROM la JOIN pr ON la.book_id = pr.book_id AND la.char_id = pr.char_id),
nt AS (SELECT book_id, char_id, canonical_name, key, min(known_from) AS known_from FROM nn GROUP BY ALL)"""
_ASOF = f"lk AS (SELECT ls.row_id, min(nt.char_id) AS char_id FROM ls LEFT JOIN nt ON nt.book_id = ls.book_id AND nt.key = {_key('ls.speaker')} AND nt.known_from <= greatest(ls.chapter, 1) WHERE ls.speaker IS NOT NULL AND ls.speaker NOT IN ('Narrator', 'Unknown') GROUP BY ls.row_id)"
_W = r"[\p{L}\p{N}_]"
_MENTION = f"""tx AS (SELECT row_id, book_id, greatest(chapter, 1) AS ch, {_key('text')} AS k FROM ls WHERE text IS NOT NULL),
ca AS (SELECT DISTINCT tx.row_id, tx.book_id, nt.char_id, tx.k, nt.key FROM tx JOIN nt ON nt.book_id = tx.book_id AND nt.key <> '' AND nt.known_from <= tx.ch AND contains(tx.k, nt.key)),
po AS (SELECT *, unnest(generate_series(1, length(k) - length(key) + 1)) AS s FROM ca),
hi AS (SELECT DISTINCT row_id, book_id, char_id, s, s + length(key) AS e FROM po WHERE substring(k, s, length(key)) = key AND NOT (s > 1 AND regexp_matches(substring(k, s - 1, 1), '{_W}')) AND NOT regexp_matches(substring(k, s + length(key), 1), '{_W}')),
li AS (SELECT row_id, book_id, char_id, list({{'s': s, 'e': e, 'n': CAST(0 AS BIGINT)}} ORDER BY s, e DESC) AS h FROM hi GROUP BY ALL),
me AS (SELECT book_id, row_id, char_id, list_reduce(h, lambda a, x: CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'n': a.n + 1}} ELSE a END, {{'s': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}}).n AS n FROM li)"""
_EVENTS = f"""{_LS}, {_NAMES}, {_ASOF}, {_MENTION}, ev0 AS (SELECT lk.row_id, lk.char_id, CAST(ls.type = 'dialogue' AS BIGINT) AS said, 0 AS mentioned FROM lk JOIN ls USING (row_id) WHERE lk.char_id IS NOT NULL AND ls.type IN ('dialogue', 'internal_thought') UNION ALL SELECT row_id, char_id, 0, n FROM me),
ev AS (SELECT e.row_id, e.char_id, max(said) AS said, CAST(sum(mentioned) AS BIGINT) AS mentioned, any_value(ls.book_id) AS book_id, any_value(greatest(ls.chapter, 1)) AS chapter, any_value(ls.seg_order) AS seg_order FROM ev0 e JOIN ls USING (row_id) GROUP BY e.row_id, e.char_id)"""


def _names(spark, d):
    return characters.names_over_time(_people(spark, d), table(spark, d, "aliases", "book_id", "char_id", "name", "known_from_chapter").distinct())


@query("alias_visibility_by_chapter", f"WITH {_NAMES} SELECT book_id, known_from, count(*) AS names FROM nt GROUP BY book_id, known_from")
def alias_visibility(spark, d):
    return _names(spark, d).groupBy("book_id", "known_from").agg(F.count(F.lit(1)).alias("names"))


@query("alias_asof_lookup", f"WITH {_LS}, {_NAMES}, {_ASOF} SELECT * FROM lk")
def alias_asof_lookup(spark, d):
    return characters.alias_lookup(_segments(spark, d, "chapter", "speaker"), _names(spark, d))


@query("mention_counts", f"WITH {_LS}, {_NAMES}, {_MENTION} SELECT * FROM me")
def mention_counts(spark, d):
    return characters.mentions(_segments(spark, d, "chapter", "text"), _names(spark, d))


def _events(spark, d):
    return cut(characters.activity_events(_segments(spark, d, "chapter", "text", "type", "speaker", "seg_order"), cut(_names(spark, d))))


@query("character_stats", f"""WITH {_EVENTS}, a AS (SELECT book_id, char_id, CAST(sum(said) AS BIGINT) AS dialogue_count, CAST(sum(mentioned) AS BIGINT) AS mention_count, string_agg(DISTINCT chapter, ',' ORDER BY chapter) AS chapters, min(chapter) AS first_chapter, max(chapter) AS last_chapter FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id, char_id ORDER BY chapter DESC, seg_order DESC) AS k FROM ev), t AS (SELECT book_id, char_id, string_agg(seg_order, ',' ORDER BY chapter, seg_order) AS activity FROM r WHERE k <= 64 GROUP BY ALL)
SELECT a.*, t.activity FROM a JOIN t USING (book_id, char_id)""")
def character_stats(spark, d):
    s = characters.character_statistics(_events(spark, d))
    return s.withColumn("chapters", F.array_join(F.col("chapters").cast("array<string>"), ",")).withColumn("activity", F.array_join(F.transform("activity", lambda x: x.seg_order.cast("string")), ","))


@query("character_importance", f"""WITH {_EVENTS}, a AS (SELECT book_id, char_id, sum(said) AS x, sum(mentioned) AS m, count(DISTINCT chapter) AS c FROM ev GROUP BY ALL)
SELECT lp.book_id, lp.char_id, CASE WHEN lp.pending THEN 'unknown' WHEN x >= 30 OR (c >= 5 AND x >= 10) THEN 'major' WHEN x >= 5 OR c >= 3 OR m >= 20 THEN 'supporting' WHEN x > 0 OR m > 0 THEN 'minor' ELSE 'unknown' END AS importance FROM lp LEFT JOIN a USING (book_id, char_id)""")
def character_importance(spark, d):
    s = characters.character_statistics(_events(spark, d)).select("book_id", "char_id", "dialogue_count", "mention_count", F.size("chapters").alias("n"))
    both = _people(spark, d).select("book_id", "char_id", "pending").join(s, ["book_id", "char_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("book_id", "char_id", characters.importance(zero("dialogue_count"), zero("mention_count"), zero("n"), F.coalesce("pending", F.lit(False))).alias("importance"))


@query("active_characters", f"""WITH {_EVENTS}, kn AS (SELECT book_id, char_id, canonical_name AS name FROM lp WHERE canonical_name <> 'Narrator' AND NOT coalesce(pending, false)), r AS (SELECT DISTINCT book_id, chapter, seg_order FROM ev),
lt AS (SELECT r.book_id, r.chapter, r.seg_order AS "at", kn.name, max(e.seg_order) AS last FROM r JOIN ev e ON e.book_id = r.book_id AND e.chapter = r.chapter AND e.seg_order BETWEEN r.seg_order - 12 AND r.seg_order JOIN kn ON kn.book_id = e.book_id AND kn.char_id = e.char_id GROUP BY ALL)
SELECT book_id, chapter, "at", string_agg(name, '|' ORDER BY last DESC, name DESC) AS active FROM lt GROUP BY ALL""")
def active_characters(spark, d):
    rows = characters.active_ranked(_events(spark, d), _people(spark, d))
    return rows.withColumn("active", F.array_join("active", "|"))


@query("candidate_scores_topk", f"""WITH {_SCENE}, {_NAMES}, {_ASOF}, {_MENTION}, rw AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter, scene_id ORDER BY seg_order, row_id) AS pl FROM sc),
e0 AS (SELECT rw.book_id, chapter, scene_id, pl, seg_order, me.char_id, CAST(me.n AS DOUBLE) AS m, 0.0 AS s FROM me JOIN rw USING (row_id) UNION ALL
 SELECT rw.book_id, chapter, scene_id, pl, seg_order, lk.char_id, 0.0, CASE WHEN type = 'dialogue' THEN 1.0 ELSE 0.0 END FROM lk JOIN rw USING (row_id) WHERE lk.char_id IS NOT NULL AND type IN ('dialogue', 'internal_thought')),
e AS (SELECT book_id, chapter, scene_id, pl, seg_order, char_id, sum(m) AS m, max(s) AS s FROM e0 GROUP BY ALL),
sp AS (SELECT * FROM rw WHERE type IN ('dialogue', 'internal_thought')),
nr AS (SELECT r.row_id, r.book_id, r.chapter, e.char_id, round(CASE WHEN e.pl < r.pl THEN e.m * 4.0 / (r.pl - e.pl) + e.s * 2.0 ELSE e.m * 2.0 END, 6) AS score FROM sp r JOIN e ON e.book_id = r.book_id AND e.chapter = r.chapter AND e.scene_id = r.scene_id AND e.pl BETWEEN r.pl - 4 AND r.pl + 4 AND e.pl <> r.pl
 UNION ALL SELECT DISTINCT r.row_id, r.book_id, r.chapter, e.char_id, 1.0 FROM sp r JOIN e ON e.book_id = r.book_id AND e.chapter = r.chapter AND e.seg_order < r.seg_order AND r.seg_order - e.seg_order <= 12),
su AS (SELECT row_id, book_id, chapter, char_id, sum(score) AS score FROM nr GROUP BY ALL HAVING sum(score) > 0),
ra AS (SELECT su.row_id, lp.canonical_name AS name, round(su.score, 4) AS score, row_number() OVER (PARTITION BY su.row_id ORDER BY round(su.score, 4) DESC, lp.canonical_name, su.char_id) AS rank FROM su JOIN lp ON lp.book_id = su.book_id AND lp.char_id = su.char_id WHERE NOT coalesce(lp.pending, false) AND lp.canonical_name NOT IN ('Narrator', 'Unknown') AND coalesce(lp.first_seen_chapter, 0) <= greatest(su.chapter, 1))
SELECT row_id, CAST(rank AS INTEGER) AS rank, name, CAST(score AS DOUBLE) AS score FROM ra WHERE rank <= 6""")
def candidate_scores_topk(spark, d):
    return _candidates(spark, d).select("row_id", "rank", "name", "score")


def _candidates(spark, d):
    return characters.candidate_scores(_segments(spark, d, *_FULL), cut(_names(spark, d)), _people(spark, d))


_IDENTITY = SQL["candidate_scores_topk"].rsplit("\nSELECT", 1)[0].replace("SELECT su.row_id, lp.canonical_name AS name,", "SELECT su.row_id, su.book_id, su.chapter, su.char_id, lp.canonical_name AS name,") + f""",
ck AS (SELECT ra.row_id, ra.rank, ra.name, ra.char_id, nt.key, nt.known_from, nt.key <> {_key('nt.canonical_name')} AS al FROM ra JOIN nt ON nt.book_id = ra.book_id AND nt.char_id = ra.char_id AND nt.known_from <= greatest(ra.chapter, 1) WHERE ra.rank <= 6),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, char_id, al ORDER BY known_from, key) AS k FROM ck) WHERE NOT al OR k <= 3)"""


@query("candidate_aliases", _IDENTITY + " SELECT row_id, string_agg(key || '=' || name || '@' || known_from, '|' ORDER BY rank, known_from, key) AS aliases FROM cl WHERE al GROUP BY row_id")
def candidate_aliases(spark, d):
    rows = characters.candidate_identities(cut(_candidates(spark, d)), _names(spark, d)).where(F.size("aliases") > 0)
    return rows.select("row_id", F.array_join(F.transform("aliases", lambda x: F.concat(x["alias"], F.lit("="), x["name"], F.lit("@"), x.chapter.cast("string"))), "|").alias("aliases"))


@query("answers_accepted", _IDENTITY + f""", id AS (SELECT row_id, key, arg_min(name, (NOT al, rank)) AS name FROM cl GROUP BY row_id, key),
wi AS (SELECT *, coalesce(array_to_string(list(coalesce(text, '')) OVER (PARTITION BY book_id, chapter, scene_id ORDER BY seg_order, row_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), ' '), '') AS w FROM sc),
an AS (SELECT row_id, trim(speaker) AS s, new_character_candidate IS NOT NULL AS nw, w FROM wi WHERE type IN ('dialogue', 'internal_thought') AND trim(speaker) <> '' AND length(trim(speaker)) <= 100 AND confidence BETWEEN 0 AND 1),
aj AS (SELECT an.*, coalesce((SELECT id.name FROM id WHERE id.row_id = an.row_id AND id.key = {_key('an.s')}), s) AS c FROM an)
SELECT row_id, CASE WHEN nw THEN s ELSE c END AS accepted FROM aj WHERE (nw AND NOT EXISTS (SELECT 1 FROM ra WHERE ra.row_id = aj.row_id AND ra.rank <= 6 AND ra.name = s) AND contains({_key('w')}, {_key('s')}))
 OR (NOT nw AND (c = 'Unknown' OR EXISTS (SELECT 1 FROM ra WHERE ra.row_id = aj.row_id AND ra.rank <= 6 AND ra.name = c)))""")
def answers_accepted(spark, d):
    """Answers as delivered, as JSON, through validation and the test against candidates and text."""
    s = _segments(spark, d, *_FULL)
    raw = s.where(is_speech(F.col("type"))).select("row_id", F.to_json(F.struct("speaker", "confidence", F.col("new_character_candidate").isNotNull().alias("is_new_character"))).alias("j"))
    valid = raw.select("row_id", context.validated_response(F.col("j")).alias("answer")).where("answer IS NOT NULL")
    return context.accepted_answers(valid, s, characters.candidate_identities(cut(_candidates(spark, d)), _names(spark, d)), T.name_key)


@query("prompts_rendered")
def prompts_rendered(spark, d):
    known = characters.candidate_identities(cut(_candidates(spark, d)), _names(spark, d))
    return context.render_prompt(_segments(spark, d, *_FULL), known).select("row_id", F.sha2("prompt", 256).alias("prompt_hash"), F.length("prompt").alias("n_chars"))


@query("duplicate_pairs_token", f"""WITH {_LP}, p AS (SELECT book_id, char_id, {_key('canonical_name')} AS key FROM lp WHERE canonical_name <> 'Narrator'), w AS (SELECT DISTINCT book_id, char_id, unnest(string_split(key, ' ')) AS word FROM p)
SELECT DISTINCT p.book_id, least(p.char_id, w.char_id) AS left_id, greatest(p.char_id, w.char_id) AS right_id FROM p JOIN w ON p.book_id = w.book_id AND p.key = w.word AND p.char_id <> w.char_id""")
def duplicate_pairs_token(spark, d):
    return characters.duplicate_tokens(_people(spark, d))


@query("duplicate_pairs_ratio")
def duplicate_pairs_ratio(spark, d):
    return characters.duplicate_ratio(_people(spark, d))


_HINTS = f"""hn AS (SELECT book_id, chapter, regexp_extract(text, '^(.*?){characters.ALIAS_PHRASE}', ['head', 'alias']) AS m FROM ls WHERE type = 'narration'),
al AS (SELECT hn.book_id, c.char_id, m.alias AS alias, min(hn.chapter) AS known_from FROM hn JOIN (SELECT DISTINCT book_id, char_id, canonical_name FROM characters WHERE canonical_name <> '') c ON c.book_id = hn.book_id AND m.alias <> '' AND ends_with(m.head, c.canonical_name) GROUP BY ALL)"""


def _evidence(spark, d):
    return characters.alias_evidence(_segments(spark, d, "type", "text", "chapter"), table(spark, d, "characters", "book_id", "char_id", "canonical_name"))


@query("alias_evidence", f"WITH {_LS}, {_HINTS} SELECT * FROM al")
def alias_evidence(spark, d):
    return _evidence(spark, d)


@query("duplicate_pairs_alias", f"""WITH {_LS}, {_HINTS}, {_NAMES}, ot AS (SELECT book_id, key, min(char_id) AS right_id FROM nt GROUP BY ALL), lf AS (SELECT DISTINCT book_id, char_id AS left_id, {_key('alias')} AS key FROM al)
SELECT DISTINCT lf.book_id, lf.left_id, ot.right_id FROM lf JOIN ot ON ot.book_id = lf.book_id AND ot.key = lf.key AND left_id <> right_id WHERE NOT EXISTS (SELECT 1 FROM lp WHERE lp.book_id = lf.book_id AND lp.char_id = lf.left_id AND lp.canonical_name = 'Narrator')""")
def duplicate_pairs_alias(spark, d):
    return characters.duplicate_aliases(_evidence(spark, d), _names(spark, d), _people(spark, d))


_FIRST = f"{_LS}, fa AS (SELECT book_id, speaker, min((seg_order, row_id)) AS f, 1 AS o FROM ls WHERE speaker IS NOT NULL AND speaker <> 'Narrator' GROUP BY ALL UNION ALL SELECT DISTINCT book_id, 'Narrator', NULL, 0 FROM ls), fp AS (SELECT book_id, speaker, CAST(row_number() OVER (PARTITION BY book_id ORDER BY o, f) - 1 AS INTEGER) AS position FROM fa)"


@query("collected_speakers", f"WITH {_FIRST} SELECT * FROM fp")
def collected_speakers(spark, d):
    return characters.first_appearance(_segments(spark, d, "speaker", "seg_order"))


@query("rebuilt_profiles", f"""WITH {_FIRST}, n AS (SELECT book_id, speaker, row_number() OVER (PARTITION BY book_id ORDER BY position) AS k FROM fp WHERE speaker <> 'Unknown')
SELECT n.book_id, printf('char_%06d', k) AS char_id, n.speaker AS canonical_name, (SELECT min(chapter) FROM ls WHERE ls.book_id = n.book_id AND ls.speaker = n.speaker AND ls.speaker NOT IN ('Narrator', 'Unknown')) AS first_seen_chapter FROM n""")
def rebuilt_profiles(spark, d):
    return characters.rebuild_profiles(_segments(spark, d, "speaker", "seg_order", "chapter"))


@query("evidence_window", f"WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, char_id ORDER BY seg_order DESC, row_id DESC) AS k FROM ev) SELECT book_id, char_id, count(*) AS rows, min(seg_order) AS from_order, max(seg_order) AS to_order FROM r WHERE k <= 8 GROUP BY ALL HAVING count(*) >= 3")
def evidence_window(spark, d):
    return characters.evidence_window(_events(spark, d))


@query("resolve_speakers_fold")
def resolve_speakers_fold(spark, d):
    return fold.resolve_speakers(_segments(spark, d, *_FULL))


@query("reanalyze_open")
def reanalyze_open(spark, d):
    return fold.reanalyze(_segments(spark, d, *_FULL), review_too=True)


# ---- review: D4-D8, F1, F2, F8, F9, F12, H1, H2, E7 --------------------------------------------------------------


_ORDER = "coalesce(review_needed, false) DESC, coalesce(confidence, -1), seg_order, row_id"


@query("review_page", f"""WITH {_LS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) AS place, count(*) OVER (PARTITION BY book_id) AS t FROM ls WHERE type IN ('dialogue', 'internal_thought'))
SELECT book_id, row_id, CAST(place AS INTEGER) AS place FROM r WHERE ceil(place / 50.0) = least(2, greatest(1, ceil(t / 50.0)))""")
def review_page(spark, d):
    rows = review.filter_issue(_segments(spark, d, "type", "review_needed", "confidence", "seg_order"), "all")
    return review.page(rows, 2).select("book_id", "row_id", "place")


@query("review_issue_counts", f"""WITH {_LS}, s AS (SELECT * FROM ls WHERE type IN ('dialogue', 'internal_thought'))
SELECT book_id, count(*) FILTER (speaker = 'Unknown') AS unresolved, count(*) FILTER (confidence < 0.85) AS low_confidence, count(new_character_candidate) AS new_characters FROM s GROUP BY book_id""")
def review_issue_counts(spark, d):
    rows = review.filter_issue(_segments(spark, d, "type", "speaker", "confidence", "new_character_candidate"), "all")
    return rows.groupBy("book_id").agg(F.count_if(F.col("speaker") == "Unknown").alias("unresolved"), F.count_if(review.confidence() < review.ACCEPT).alias("low_confidence"), F.count("new_character_candidate").alias("new_characters"))


@query("review_duplicates", f"""WITH {_LS}, {_LP}, p AS (SELECT book_id, char_id, canonical_name, {_key('canonical_name')} AS key FROM lp WHERE canonical_name <> 'Narrator'), w AS (SELECT DISTINCT book_id, char_id, unnest(string_split(key, ' ')) AS word FROM p),
q AS (SELECT DISTINCT p.book_id, p.char_id AS a, w.char_id AS b FROM p JOIN w ON p.book_id = w.book_id AND p.key = w.word AND p.char_id <> w.char_id), n AS (SELECT DISTINCT p.book_id, p.canonical_name AS speaker FROM p JOIN q ON p.book_id = q.book_id AND p.char_id IN (q.a, q.b))
SELECT row_id FROM ls WHERE type IN ('dialogue', 'internal_thought') AND EXISTS (SELECT 1 FROM n WHERE n.book_id = ls.book_id AND n.speaker = ls.speaker)""")
def review_duplicates(spark, d):
    people = _people(spark, d)
    pairs = characters.duplicate_tokens(people)
    ids = pairs.select("book_id", F.explode(F.array("left_id", "right_id")).alias("char_id")).distinct()
    doubles = people.join(ids, ["book_id", "char_id"], "left_semi").select("book_id", F.col("canonical_name").alias("speaker")).distinct()
    return review.filter_issue(_segments(spark, d, "type", "speaker"), "duplicates", doubles).select("row_id")


@query("speaker_filter", f"WITH {_LS} SELECT row_id, speaker FROM ls WHERE {_key('speaker')} = 'isabel marlosa'")
def speaker_filter(spark, d):
    return review.filter_speaker(_segments(spark, d, "speaker", "type"), "ISABEL MARLOSA").select("row_id", "speaker")


_METRICS = f"""WITH {_LS}, {_LP}, s AS (SELECT book_id, count(*) FILTER (type = 'narration') AS narration, count(*) FILTER (type = 'dialogue') AS dialogue, count(*) FILTER (type = 'internal_thought') AS thought,
 count(*) FILTER (type = 'dialogue' AND speaker NOT IN ('Unknown', 'Narrator')) AS resolved, count(*) FILTER (type = 'dialogue' AND speaker IN ('Unknown', 'Narrator')) AS unresolved,
 count(*) FILTER (type IN ('dialogue', 'internal_thought') AND resolution_method IN ('rule', 'conversation', 'candidate')) AS by_rule, count(*) FILTER (type IN ('dialogue', 'internal_thought') AND resolution_method = 'llm' AND speaker <> 'Unknown') AS by_model,
 count(*) FILTER (type IN ('dialogue', 'internal_thought') AND resolution_method = 'manual') AS by_hand, count(*) FILTER (type IN ('dialogue', 'internal_thought') AND speaker = 'Unknown') AS unknown, count(*) FILTER (type IN ('dialogue', 'internal_thought') AND confidence < 0.85) AS low_confidence FROM ls GROUP BY book_id),
c AS (SELECT book_id, count(*) AS profiles, count(*) FILTER (NOT coalesce(pending, false)) AS detected, count(*) FILTER (importance = 'major') AS major, count(*) FILTER (importance = 'supporting') AS supporting, count(*) FILTER (importance = 'minor') AS minor FROM lp WHERE canonical_name <> 'Narrator' GROUP BY book_id)"""


@query("character_metrics", _METRICS + " SELECT s.*, coalesce(profiles, 0) AS profiles, coalesce(detected, 0) AS detected, coalesce(major, 0) AS major, coalesce(supporting, 0) AS supporting, coalesce(minor, 0) AS minor FROM s LEFT JOIN c USING (book_id)")
def character_metrics(spark, d):
    return review.character_metrics(_segments(spark, d, *_FULL), _people(spark, d))


@query("analysis_warnings", _METRICS + " SELECT s.book_id, 'no characters' AS warnings FROM s LEFT JOIN c USING (book_id) WHERE dialogue > 0 AND coalesce(detected, 0) = 0")
def analysis_warnings(spark, d):
    return review.analysis_warnings(character_metrics(spark, d))


@query("book_status", f"WITH {_LC} SELECT book_id, count(*) FILTER (status <> 'not_analyzed') AS analyzed, count(*) FILTER (status = 'completed') AS completed, coalesce(bool_or(status IN ('analyzing', 'generating_audio')), false) AS busy, coalesce(bool_or(status = 'failed'), false) AS failed FROM lc GROUP BY book_id")
def book_status(spark, d):
    return review.book_status(_chapters(spark, d, "status"))


@query("progress_percent", f"WITH {_LC} SELECT book_id, CAST(least(100, round_even(count(*) FILTER (status = 'completed') * 100.0 / greatest(count(*), 1), 0)) AS BIGINT) AS percent FROM lc GROUP BY book_id")
def progress_percent(spark, d):
    s = _chapters(spark, d, "status").groupBy("book_id").agg(F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("total"))
    return s.select("book_id", review.progress(F.col("done"), F.col("total")).alias("percent"))


@query("result_files", f"WITH {_LC} SELECT book_id, chapter, printf('%02d_chapter.wav', chapter) AS file FROM lc")
def result_files(spark, d):
    c = _chapters(spark, d)
    return review.result_files(c.select("book_id", F.format_string("%02d_chapter.wav", "chapter").alias("file")), c).select("book_id", "chapter", "file")


# ---- edits: M1-M10, E9 ---------------------------------------------------------------------------------------------


@query("manual_overrides", f"""WITH {_LS}, e AS (SELECT row_id, 'Revisor' AS n FROM ls WHERE type IN ('dialogue', 'internal_thought') AND speaker = 'Unknown')
SELECT ls.row_id, coalesce(n, speaker) AS speaker, CASE WHEN n IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, CASE WHEN n IS NOT NULL THEN 'manual' ELSE resolution_method END AS resolution_method, coalesce(review_needed, false) AND n IS NULL AS review_needed, CASE WHEN n IS NULL THEN new_character_candidate END AS new_character_candidate FROM ls LEFT JOIN e USING (row_id)""")
def manual_overrides(spark, d):
    s = _segments(spark, d, *_FULL)
    return edits.override_speakers(s, s.where(is_speech(F.col("type")) & (F.col("speaker") == "Unknown")).select("row_id", F.lit("Revisor").alias("speaker")))


@query("register_names", f"""WITH {_LS}, {_LP}, w AS (SELECT book_id, {_squeeze('speaker')} AS name, chapter, {_key('speaker')} AS key FROM ls WHERE speaker IS NOT NULL AND speaker NOT IN ('Narrator', 'Unknown')),
f AS (SELECT book_id, key, arg_min(name, (chapter, name)) AS name, min(chapter) AS chapter FROM w WHERE key NOT IN ('', 'unknown') GROUP BY ALL), n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM lp WHERE lp.book_id = f.book_id AND {_key('lp.canonical_name')} = f.key)),
m AS (SELECT book_id, max(CAST(regexp_extract(char_id, '(\\d+)$', 1) AS INT)) AS last FROM lp GROUP BY book_id)
SELECT n.book_id, printf('char_%06d', coalesce(last, 0) + row_number() OVER (PARTITION BY n.book_id ORDER BY chapter, key)) AS char_id, name AS canonical_name, chapter AS first_seen_chapter FROM n LEFT JOIN m USING (book_id)""")
def register_names(spark, d):
    wanted = _segments(spark, d, "speaker", "chapter").where(named(F.col("speaker"))).select("book_id", F.col("speaker").alias("name"), "chapter")
    return edits.register_names(_people(spark, d), wanted)


@query("add_aliases", f"""WITH {_LP}, w AS (SELECT book_id, char_id, name, known_from_chapter, {_key('name')} AS key FROM aliases WHERE char_id IS NOT NULL), o AS (SELECT book_id, char_id, {_key('canonical_name')} AS key FROM lp UNION SELECT book_id, char_id, key FROM w)
SELECT book_id, char_id, min(name) AS name, max(known_from_chapter) AS known_from_chapter FROM w WHERE key <> '' AND known_from_chapter >= 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.book_id = w.book_id AND o.key = w.key AND o.char_id <> w.char_id) GROUP BY book_id, char_id, key""")
def add_aliases(spark, d):
    a = table(spark, d, "aliases", "book_id", "char_id", "name", "known_from_chapter")
    return edits.add_aliases(a, _people(spark, d), a.where("char_id IS NOT NULL"))


@query("remove_aliases", f"WITH a AS (SELECT DISTINCT book_id, char_id, name, known_from_chapter FROM aliases) SELECT * FROM a WHERE NOT coalesce(EXISTS (SELECT 1 FROM characters c WHERE c.book_id = a.book_id AND c.char_id = a.char_id AND {_key('c.canonical_name')} = {_key('a.name')}), false)")
def remove_aliases(spark, d):
    a = table(spark, d, "aliases", "book_id", "char_id", "name", "known_from_chapter").distinct()
    return edits.remove_aliases(a, table(spark, d, "characters", "book_id", "char_id", F.col("canonical_name").alias("name")))


@query("voice_moves", f"""WITH {_LP}, nw AS (SELECT book_id, canonical_name AS speaker, min(voice_id) FILTER (coalesce(voice_manual, false)) AS manual, min(voice_id) AS existing FROM lp GROUP BY ALL),
rn AS (SELECT book_id, canonical_name AS old, 'Nuevo ' || canonical_name AS new FROM lp WHERE char_id = 'char_000002'), ol AS (SELECT rn.book_id, rn.new AS speaker, min(coalesce(manual, existing)) AS moved FROM rn JOIN nw ON nw.book_id = rn.book_id AND nw.speaker = rn.old GROUP BY ALL),
bo AS (SELECT * FROM nw FULL JOIN ol USING (book_id, speaker)), un AS (SELECT * FROM bo WHERE NOT EXISTS (SELECT 1 FROM rn r WHERE r.book_id = bo.book_id AND r.old = bo.speaker)),
al AS (SELECT book_id, speaker, coalesce(manual, existing, moved) AS v FROM un UNION ALL SELECT DISTINCT book_id, 'Unknown', NULL FROM lp WHERE NOT EXISTS (SELECT 1 FROM un WHERE un.book_id = lp.book_id AND un.speaker = 'Unknown')) SELECT book_id, speaker, coalesce(v, (SELECT max(voice_id) FROM voices)) AS voice_id FROM al""")
def voice_moves(spark, d):
    p = _people(spark, d)
    renames = p.where("char_id = 'char_000002'").select("book_id", F.col("canonical_name").alias("old"), F.concat(F.lit("Nuevo "), "canonical_name").alias("new"))
    return voices.move_voices(p, table(spark, d, "voices"), renames)


@query("rename_alias", f"""WITH {_LP}, r AS (SELECT book_id, char_id, canonical_name, 'Nuevo ' || canonical_name AS new_name FROM lp WHERE char_id = 'char_000002')
SELECT book_id, char_id, canonical_name AS name, coalesce((SELECT first_seen_chapter FROM lp WHERE lp.book_id = r.book_id AND lp.char_id = r.char_id), 1) AS known_from_chapter FROM r""")
def rename_alias(spark, d):
    p = _people(spark, d)
    wanted = p.where("char_id = 'char_000002'").select("book_id", "char_id", F.concat(F.lit("Nuevo "), "canonical_name").alias("new_name"))
    return edits.rename(p, wanted)[1]


@query("merge_characters", f"""WITH {_LP}, m AS (SELECT *, CASE WHEN char_id = 'char_000003' THEN 'char_000002' ELSE char_id END AS t, coalesce(voice_manual, false) AS man FROM lp),
k AS (SELECT *, char_id = t AS own, CASE WHEN char_id = t AND man THEN 0 WHEN man THEN 1 WHEN char_id = t AND voice_id IS NOT NULL THEN 2 WHEN voice_id IS NOT NULL THEN 3 ELSE 4 END AS rank FROM m)
SELECT book_id, t AS char_id, arg_min(canonical_name, (NOT own, row_id)) AS canonical_name, min(first_seen_chapter) AS first_seen_chapter, first(voice_id ORDER BY rank, char_id) AS voice_id, bool_or(man) AS voice_manual, bool_and(coalesce(pending, false)) AND count(DISTINCT char_id) = 1 AS pending FROM k GROUP BY book_id, t""")
def merge_characters(spark, d):
    p = _people(spark, d)
    wanted = p.where("char_id = 'char_000003'").select("book_id", F.col("char_id").alias("source_id"), F.lit("char_000002").alias("target_id"))
    return edits.merge(p, table(spark, d, "aliases", "book_id", "char_id", "name", "known_from_chapter"), wanted)[0]


@query("select_chapters", f"WITH {_LC} SELECT row_id, chapter <= 3 AS selected FROM lc")
def select_chapters(spark, d):
    c = _chapters(spark, d, "selected_for_processing")
    return edits.select_chapters(c, chapters.select_range(c, "1-3")).select("row_id", F.col("selected_for_processing").alias("selected"))


@query("clear_chapter_cache", f"WITH {_LC} SELECT book_id, chapter, CASE WHEN book_id = 1 AND chapter = 1 AND status = 'completed' THEN 'ready_for_audio' ELSE status END AS status FROM lc")
def clear_chapter_cache(spark, d):
    c = _chapters(spark, d, "status")
    return edits.clear_chapter(c, c, 1, 1)[1].select("book_id", "chapter", "status")


# ---- audio plan: C9, F10, G9, N1-N6, E10 ---------------------------------------------------------------------------


def _chunk_ctes(most: int = 400) -> str:
    """ct(row_id, chunk_no, chunk): a fold over a paragraph's sentences, and over the words of one that doesn't fit; o holds finished chunks, h the open one."""
    none = "CAST([] AS VARCHAR[])"
    item = lambda x: f"{{'o': {none}, 'h': {x}}}"
    flushed = lambda a: f"CASE WHEN {a}.h <> '' THEN list_append({a}.o, {a}.h) ELSE {a}.o END"
    pieces = f"list_transform(generate_series(0, (length(w.h) - 1) // {most}), lambda i: substring(w.h, i * {most} + 1, {most}))"
    word = f"""CASE WHEN length(w.h) > {most} THEN {{'o': list_concat({flushed('b')}, {pieces}), 'h': ''}} WHEN b.h <> '' AND length(b.h) + 1 + length(w.h) > {most} THEN {{'o': list_append(b.o, b.h), 'h': w.h}}
 ELSE {{'o': b.o, 'h': CASE WHEN b.h <> '' THEN b.h || ' ' || w.h ELSE w.h END}} END"""
    words = f"list_reduce(list_transform(string_split_regex(s.h, '{_WS}+'), lambda x: {item('x')}), lambda b, w: {word}, {{'o': {flushed('a')}, 'h': ''}})"
    reopened = f"list_transform([{words}], lambda z: CASE WHEN z.h = '' AND len(z.o) > 0 THEN {{'o': z.o[1:len(z.o) - 1], 'h': z.o[len(z.o)]}} ELSE z END)[1]"
    sentence = f"CASE WHEN length(a.h) + length(s.h) + CASE WHEN a.h <> '' THEN 1 ELSE 0 END <= {most} THEN {{'o': a.o, 'h': CASE WHEN a.h <> '' THEN a.h || ' ' || s.h ELSE s.h END}} ELSE {reopened} END"
    return rf"""pa AS (SELECT row_id, list_filter(list_transform(string_split_regex(text, '\n{_WS}*\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM ls WHERE text IS NOT NULL),
pb AS (SELECT row_id, unnest(ps) AS par, generate_subscripts(ps, 1) AS pn FROM pa),
pc AS (SELECT row_id, pn, list_filter(list_transform(string_split(regexp_replace(par, '([.!?…]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS ss FROM pb),
pd AS (SELECT row_id, pn, list_reduce(list_transform(ss, lambda x: {item('x')}), lambda a, s: {sentence}, {item("''")}) AS z FROM pc WHERE len(ss) > 0),
pe AS (SELECT row_id, pn, unnest({flushed('z')}) AS chunk, generate_subscripts({flushed('z')}, 1) AS k FROM pd),
ct AS (SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY pn, k) - 1 AS INTEGER) AS chunk_no, chunk FROM pe)"""


_CHUNKS = _chunk_ctes()


@query("chunk_text", f"WITH {_LS}, {_CHUNKS} SELECT * FROM ct")
def chunk_text(spark, d):
    return exploded(_segments(spark, d, "text"), ["row_id"], chunks.chunks_column(F.col("text")), "chunk_no", "chunk")


@query("chunk_totals_rollup", f"WITH {_LS}, {_CHUNKS}, n AS (SELECT ls.book_id, ls.chapter, count(ct.row_id) AS n FROM ls LEFT JOIN ct USING (row_id) GROUP BY ALL) SELECT book_id, chapter, CAST(n AS BIGINT) AS chunks FROM n UNION ALL SELECT book_id, NULL, CAST(sum(n) AS BIGINT) FROM n GROUP BY book_id")
def chunk_totals_rollup(spark, d):
    return chunks.chunk_totals(_segments(spark, d, "chapter", "text"))


@query("pause_plan", f"""WITH {_LS}, {_CHUNKS}, w AS (SELECT *, lag(speaker) OVER v AS before, row_number() OVER v AS n FROM ls WINDOW v AS (PARTITION BY book_id, chapter ORDER BY seg_order, row_id)),
j AS (SELECT w.*, ct.chunk_no, ct.chunk, row_number() OVER (PARTITION BY book_id, chapter ORDER BY n, chunk_no) AS place FROM w JOIN ct USING (row_id))
SELECT book_id, chapter, CAST(place AS INTEGER) AS place, row_id, chunk_no, chunk, speaker, CAST(CASE WHEN place = 1 THEN 0 WHEN coalesce(scene_break_before, false) AND chunk_no = 0 THEN 1000 WHEN chunk_no > 0 THEN CASE WHEN contains(text, chr(10) || chr(10)) THEN 320 ELSE 180 END
 WHEN before IS DISTINCT FROM speaker AND n > 1 THEN 260 ELSE 180 END AS INTEGER) AS pause_ms FROM j""")
def pause_plan(spark, d):
    return chunks.pause_plan(_segments(spark, d, *_FULL))


@query("silence_frames", f"WITH {_LS}, p AS (SELECT row_id, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN coalesce(scene_break_before, false) THEN 1000 WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 260 ELSE 180 END AS ms FROM ls WINDOW w AS (PARTITION BY book_id, chapter ORDER BY seg_order, row_id)) SELECT row_id, CAST(ms AS INTEGER) AS ms, CAST(22050 * ms // 1000 AS BIGINT) AS frames FROM p")
def silence_frames(spark, d):
    w = Window.partitionBy("book_id", "chapter").orderBy("seg_order", "row_id")
    ms = F.when(F.row_number().over(w) == 1, 0).when(F.coalesce("scene_break_before", F.lit(False)), 1000).when(~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 260).otherwise(180)
    return _segments(spark, d, "chapter", "seg_order", "speaker", "scene_break_before").select("row_id", ms.alias("ms")).withColumn("frames", chunks.silence_frames(F.col("ms"), 22050))


@query("assembled_book", f"WITH {_LC}, r AS (SELECT book_id, chapter, row_number() OVER (PARTITION BY book_id ORDER BY chapter) AS k FROM lc WHERE status = 'completed') SELECT book_id, chapter, CAST(k AS INTEGER) AS track, CASE WHEN k > 1 THEN 700 ELSE 0 END AS pause_ms FROM r")
def assembled_book(spark, d):
    return chunks.chapter_gaps(_chapters(spark, d, "status").where("status = 'completed'"))


_KEYS = f"{_LS}, {_LP}, vo AS (SELECT book_id, canonical_name, min(voice_id) AS v FROM lp GROUP BY ALL), ck AS (SELECT ls.row_id, ls.book_id, ls.chapter, sha256(concat_ws(chr(31), '1', coalesce(text, ''), coalesce(v, ''), 'local', 'default', '1', '1')) AS key FROM ls LEFT JOIN vo ON vo.book_id = ls.book_id AND vo.canonical_name = ls.speaker)"


def _keys(spark, d):
    v = _people(spark, d).groupBy("book_id", F.col("canonical_name").alias("speaker")).agg(F.min("voice_id").alias("v"))
    s = _segments(spark, d, "chapter", "text", "speaker").join(v, ["book_id", "speaker"], "left")
    return s.select("row_id", "book_id", "chapter", chunks.cache_key(F.col("text"), F.col("v")).alias("key"))


@query("audio_cache_keys", f"WITH {_KEYS} SELECT row_id, key FROM ck")
def audio_cache_keys(spark, d):
    return _keys(spark, d).select("row_id", "key")


@query("cache_hits", f"WITH {_KEYS} SELECT DISTINCT key FROM ck WHERE key IN (SELECT key FROM ck WHERE chapter = 1)")
def cache_hits(spark, d):
    k = _keys(spark, d)
    return chunks.split_hits(k, k.where("chapter = 1"))[0].select("key")


@query("cache_misses", f"WITH {_KEYS} SELECT DISTINCT key FROM ck WHERE key NOT IN (SELECT key FROM ck WHERE chapter = 1)")
def cache_misses(spark, d):
    k = _keys(spark, d)
    return chunks.split_hits(k, k.where("chapter = 1"))[1].select("key")


@query("speech_frames", f"WITH {_LS} SELECT row_id, CAST(greatest(80, length(text)) AS BIGINT) AS frames FROM ls WHERE text IS NOT NULL")
def speech_frames(spark, d):
    return audio.silent_speech(_segments(spark, d, "text").where("text IS NOT NULL"), ["row_id"], "text").select("row_id", "frames")


@query("resample_pcm")
def resample_pcm(spark, d):
    s = audio.silent_speech(_segments(spark, d, "text").where("text IS NOT NULL"), ["row_id"], "text")
    return s.select("row_id", F.octet_length(audio.resampled(F.col("pcm"), F.col("rate"), 8000)).alias("n_bytes"))


# ---- voices: A18, D14, D16, D17, E14, E15, G10, I1, L9, L10 ----------------------------------------------------------


@query("voice_round_robin", f"WITH {_FIRST}, v AS (SELECT voice_id, row_number() OVER (ORDER BY voice_id) - 1 AS slot, count(*) OVER () AS size FROM (SELECT DISTINCT voice_id FROM voices)) SELECT book_id, speaker, position, voice_id FROM fp JOIN v ON position % size = slot")
def voice_round_robin(spark, d):
    return voices.round_robin(_segments(spark, d, "speaker", "seg_order"), table(spark, d, "voices"))


def _profiles(spark, d):
    return table(spark, d, "voices").select(F.concat(F.lit("profile_"), "voice_id").alias("voice_id"), F.col("voice_id").alias("base_voice_id"), "name", "language", "gender", "provider", F.lit("profile").alias("strategy"), (F.length("name") / 4.0).alias("speed"), F.lit(1.0).alias("volume"))


@query("voice_catalog_union", "SELECT voice_id, name, language, gender, provider, strategy FROM voices UNION ALL SELECT 'profile_' || voice_id, name, language, gender, provider, 'profile' FROM voices")
def voice_catalog_union(spark, d):
    return voices.catalogue(table(spark, d, "voices"), _profiles(spark, d))


@query("voice_profiles", "SELECT voice_id AS base_voice_id, 'profile_' || voice_id AS voice_id, provider, length(name) / 4.0 AS speed FROM voices WHERE length(name) / 4.0 BETWEEN 0.5 AND 2.0")
def voice_profiles(spark, d):
    return voices.profiled(_profiles(spark, d), table(spark, d, "voices")).select("base_voice_id", "voice_id", "provider", F.col("speed").cast("double").alias("speed"))


@query("voice_filters", "SELECT DISTINCT 'language' AS field, language AS value FROM voices WHERE language IS NOT NULL UNION ALL SELECT DISTINCT 'gender', gender FROM voices WHERE gender IS NOT NULL")
def voice_filters(spark, d):
    return voices.filters(table(spark, d, "voices"))


@query("voice_availability", f"WITH {_LS}, {_LP}, g AS (SELECT book_id, canonical_name AS speaker, min(voice_id) AS voice_id FROM lp WHERE voice_id IS NOT NULL GROUP BY ALL), u AS (SELECT DISTINCT book_id, speaker FROM ls WHERE speaker IS NOT NULL) SELECT u.book_id, u.speaker, CASE WHEN g.voice_id IS NULL THEN 'missing' ELSE 'unavailable' END AS problem FROM u LEFT JOIN g USING (book_id, speaker) LEFT JOIN voices v ON v.voice_id = g.voice_id WHERE v.voice_id IS NULL")
def voice_availability(spark, d):
    return voices.missing_voices(_segments(spark, d, "speaker"), _people(spark, d), table(spark, d, "voices"))


@query("voice_compatible", f"WITH {_LP}, g AS (SELECT voice_id, lower(gender) AS g FROM voices WHERE gender IS NOT NULL) SELECT DISTINCT lp.book_id, lp.char_id, lp.voice_id, n.choices FROM lp JOIN g USING (voice_id) JOIN (SELECT g, count(*) AS choices FROM g GROUP BY g) n ON n.g = g.g")
def voice_compatible(spark, d):
    return voices.compatible(_people(spark, d), table(spark, d, "voices"))


# A fold over a book's cast in order: res holds reserved voices, out what was chosen.
_FREE = "list_filter({}, lambda v: NOT list_contains(a.res, v))"
_PICK = f"[CASE WHEN x.own THEN d ELSE g END, {_FREE.format('CASE WHEN x.own THEN d ELSE g END')}]"
_STEP = f"""CASE WHEN x.out[1].v IS NOT NULL THEN {{'res': CASE WHEN x.man OR x.out[1].s = 'dedicated' THEN list_append(a.res, x.out[1].v) ELSE a.res END, 'out': list_concat(a.out, x.out), 'own': x.own, 'num': x.num, 'man': x.man}}
 ELSE list_transform([{_PICK}], lambda c: CASE WHEN x.own AND len(c[2]) > 0 THEN {{'res': list_append(a.res, c[2][1]), 'out': list_append(a.out, {{'c': x.out[1].c, 'v': c[2][1], 's': 'dedicated'}}), 'own': x.own, 'num': x.num, 'man': x.man}}
 ELSE {{'res': a.res, 'out': list_append(a.out, {{'c': x.out[1].c, 'v': CASE WHEN len(c[2]) > 0 THEN c[2][CAST(x.num % len(c[2]) + 1 AS BIGINT)] ELSE c[1][CAST(x.num % len(c[1]) + 1 AS BIGINT)] END, 's': 'generic_pool'}}), 'own': x.own, 'num': x.num, 'man': x.man}} END)[1] END"""


@query("voice_greedy", f"""WITH {_LP}, sh AS (SELECT coalesce(list(voice_id ORDER BY voice_id) FILTER (strategy = 'dedicated'), list(voice_id ORDER BY voice_id)) AS d, coalesce(list(voice_id ORDER BY voice_id) FILTER (strategy = 'generic_pool'), list(voice_id ORDER BY voice_id)) AS g FROM voices),
ca AS (SELECT book_id, char_id, CASE WHEN canonical_name = 'Narrator' THEN 0 ELSE coalesce(list_position(['major', 'supporting', 'minor', 'unknown'], importance), 5) END AS rank, CAST(coalesce(try_cast(regexp_extract(char_id, '(\\d+)$', 1) AS BIGINT), 0) AS BIGINT) AS num, voice_id, voice_strategy, coalesce(voice_manual, false) AS man FROM lp WHERE NOT coalesce(pending, false)),
el AS (SELECT book_id, list({{'res': CAST([] AS VARCHAR[]), 'out': [{{'c': char_id, 'v': voice_id, 's': voice_strategy}}], 'own': rank <= 2, 'num': num, 'man': man}} ORDER BY rank, char_id) AS h FROM ca GROUP BY book_id),
fo AS (SELECT book_id, list_reduce(h, lambda a, x: {_STEP}, {{'res': CAST([] AS VARCHAR[]), 'out': list_filter(h[1].out, lambda o: false), 'own': false, 'num': CAST(0 AS BIGINT), 'man': false}}).out AS out FROM el, sh)
SELECT book_id, o.c AS char_id, o.v AS voice_id, o.s AS voice_strategy FROM (SELECT book_id, unnest(out) AS o FROM fo)""")
def voice_greedy(spark, d):
    return voices.reserve_voices(_people(spark, d), table(spark, d, "voices"))


# ---- change detection: E11, E13, F11, F16, F18, G11, I5, K5-K7, K11, B3 ------------------------------------------------


def _print_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT book_id, chapter, seg_order, row_id, sha256(concat_ws(chr(31), coalesce(text, ''), coalesce(speaker, ''), '', CASE WHEN coalesce(scene_break_before, false) THEN 'true' ELSE 'false' END)) AS h FROM {source}),
{name} AS (SELECT book_id, chapter, sha256(string_agg(h, '' ORDER BY seg_order, row_id)) AS fingerprint FROM {name}0 GROUP BY book_id, chapter)"""


_OLDEST = "os AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY book_id, segment_id ORDER BY loaded_at, row_id) = 1)"


def _oldest(spark, d):
    w = Window.partitionBy("book_id", "segment_id").orderBy("loaded_at", "row_id")
    s = table(spark, d, "segments", "book_id", "segment_id", "row_id", "loaded_at", "chapter", "seg_order", "text", "speaker", "scene_break_before")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@query("chapter_fingerprints", f"WITH {_LS}, {_print_sql('fp', 'ls')} SELECT * FROM fp")
def chapter_fingerprints(spark, d):
    return incremental.fingerprints(_segments(spark, d, *_FULL))


_CHANGED = f"{_LS}, {_OLDEST}, {_print_sql('fo', 'os')}, {_print_sql('fn', 'ls')}, ch AS (SELECT book_id, chapter, CASE WHEN fo.fingerprint IS NULL THEN 'new' WHEN fn.fingerprint IS NULL THEN 'gone' ELSE 'changed' END AS change FROM fo FULL JOIN fn USING (book_id, chapter) WHERE fo.fingerprint IS DISTINCT FROM fn.fingerprint)"


def _changed(spark, d):
    # Row ids differ between deliveries, so rows are identified by their place.
    return incremental.changed_chapters(incremental.fingerprints(_oldest(spark, d)), incremental.fingerprints(_segments(spark, d, *_FULL)))


@query("changed_chapters", f"WITH {_CHANGED} SELECT * FROM ch")
def changed_chapters(spark, d):
    return _changed(spark, d)


@query("continuity_warnings", f"WITH {_LC}, {_CHANGED}, m AS (SELECT book_id, min(chapter) AS first_changed FROM ch GROUP BY book_id) SELECT lc.book_id, lc.chapter, m.first_changed FROM lc JOIN m USING (book_id) WHERE lc.chapter > m.first_changed AND lc.status <> 'not_analyzed' AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.book_id = lc.book_id AND ch.chapter = lc.chapter)")
def continuity_warnings(spark, d):
    return incremental.continuity_warnings(_chapters(spark, d, "status"), _changed(spark, d))


@query("chapter_status_rollup", f"WITH {_LS} SELECT book_id, chapter, CASE WHEN bool_or(coalesce(review_needed, false) OR coalesce(speaker = 'Unknown', false)) THEN 'review_required' ELSE 'ready_for_audio' END AS status FROM ls GROUP BY book_id, chapter")
def chapter_status_rollup(spark, d):
    return incremental.chapter_status(_segments(spark, d, "chapter", "speaker", "review_needed"))


@query("pending_chapters", f"WITH {_LC} SELECT book_id, chapter FROM lc WHERE selected_for_processing AND narrate AND NOT EXISTS (SELECT 1 FROM lc x WHERE x.book_id = lc.book_id AND x.chapter = lc.chapter AND x.status = 'completed')")
def pending_chapters(spark, d):
    c = _chapters(spark, d, "status", "selected_for_processing", "narrate")
    return incremental.pending_chapters(c, c.where("status = 'completed'")).select("book_id", "chapter")


@query("interrupted_recovery", f"WITH {_LC} SELECT row_id, CASE WHEN status IN ('analyzing', 'generating_audio') THEN 'failed' ELSE status END AS recovered, CASE WHEN status IN ('analyzing', 'generating_audio') THEN 'interrupted' ELSE consistency_warning END AS warning FROM lc")
def interrupted_recovery(spark, d):
    return incremental.recover_interrupted(_chapters(spark, d, "status", "consistency_warning")).select("row_id", "recovered", "warning")


@query("upsert_chapters", "WITH n AS (SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY book_id, chapter ORDER BY loaded_at DESC, row_id DESC) = 1) SELECT row_id, book_id, chapter FROM n UNION ALL SELECT c.row_id, c.book_id, c.chapter FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.book_id = c.book_id AND n.chapter = c.chapter)")
def upsert_chapters(spark, d):
    return incremental.upsert(table(spark, d, "chapters", "row_id", "book_id", "chapter"), _chapters(spark, d).select("row_id", "book_id", "chapter"), "book_id", "chapter")


@query("diagnostics_sum", f"WITH {_LS} SELECT coalesce(resolution_method, 'none') AS key, count(*) AS value FROM ls GROUP BY 1")
def diagnostics_sum(spark, d):
    runs = _segments(spark, d, "resolution_method").select(F.coalesce("resolution_method", F.lit("none")).alias("key"), F.lit(1).cast("bigint").alias("value"))
    return incremental.sum_diagnostics(runs)


@query("chapter_state_machine", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def chapter_state_machine(spark, d):
    return incremental.last_states(table(spark, d, "events", "user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"])


@query("state_transitions", "WITH r AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT previous, event_type, count(*) AS n FROM r WHERE previous IS NULL OR previous <> event_type GROUP BY ALL")
def state_transitions(spark, d):
    return incremental.changes_in_order(table(spark, d, "events", "user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"])


@query("document_index", f"""WITH {_LC}, p AS (SELECT book_id, list({{'chapter': chapter, 'chapter_id': chapter_id, 'title': title, 'word_count': word_count, 'status': status, 'selected_for_processing': selected_for_processing, 'narrate': narrate, 'section_kind': section_kind}} ORDER BY chapter) AS chapters FROM lc GROUP BY book_id)
SELECT b.book_id, CAST(to_json({{'schema_version': 3, 'book_id': b.book_id, 'title': b.title, 'author': author, 'language': language, 'publisher': publisher, 'identifier': identifier, 'format': format, 'chapters': chapters}}) AS VARCHAR) AS manifest FROM books b LEFT JOIN p USING (book_id)""")
def document_index(spark, d):
    return incremental.document_index(table(spark, d, "books"), _chapters(spark, d, "chapter_id", "title", "word_count", "status", "selected_for_processing", "narrate", "section_kind"))


# ---- pages: A5-A7, A12, E12 ----------------------------------------------------------------------------------------------


@query("page_edge_cleanup", f"""
WITH {_LC}, pg AS (SELECT book_id, chapter, text FROM lc WHERE text IS NOT NULL), l AS (SELECT book_id, chapter, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS line_no FROM pg), b AS (SELECT *, {_strip('line')} AS bare FROM l),
e AS (SELECT *, coalesce(line_no = min(CASE WHEN bare <> '' THEN line_no END) OVER w OR line_no = max(CASE WHEN bare <> '' THEN line_no END) OVER w, false) AS edge, count(CASE WHEN bare <> '' THEN 1 END) OVER w = 1 AS alone FROM b WINDOW w AS (PARTITION BY book_id, chapter)),
n AS (SELECT book_id, count(*) AS pages FROM pg GROUP BY book_id), c AS (SELECT e.book_id, bare FROM e JOIN n USING (book_id) WHERE edge GROUP BY e.book_id, bare, pages HAVING sum(CASE WHEN alone THEN 2 ELSE 1 END) >= greatest(2, (pages + 1) // 2))
SELECT book_id, chapter, CAST(line_no AS INTEGER) AS line_no, line FROM e WHERE NOT (edge AND (EXISTS (SELECT 1 FROM c WHERE c.book_id = e.book_id AND c.bare = e.bare) OR regexp_matches(bare, '(?i)^(?:p[aá]gina\\s+)?\\d+$')))""")
def page_edge_cleanup(spark, d):
    return pages.clean_edges(_chapters(spark, d, "text").where("text IS NOT NULL"), "book_id", "chapter")


@query("pdf_reflow")
def pdf_reflow(spark, d):
    return pages.reflow_pages(_chapters(spark, d, "text"), ["row_id"])


@query("spaced_headings", rf"WITH {_LC} SELECT row_id, CASE WHEN regexp_matches(title, '(?i)^\s*C\s+a\s+p\s+[ií]\s+t\s+u\s+l\s+o(?:$|[^\p{{L}}\p{{N}}_])') THEN array_to_string(list_transform(string_split_regex({_strip('title')}, '\s{{2,}}'), lambda x: regexp_replace(x, '\s+', '', 'g')), ' ') ELSE title END AS title FROM lc")
def spaced_headings(spark, d):
    return _chapters(spark, d, "title").select("row_id", T.spaced_heading(F.col("title")).alias("title"))


@query("html_text_blocks", f"WITH {_LC}, h AS (SELECT row_id, concat('<html><head><title>x</title></head><body><nav>menu</nav><p>', title, '</p><p>', status, '</p></body></html>') AS html FROM lc) SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<head>.*?</head>', ' ', 's'), '<nav>.*?</nav>', ' ', 's'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM h")
def html_text_blocks(spark, d):
    html = F.concat(F.lit("<html><head><title>x</title></head><body><nav>menu</nav><p>"), F.coalesce("title", F.lit("")), F.lit("</p><p>"), "status", F.lit("</p></body></html>"))
    return _chapters(spark, d, "title", "status").select("row_id", pages.html_text(html).alias("text"))


@query("html_blocks")
def html_blocks(spark, d):
    html = F.concat(F.lit("<body><h2>"), F.coalesce("title", F.lit("")), F.lit("</h2><p>"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n+", "</p><p>"), F.lit("</p></body>"))
    return pages.html_table(_chapters(spark, d, "title", "text").withColumn("html", html), ["row_id"], "html").select("row_id", "pos", "text", "heading_level")


@query("toc_titles", f"WITH {_LC}, t AS (SELECT source_reference AS href, min('TOC ' || title) AS toc_title FROM lc WHERE title IS NOT NULL AND source_reference IS NOT NULL GROUP BY 1) SELECT lc.row_id, coalesce(t.toc_title, lc.title, 'Section ' || lc.chapter) AS title FROM lc LEFT JOIN t ON t.href = lc.source_reference")
def toc_titles(spark, d):
    c = _chapters(spark, d, "title", "source_reference")
    toc = c.where("title IS NOT NULL AND source_reference IS NOT NULL").select(F.col("source_reference").alias("href"), F.concat(F.lit("TOC "), "title").alias("title"))
    return pages.toc_titles(c.select("row_id", F.col("source_reference").alias("href"), "title", F.col("chapter").alias("place")), toc).select("row_id", "title")


@query("analyze_chapters")
def analyze_chapters(spark, d):
    """The whole path: normalise, segment, attribute (K3)."""
    return project.analyze(_chapters(spark, d, "text").select("book_id", "chapter", "text")).select("book_id", "chapter", "seg_order", "type", "text", "speaker", "confidence", "resolution_method")


# ---- the rest: A16, A17, D15, F14, H4, H5, I3, L4-L6, the model's closed sets ------------------------------------------------


@query("chapter_bodies", f"WITH {_LC} SELECT row_id, text FROM lc WHERE book_id = 1 AND chapter = 2")
def chapter_bodies(spark, d):
    """One chapter's body by pushed-down filters; no other column or row group is read."""
    return latest(table(spark, d, "chapters", "book_id", "chapter", "row_id", "loaded_at", "text").where("book_id = 1 AND chapter = 2"), "book_id", "chapter").select("row_id", "text")


@query("legacy_defaults", f"WITH {_LS} SELECT row_id, 1 AS schema_version, coalesce(review_needed, speaker = 'Unknown' OR coalesce(confidence < 0.85, false)) AS review_needed FROM ls")
def legacy_defaults(spark, d):
    from lorewright.sources.readers import with_defaults

    return with_defaults(_segments(spark, d, "speaker", "confidence", "review_needed").withColumn("schema_version", F.lit(None).cast("int"))).select("row_id", "schema_version", "review_needed")


@query("model_violations", f"WITH {_LS}, v AS (SELECT row_id, unnest([CASE WHEN type NOT IN ('narration', 'dialogue', 'internal_thought', 'system_message') THEN 'type' END, CASE WHEN resolution_method NOT IN ('system', 'rule', 'conversation', 'candidate', 'llm', 'manual', 'unknown') THEN 'resolution_method' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END]) AS field FROM ls) SELECT row_id, field FROM v WHERE field IS NOT NULL")
def model_violations(spark, d):
    return schemas.violations(_segments(spark, d, "type", "resolution_method", "confidence"))


@query("result_words", f"WITH {_LC}, {_LS}, s AS (SELECT book_id, chapter, count(*) AS segments FROM ls GROUP BY ALL) SELECT lc.book_id, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS words, CAST(sum(coalesce(segments, 0)) AS BIGINT) AS segments FROM lc LEFT JOIN s USING (book_id, chapter) GROUP BY lc.book_id")
def result_words(spark, d):
    s = _segments(spark, d, "chapter").groupBy("book_id", "chapter").agg(F.count(F.lit(1)).alias("n"))
    return _chapters(spark, d, "word_count").join(s, ["book_id", "chapter"], "left").groupBy("book_id").agg(F.sum(F.coalesce("word_count", F.lit(0))).cast("bigint").alias("words"), F.sum(F.coalesce("n", F.lit(0))).alias("segments"))


@query("ranked_profiles", f"""WITH {_LP} SELECT book_id, char_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN canonical_name = 'Narrator' THEN -1 ELSE coalesce(list_position(['major', 'supporting', 'minor', 'unknown'], importance), 9) END, char_id) AS INTEGER) AS rank FROM lp WHERE NOT coalesce(pending, false)""")
def ranked_profiles(spark, d):
    order = F.when(F.col("canonical_name") == "Narrator", -1).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ["major", "supporting", "minor", "unknown"])), F.col("importance")), F.lit(0)), F.lit(9)))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(order, "char_id"))
    return _people(spark, d).where(~F.coalesce("pending", F.lit(False))).select("book_id", "char_id", rank.alias("rank"))


@query("unknown_reanalysis_targets", f"WITH {_LS} SELECT row_id FROM ls WHERE type IN ('dialogue', 'internal_thought') AND (speaker = 'Unknown' OR review_needed)")
def unknown_reanalysis_targets(spark, d):
    return _segments(spark, d, "type", "speaker", "review_needed").where(is_speech(F.col("type")) & ((F.col("speaker") == "Unknown") | F.col("review_needed"))).select("row_id")


@query("busy_books", f"WITH {_LC} SELECT DISTINCT book_id FROM lc WHERE status IN ('analyzing', 'generating_audio')")
def busy_books(spark, d):
    return review.book_status(_chapters(spark, d, "status")).where("busy").select("book_id")


@query("visible_alias_maps", f"WITH {_NAMES}, v AS (SELECT *, row_number() OVER (PARTITION BY book_id, char_id ORDER BY known_from, key) AS k FROM nt WHERE known_from <= 5 AND key <> {_key('canonical_name')}) SELECT book_id, char_id, CAST(count(*) AS INTEGER) AS n FROM v WHERE k <= 3 GROUP BY ALL")
def visible_alias_maps(spark, d):
    return remote.visible_aliases(_names(spark, d), 5).select("book_id", "char_id", F.size("aliases").alias("n"))


@query("remote_answers", f"WITH {_LS} SELECT row_id, 'Unknown' AS speaker, 0.5 AS confidence, false AS is_new FROM ls WHERE type IN ('dialogue', 'internal_thought')")
def remote_answers(spark, d):
    cache = spark.createDataFrame([], "key string, answer string")
    return remote.answers(_segments(spark, d, *_FULL), cache).select("row_id", "speaker", F.col("confidence").cast("decimal(2,1)").alias("confidence"), "is_new")
