import json

import pytest
from pyspark.sql import functions as F

from lorewright import schemas
from lorewright.plans import project, remote
from lorewright.sources import readers
from tests.test_segments import rows
from tests.test_sources import epub


def test_asked_once_and_cached(spark, tmp_path):
    log = tmp_path / "calls"

    def factory():
        def client(prompt):
            with open(log, "a") as f:
                f.write("x")
            if "falla" in prompt:
                raise OSError
            return {"speaker": "Ana", "confidence": 0.9, "is_new_character": False}

        return client

    s = rows(spark, [(1, "dialogue", "hola", "Unknown", True), (1, "dialogue", "hola", "Unknown", True), (3, "dialogue", "falla", "Unknown", True), (4, "narration", "x", "Narrator", False)])
    empty = spark.createDataFrame([], "key string, answer string")
    prompts = remote.keyed(s)
    got = remote.ask(prompts, empty, factory).toPandas()
    assert len(got) == 1 and len(log.read_text()) == 2  # equal prompts once, the failure isn't kept
    cache = spark.createDataFrame(got)
    assert {r["row_id"] for r in remote.answers(s, cache, lambda: lambda p: None).collect()} == {1, 2}


def test_descriptions(spark):
    cases = [('{"description":"%s","personality_traits":["a"]}' % ("d" * 700), 600), ('{"description":"x","personality_traits":["%s"]}' % ("t" * 81), None), ('{"description":"x","personality_traits":[%s]}' % ",".join(['"a"'] * 9), None), ('{"personality_traits":[]}', None), (None, None)]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "i int, j string")
    got = {r["i"]: r["n"] for r in df.select("i", F.length(remote.valid_description(F.col("j")).description).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}


def test_epub_data_source(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub(["<h1>Uno</h1><p>a</p>"]))
    (tmp_path / "b.epub").write_bytes(b"no")
    spark.dataSource.register(readers.BookSource)
    got = {r["path"].rsplit("/", 1)[1]: (r["section_title"], r["problem"] is None) for r in spark.read.format("epub").load(str(tmp_path)).collect()}
    assert got == {"a.epub": ("Uno", True), "b.epub": (None, False)}


def test_epub_without_levels_splits_at_headings():
    _, sections = readers.epub_sections(epub(["<p>Capítulo 1</p><p>a</p><p>Capítulo 2</p><p>b</p>"]))
    assert [s["title"] for s in sections] == ["Capítulo 1", "Capítulo 2"]


def test_pdf_and_profiles(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 broken")
    assert readers.read_pdf(readers.files(spark, str(tmp_path))).where("problem IS NOT NULL").count() == 1
    items = [{"id": "p1", "name": "Uno", "provider": "local", "base_voice_id": "v", "language": "es", "strategy": "profile", "settings": {"speed": 1.2}}, {"id": "p2", "name": "Dos", "provider": "local", "base_voice_id": "v", "settings": {"speed": 9}}]
    (tmp_path / "p.json").write_text(json.dumps(items))
    assert [(r["voice_id"], r["speed"], r["volume"]) for r in readers.read_profiles(spark, str(tmp_path / "p.json")).collect()] == [("p1", 1.2, 1.0)]
    with pytest.raises(Exception, match="too many"):
        readers.read_profiles(spark, str(tmp_path / "p.json"), most=1).collect()


def test_versions(spark):
    df = spark.createDataFrame([(None, None, "Unknown", None), (2, None, "Ana", 0.7), (1, False, "Ana", 0.1)], "schema_version int, review_needed boolean, speaker string, confidence double")
    assert [r["review_needed"] for r in readers.with_defaults(df).collect()] == [True, True, False]
    with pytest.raises(Exception, match="newer"):
        readers.with_defaults(df, newest=1).collect()


def test_tables_have_the_schemas(spark, small_tables):
    for name, schema in (("books", schemas.BOOKS), ("chapters", schemas.CHAPTERS), ("segments", schemas.SEGMENTS), ("aliases", schemas.ALIASES), ("voices", schemas.VOICES)):
        assert schemas.missing(spark.read.parquet(f"{small_tables}/{name}.parquet"), schema) == []


def test_whole_path(spark):
    text = "Capítulo 1\n\n—Hola —dijo María.\nEntró Pedro.\n***\n'No sé', pensó."
    out = project.analyze(spark.createDataFrame([(1, 1, text)], "book_id bigint, chapter int, text string")).orderBy("seg_order").collect()
    assert [(r["type"], r["speaker"]) for r in out] == [("narration", "Narrator"), ("dialogue", "María"), ("narration", "Narrator"), ("narration", "Narrator"), ("internal_thought", "Unknown"), ("narration", "Narrator")]
    assert [r["scene_break_before"] for r in out] == [False, False, False, False, True, False]
    assert project.audio_plan(spark.createDataFrame([(1, 1, text)], "book_id bigint, chapter int, text string")).count() == 6
