import pytest
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.plans.fold import key_of


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").withColumn("o", f(F.col("v")))
    return [r["o"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_normalize_text(spark):
    got = column(spark, ["a\r\nb\rc", "a\u00a0 \u200bb\ufeff\u00ad", "x  \n\n\n\n y\t\tz ", "cafe\u0301", "\u2015Hola", "", None, "   \n "], T.normalize_text)
    assert got == ["a\nb\nc", "a b", "x\n\ny z", "café", "—Hola", "", None, ""]


HEADINGS = ["Capítulo 1", "CAPÍTULO II", "# Chapter One", "[Episode 3]", "Parte IV: El mar", "1. El inicio", "2 - La torre", "Prólogo", "EPÍLOGO", "LA CASA VACÍA", "Part introduces"]


@pytest.mark.parametrize("lines,wanted", [(HEADINGS, True), (["Capítulo 1 ........ 12", "Parte alta", "Part of it", "—HOLA", "GRITÓ MUCHO.", "una frase normal", "", "12", None], False)])
def test_headings(spark, lines, wanted):
    assert all(bool(x) is wanted for x in column(spark, lines, T.is_chapter_heading))


def test_names_slugs_and_members(spark):
    assert column(spark, ["  María   LÓPEZ ", "Straße", None, ""], T.name_key) == ["maria lopez", "strasse", None, ""]
    assert column(spark, ["El Niño: ¡Fin!", "日本", None, "a" * 100], T.safe_filename) == ["el_nino_fin", "untitled", "untitled", "a" * 80]
    assert column(spark, ["C:\\x\\Mi Libro.EPUB", "a.exe", "x/y.txt"], T.upload_name) == ["mi_libro.epub", None, "y.txt"]
    assert column(spark, ["a/b.html", "../x", "%2e%2e/x", "/abs", "http://x", "a\\b", ""], T.safe_member) == [True, False, False, False, False, False, False]
    assert column(spark, ["C a p í t u l o  1", "Capítulo 1"], T.spaced_heading) == ["Capítulo 1", "Capítulo 1"]
    assert column(spark, ["Table of contents copyright", "Índice", "La torre"], T.section_kind) == ["copyright", "table_of_contents", None]
    assert column(spark, ["a b\u00a0c", "", None, " x "], T.word_count) == [3, 0, None, 1]


def test_keys_in_the_jvm_and_in_python_agree(spark):
    names = [f"a{chr(i)}Z" for i in range(1, 0x250) if not 0x1C <= i <= 0x20 and i not in (0x85, 0xA0)] + ["“José” — «Ñandú»", "Straße", "Ǆ", "ﬁn", "Ωμέγα", "Й", "ｶﾞ", "गौ़", None, ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r["i"]: r["k"] for r in df.select("i", T.name_key(F.col("n")).alias("k")).collect()}
    assert got == {i: None if n is None else key_of(n) for i, n in enumerate(names)}
