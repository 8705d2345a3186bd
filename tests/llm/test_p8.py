import pytest
from pyspark.sql import functions as F

from lorewright.llm import p8_mojibake as P

TEXTS = {"es": "Mañana el señor Núñez llamó a su corazón de cristal y escondió el tapiz en el desván más húmedo", "fr": "L'été où Hélène traîna la clé cachée près du château abandonné", "ru": "Анастасия прячет колокол паромщика под мостом как прежде", "zh": "墨言在旧日的码头旁小心地举起了磨坊的罗盘", "de": "Günther schwört, dass die Mühle für später schön wäre"}


@pytest.mark.parametrize("right,wrong,lang", [("utf-8", "latin-1", "es"), ("utf-8", "cp1252", "fr"), ("utf-8", "mac_roman", "es"), ("utf-8", "cp437", "de"), ("utf-8", "cp850", "es"), ("utf-8", "cp1251", "fr"), ("cp1251", "latin-1", "ru"), ("koi8_r", "cp1251", "ru"), ("gb18030", "latin-1", "zh"), ("cp1252", "mac_roman", "es"), ("cp1252", "cp437", "es")])
def test_undo_gives_the_text_back(right, wrong, lang):
    garbled = "".join(bytes([b]).decode(wrong, "replace") if bytes([b]).decode(wrong, "ignore") else chr(b) for b in TEXTS[lang].encode(right))
    assert garbled != TEXTS[lang] and P.mend(garbled, f"{right}>{wrong}", 0, len(garbled)) == TEXTS[lang]


def test_what_cannot_have_come_from_a_chain():
    for decoy in ("Â Ã Õ Ñ: letras", "NÃO confies", "╔════╗", "√16 ± ½ µ · © ™"):
        assert P.undo(decoy, "utf-8>latin-1") is None


def corpus(spark):
    rows = []
    for k in range(120):
        for lang, t in TEXTS.items():
            rows.append((len(rows), t + f". {k}. " + t, "s" + str(k % 2)))
    garbled = {}
    for lang, right, wrong in (("es", "utf-8", "latin-1"), ("fr", "utf-8", "cp1252"), ("ru", "cp1251", "latin-1"), ("zh", "gb18030", "latin-1")):
        t = TEXTS[lang]
        bad = "".join(bytes([b]).decode(wrong) if bytes([b]).decode(wrong, "ignore") else chr(b) for b in t.encode(right))
        garbled[len(rows)] = TEXTS[lang] + ".\n" + t if lang != "ru" else t
        rows.append((len(rows), TEXTS[lang] + ".\n" + bad if lang != "ru" else bad, "s0"))
    lost = len(rows)
    rows += [(lost, "el coraz�n de cristal", None), (lost + 1, None, "s0"), (lost + 2, "", "s0"), (lost + 3, "plain text", "s1"), (lost + 4, "Â Ã Õ Ñ: letras del códice 4", "s0"), (lost + 5, "√16 ± ½ µ · © ™ ® § ¶", "s1"), (lost + 6, "  ", "s1"), (lost + 7, "NÃO " * 3000, "s1")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, chain string"), garbled, lost


def test_found_and_repaired(spark):
    df, garbled, lost = corpus(spark)
    out = {r["doc_id"]: r for r in P.repair(df, "doc_id", "text", "source").collect()}
    assert set(out) == {*garbled, lost}
    assert {i: out[i]["repaired"] for i in garbled} == garbled and not out[lost]["recovered"]


def test_empty_tables(spark):
    df, *_ = corpus(spark)
    assert P.judge(df.where("false"), "doc_id", "text", "source").count() == 0
    assert P.judge(df.where("text IS NULL"), "doc_id", "text", "source").count() == 0
    assert P.judge(df.where(F.col("text") == "plain text"), "doc_id", "text", "source").count() == 0


def test_a_chain_among_many_alike(spark):
    """Ten chains mend 'se¤or' alike; which one it was only the source's other records tell."""
    bad = lambda t: "".join(bytes([b]).decode("latin-1") for b in t.encode("cp850"))
    good = ["el señor escondió el tapiz", "Él llegó al desván", "Ágata y Íñigo, Últimos de Ávila", "la señora Núñez"]
    rows = [(i, f"{good[i % 4]} {i}. {good[(i + 1) % 4]}", "s0") for i in range(2000)]
    rows += [(10_000 + i, bad(f"{good[2]} {i}. {good[1]}"), "s1") for i in range(12)]
    rows += [(20_000, "el se¤or 7", "s1"), (20_001, "el señor 7", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    model = P.train(df, "text")  # counts, of which each task makes its model
    (found,) = P.gather(df.where("doc_id = 20000"), "doc_id", "text", F.col("source"), model).collect()
    alike = {n for n in P.chains() if P.undo("se¤or", n) == "señor"}
    assert {"cp850>latin-1", "cp437>latin-1"} <= alike and alike <= {x["chain"] for x in found["found"]}
    out = {r["doc_id"]: r for r in P.repair(df, "doc_id", "text", "source").collect()}
    assert set(out) == {*range(10_000, 10_012), 20_000} and out[20_000]["repaired"] == "el señor 7"


def test_no_chain_is_left_out_of_words_with_latin_letters():
    import numpy as np

    (b,) = P._count(iter([__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array([t * 20 for t in TEXTS.values()])], names=["t"])]))
    model = P.Model(b.column(0).to_numpy(), b.column(1).to_numpy())
    one, two = P.tokens_evidence(["webñàéò", "ñàéò"], model)
    assert {"cp1251>latin-1", "koi8_r>latin-1"} <= one.keys() & two.keys()
    # Look-up tables and the plain way, one chain at a time, agree for every token and chain.
    tokens = ["Ã±", "seÃ±or", "ïðÿ÷åò", "se¤or", "Ð¿Ñ€Ñ", "MaÃ±ana,", "墨言在旧日的码头旁", "«Â»", "a b", "😀ñ"]
    for token, found in zip(tokens, P.tokens_evidence(tokens, model)):
        wanted = {c for c in P.chains() if (x := P.undo(token, c)) and x != token}
        assert wanted == found.keys(), token
        for c in wanted:
            (gain,) = model.gains(*P._line([P.undo(token, c)]), model.scores(*P._line([token])))
            assert np.isclose(gain, found[c], atol=1e-3), (token, c)


def test_a_source_in_parts_is_pooled_like_one(spark):
    df, garbled, lost = corpus(spark)
    whole = {r["doc_id"] for r in P.judge(df, "doc_id", "text", "source").collect()}
    assert {r["doc_id"] for r in P.judge(df, "doc_id", "text", "source", group=2).collect()} == whole == {*garbled, lost}
