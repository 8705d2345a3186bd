import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import chapters, chunks, context, segmenter

CASES = [
    ("—Hola —dijo María.", [("dialogue", "Hola"), ("narration", "dijo María.")]),
    ("— —dijo.", [("narration", "dijo.")]),
    ("Dijo “sí” y «no».", [("narration", "Dijo"), ("dialogue", "sí"), ("narration", "y"), ("dialogue", "no"), ("narration", ".")]),
    ("'No sé.'", [("internal_thought", "No sé.")]),
    ("It's fine and that's it.", [("narration", "It's fine and that's it.")]),
    ("uno — dos", [("narration", "uno — dos")]),
    ("", []),
    ("\n \n", []),
]


@pytest.mark.parametrize("text,wanted", CASES)
def test_utterances(text, wanted):
    assert [(k, t) for k, t, _ in segmenter.utterances(text)] == wanted


def test_scene_breaks():
    assert [s for *_, s in segmenter.utterances("uno\n***\ndos\n§\n—tres")] == [False, True, True]


def test_segment_text_and_dash_branch_agree(spark):
    texts = [(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    full = {(r["id"], r["text"]) for r in segmenter.segment_text(df.where(F.col("text").startswith("—")), ["id"]).collect()}
    dash = {(r["id"], r["text"]) for r in segmenter.dash_lines(df, ["id"]).collect()}
    assert full == dash and segmenter.segment_text(df.where("id = 99"), ["id"]).count() == 0


def test_chapters(spark):
    text = "Antes de todo.\nPrólogo\nuno\nCapítulo 1\ndos\ntres\nCapítulo II\nEpílogo\nfin"
    blocks = chapters.text_blocks(spark.createDataFrame([(1, text), (2, "sin nada"), (3, None)], "b int, text string"), ["b"])
    got = [(r["b"], r["number"], r["title"], r["text"]) for r in chapters.detect_chapters(blocks, "b").orderBy("b", "number").collect()]
    assert [x[2] for x in got] == ["Introduction", "Prólogo", "Capítulo 1", "Capítulo II", "Epílogo", "Full document"]
    assert got[2][3] == "Capítulo 1\n\ndos\n\ntres" and got[3][3] == "Capítulo II"


def test_chapters_within_a_row_equal_those_of_blocks(spark):
    rng = random.Random(6)
    lines = ["Capítulo 1", "Prólogo", "uno dos", "3. Título", "  ", "GRITO ALTO", "[EPÍLOGO]", "Índice ..... 4", "## Parte II", "chapter ten: x", "a\u0301rbol"]
    df = spark.createDataFrame([(i, i % 7, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(99, 0, None), (98, 0, " \n ")], "b int, number int, text string")
    wanted = {tuple(r) for r in chapters.detect_chapters(chapters.text_blocks(df, ["b"]), "b").collect()}
    plan = chapters.split_chapters(df.drop("number").where("b < 1000"), ["b"])
    assert {tuple(r) for r in plan.collect()} == wanted and len(wanted) > 100
    assert chapters.split_chapters(df.drop("number").where("false"), ["b"]).count() == 0


def test_ranges():
    assert chapters.parse_range("1-10,25", 30) == [(1, 10), (25, 25)]
    for bad in ("", "0", "5-3", "1-99", "a", "1-2-3"):
        with pytest.raises(ValueError):
            chapters.parse_range(bad, 30)


@pytest.mark.parametrize("most", [1, 7, 40])
def test_packing_loses_nothing(most):
    random.seed(most)
    for _ in range(50):
        text = " ".join("".join(random.choice("abc") for _ in range(random.randint(1, 12))) + random.choice(["", "", ".", "!", ".\n\n"]) for _ in range(30))
        pieces = chunks.pack(text, most)
        assert all(0 < len(p) <= most for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())


def rows(spark, items):
    data = [(i, 1, c, i, t, x, s, None, None, None, None, b) for i, (c, t, x, s, b) in enumerate(items, 1)]
    return spark.createDataFrame(data, "row_id bigint, book_id bigint, chapter int, seg_order bigint, type string, text string, speaker string, confidence double, resolution_method string, review_needed boolean, new_character_candidate string, scene_break_before boolean")


def test_rules(spark):
    df = rows(spark, [
        (1, "dialogue", "Hola", "Unknown", False), (1, "narration", "dijo María Luz.", "Narrator", False), (1, "dialogue", "¿Qué?", "Unknown", True),
        (1, "narration", "Pedro sonrió con calma y dijo:", "Narrator", False), (1, "dialogue", "Ven", "Unknown", False), (1, "narration", "Ana pensó:", "Narrator", False),
        (1, "internal_thought", "No iré", "Unknown", False), (1, "dialogue", "Mi nombre es Sol Ruiz.", "Unknown", False), (1, "narration", "dijo La", "Narrator", False),
    ])
    got = {r["row_id"]: r["rule_speaker"] for r in context.rule_speaker(df).collect()}
    assert got == {1: "María Luz", 2: None, 3: None, 4: None, 5: "Pedro", 6: None, 7: "Ana", 8: "Sol Ruiz", 9: None}


def test_pauses(spark):
    df = rows(spark, [(1, "dialogue", "a", "A", False), (1, "dialogue", "b", "B", False), (1, "dialogue", "c", "B", False), (1, "dialogue", "d", "A", True)])
    assert [r["pause_ms"] for r in chunks.pause_plan(df).orderBy("place").collect()] == [0, 260, 180, 1000]


def test_response_validation(spark):
    bad = ['{"speaker":" ","confidence":0.5}', '{"speaker":"A","confidence":true}', '{"speaker":"A","confidence":2}', '{"speaker":"A"}', "nothing", None, '{"speaker":"%s","confidence":0.5}' % ("x" * 101)]
    df = spark.createDataFrame([(0, '{"speaker":" Ana ","confidence":0.5,"is_new_character":true}')] + [(i, b) for i, b in enumerate(bad, 1)], "i int, j string")
    got = {r["i"]: r["r"] for r in df.select("i", context.validated_response(F.col("j")).alias("r")).collect()}
    assert tuple(got.pop(0)) == ("Ana", 0.5, True) and not any(got.values())


def test_answers_must_fit(spark):
    from lorewright.functions.text import name_key

    s = rows(spark, [(1, "narration", "Entró la Señora Zoe.", "Narrator", False), (1, "dialogue", "Hola", "Unknown", False)])
    ids = spark.createDataFrame([(2, ["Ana"], {"ana": "Ana", "la dama": "Ana"}, [("Ana", "la dama", 1)])], "row_id bigint, candidates array<string>, identities map<string,string>, aliases array<struct<name:string,alias:string,chapter:int>>")
    wanted = {("Ana", False): "Ana", ("La DAMA", False): "Ana", ("Luis", False): None, ("Unknown", False): "Unknown", ("zoé", True): "zoé", ("Ana", True): None, ("Luis", True): None}
    for (speaker, new), out in wanted.items():
        a = spark.createDataFrame([(2, (speaker, 0.9, new))], "row_id bigint, answer struct<speaker:string,confidence:double,is_new:boolean>")
        got = [r["accepted"] for r in context.accepted_answers(a, s, ids, name_key).collect()]
        assert got == ([out] if out else []), speaker
    (p,) = [r["prompt"] for r in context.render_prompt(s, ids).collect()]
    assert "CANDIDATES Ana\nALIASES la dama = Ana (1)\nBEFORE\n[narration | Narrator] Entró" in p and "SEGMENT dialogue\nHola" in p
