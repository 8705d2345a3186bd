import pytest

from lorewright.llm import p5_sentences as P

CASES = [
    ("es", "A las 5 p. m. Isabel perdió el mapa.|Llegaron a las 7 a. m.|Gregorio dijo que no."),
    ("es", "¡¿Cómo?!|Eso fue el 3.er aviso.|¿De veras? preguntó Inés.|(Nadie más lo oyó.)|Rosario pagó 1.250,50 escudos, etc.|Luego se marchó."),
    ("es", "Esperó un rato...|Gregorio nunca volvió.|No sé... quizá mañana.|El archivo registro_2.1.txt decía que D. Isabel vive en la Avda. Sol, n.º 4."),
    ("en", "They arrived at 7 a.m.|Erin said no.|At 5 p.m. Erin lost it.|Mr. X and Co. since vol. 9.|J. R. Q lived on St. Eric Lane, no. 4.|Oh!|“Stop! Nobody move!” shouted Eric."),
    ("en", "NOBODY SAW.|“REALLY?” ASKED ERIN, WHO SAT.|I DON'T KNOW... MAYBE NOT."),
    ("de", "Der 2. Bote kam um 7 Uhr bzw. um 8.|Heinrich schwieg.|Am 3. Mai fand Fr. Zan das, z. B. bei J. R. Q, d. h. nichts.|„Halt! Niemand rührt es an!“, rief Josef."),
    ("fr", "Qui ?|« Halte ! Que nul ne touche ! » cria Élisabeth.|En 300 av. J.-C., dit-on, M. X et J.-P. Y citent la clé."),
    ("ru", "Дмитрий хранит гвозди и т. д.|Потом зал пустеет.|В 1240 г. до н. э., т. е. давно.|«Стой! Никто!» — кричит Глеб."),
    ("el", "Ο κ. Καμπανέλης μέτρησε 3,75 μέτρα π.χ. στο υπόγειο.|Ποιος έκρυψε;|Κανείς."),
    ("hi", "डॉ. दीपांकन ने 3.75 गज नापा।|“रुको! कोई न छुए!” नीरजा ने कहा।|अचानक।"),
    ("ar", "قاس د. الحجاري 3.75 أمتار.|«قف! لا يلمس أحد!» صاح رامسين.|آه!|ما كان ذلك؟"),
    ("zh", "“站住！谁也别碰！”望舒照例喊道。|马上放下！|我不知道……也许。|绳长3.75米。"),
    ("ja", "わからない…たぶんリクが包んだ。|「待て！触るな！」とリクは叫んだ。|（誰も聞いていなかった。）|えっ！"),
    ("th", "เวลา 7 โมงเช้าพบหีบในหมอก|เชือกยาว 3.75 เมตร"),
    (None, "Una frase sin marca"),
]


@pytest.mark.parametrize("lang,marked", CASES)
def test_sentences(lang, marked):
    glue = "" if lang in ("zh", "ja") else " "
    text = marked.replace("|", glue)
    ends, at = [], 0
    for s in marked.split("|"):
        ends.append(at + len(s))
        at += len(s) + len(glue)
    assert P.sentence_ends(text, lang) == ends


def test_hidden_characters_and_other_blanks():
    assert P.sentence_ends("One.\u2005\u200bT\u200bwo.", "en") == [4, 11]


def test_table(spark):
    rows = [(1, "Uno. Dos.", "es"), (2, "", "es"), (3, None, None), (4, " ", None), (5, "palabra. Otra " * 5000, "ES"), (6, "...", "xx")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "row_id bigint, text string, lang string, ends int")
    got = {r["row_id"]: r["ends"] for r in P.split_sentences(df, "row_id", "text", "lang").collect()}
    assert got[1] == [4, 9] and got[4] == [1] and got[6] == [3] and set(got) == {1, 4, 5, 6} and got[5][-1] == len(rows[4][1]) and len(got[5]) == 5001
    assert P.split_sentences(df.where("false"), "row_id", "text", "lang").count() == 0


@pytest.mark.parametrize("text", ["Նա եկավ։|Նա գնաց։", "እሱ መጣ።|እሷ ሄደች።", "သူလာသည်။|သူသွားသည်။", "គាត់មក។|គាត់ទៅ។", "ᠪᠢ ᠢᠷᠡᠪᠡ᠃|ᠪᠢ ᠶᠠᠪᠤᠪᠠ᠃", "ܗܘ ܐܬܐ܂|ܗܝ ܐܙܠܬ܂", "One﹖|Two﹗"])
def test_terminators_of_other_scripts(text):
    parts = text.split("|")
    assert P.sentence_ends(" ".join(parts), None) == [len(parts[0]), len(" ".join(parts))]


@pytest.mark.parametrize("piece", ["One. Two! “Three.” said he. ", "At 5 p.m. Erin lost no. 4 of J. R. Q. ", "Der 2. Bote kam. ", "“Halt! ", "no end: “a”, ", "ไป มา ", "   ", "\n \n", "Նա եկավ։ ", "bo. "])
def test_time_grows_with_the_text(piece):
    """A megabyte takes seconds, whatever it is made of."""
    import time

    text = piece * (1_000_000 // len(piece))
    began = time.process_time()
    ends = P.sentence_ends(text, "de" if "Der" in piece else None)
    assert ends[-1] == len(text) and time.process_time() - began < 40


def test_a_text_in_pieces_is_split_alike():
    piece = "One. Two! “Three.” said he. At 5 p.m. Erin lost no. 4 of J. R. Q. Lee. "
    (first, *_), many = [P.sentence_ends(piece, "en")], P.sentence_ends(piece * 50, "en")
    inner = [e for e in first[:-1]]
    assert many == [k * len(piece) + e for k in range(50) for e in [*inner, len(piece) - 1]][:-1] + [50 * len(piece)]
