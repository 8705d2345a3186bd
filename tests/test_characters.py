import random

from pyspark.sql import functions as F

from lorewright.functions.text import name_key
from lorewright.operators import characters as C
from lorewright.operators import edits, incremental, review, voices
from lorewright.plans import fold
from tests.test_segments import rows

PEOPLE = "row_id bigint, book_id bigint, char_id string, canonical_name string, first_seen_chapter int, importance string, pending boolean, voice_id string, voice_manual boolean"


def cast(spark, *people):
    return spark.createDataFrame([(i, 1, f"char_{i:06d}", n, s, "minor", False, v, m) for i, (n, s, v, m) in enumerate(people, 1)], PEOPLE)


def aliases(spark, *items):
    return spark.createDataFrame([(1, c, n, k) for c, n, k in items], "book_id bigint, char_id string, name string, known_from_chapter int")


def test_alias_is_unknown_before_its_chapter(spark):
    p = cast(spark, ("Narrator", None, None, False), ("Sunny", 1, None, False))
    names = C.names_over_time(p, aliases(spark, ("char_000002", "Perdido de la Luz", 3), (None, "suelto", 1)))
    s = rows(spark, [(2, "dialogue", "a", "perdido de la luz", False), (3, "dialogue", "a", "PERDIDO de la Luz", False), (1, "dialogue", "a", None, False), (1, "dialogue", "a", "Unknown", False)])
    got = {r["row_id"]: r["char_id"] for r in C.alias_lookup(s, names).collect()}
    assert got == {1: None, 2: "char_000002"}


def test_mentions_match_a_plain_model(spark):
    random.seed(2)
    people = ["Ana", "Ana Luz", "Luz", "El Gran Sol"]
    p = cast(spark, *((n, 1, None, False) for n in people))
    texts = [" ".join(random.choice(["Ana", "Luz", "el", "gran", "Sol", "anaconda", "ANA"]) for _ in range(12)) for _ in range(40)]
    s = rows(spark, [(1, "narration", t, "Narrator", False) for t in texts] + [(1, "narration", None, "Narrator", False), (1, "narration", "", "Narrator", False)])
    got = {(r["row_id"], r["char_id"]): r["n"] for r in C.mentions(s, C.names_over_time(p, aliases(spark, ("char_000001", "ana luz", 1)))).collect()}
    wanted = {}
    for i, t in enumerate(texts, 1):
        w = [x.strip(",") for x in t.lower().split()]
        for j, n in enumerate(people, 1):
            names = sorted({n.lower(), *(["ana luz"] if j == 1 else [])}, key=len, reverse=True)
            k = at = 0
            while at < len(w):
                hit = next((len(x.split()) for x in names if w[at : at + len(x.split())] == x.split()), 0)
                k, at = k + bool(hit), at + (hit or 1)
            if k:
                wanted[(i, f"char_{j:06d}")] = k
    assert got == wanted


def test_mentions_of_long_names(spark):
    """Names of more than eight words are mentioned like any other; hidden characters inside a name split it too."""
    title, split = "La Muy Noble y Leal Guardia del Puerto de Marlosa", "Gi\ufeffd\u00ade\u200con S\u2060o\u2060lbr\u200bi\u2060r\u2060el"
    p = cast(spark, (title, 1, None, False), (split, 1, None, False), ("Ana", 1, None, False))
    s = rows(spark, [(1, "narration", f"Llegó {title}; {title.upper()}.", "Narrator", False), (1, "narration", f"Ana vio a {split}.", "Narrator", False), (1, "narration", "La Muy Noble y Leal Guardia", "Narrator", False)])
    got = {(r["row_id"], r["char_id"]): r["n"] for r in C.mentions(s, C.names_over_time(p, aliases(spark))).collect()}
    assert got == {(1, "char_000001"): 2, (2, "char_000002"): 1, (2, "char_000003"): 1}


def test_statistics_and_importance(spark):
    p = cast(spark, ("Narrator", None, None, False), ("Sunny", 1, None, False))
    s = rows(spark, [(1, "dialogue", "Hola", "Sunny", False), (1, "narration", "Sunny calló.", "Narrator", False), (2, "narration", "Vino Sunny.", "Narrator", False)])
    r = C.character_statistics(C.activity_events(s, C.names_over_time(p, aliases(spark)))).collect()
    assert [(x["dialogue_count"], x["mention_count"], list(x["chapters"]), x["first_chapter"], x["last_chapter"], len(x["activity"])) for x in r] == [(1, 2, [1, 2], 1, 2, 3)]
    df = spark.createDataFrame([(35, 0, 1, False), (5, 0, 1, False), (0, 1, 1, False), (0, 0, 0, False), (99, 0, 9, True)], "d int, m int, c int, p boolean")
    assert [x[0] for x in df.select(C.importance(F.col("d"), F.col("m"), F.col("c"), F.col("p"))).collect()] == ["major", "supporting", "minor", "unknown", "unknown"]


def test_duplicates(spark):
    p = cast(spark, ("Narrator", None, None, False), ("María", 1, None, False), ("María López", 1, None, False), ("Daniel Ruiz", 1, None, False), ("Daniela Ruiz", 1, None, False))
    assert {tuple(r)[1:] for r in C.duplicate_tokens(p).collect()} == {("char_000002", "char_000003")}
    assert ("char_000004", "char_000005") in {(r["left_id"], r["right_id"]) for r in C.duplicate_ratio(p).collect()}


def test_short_duplicates_without_a_common_bigram(spark):
    p = cast(spark, ("Narrator", None, None, False), ("ハル", 1, None, False), ("ハイル", 1, None, False), ("Al", 1, None, False), ("Ail", 1, None, False), ("Lo", 1, None, False))
    got = {(r["left_id"], r["right_id"]): r["ratio"] for r in C.duplicate_ratio(p).collect()}
    assert got == {("char_000002", "char_000003"): 0.8, ("char_000004", "char_000005"): 0.8}


def test_merge_rename_and_overrides(spark):
    p = cast(spark, ("Narrator", None, "v0", False), ("Ana", 3, None, False), ("Anna", 1, "v2", True))
    a = aliases(spark, ("char_000003", "Anita", 2), ("char_000002", "la Dama", 1))
    wanted = spark.createDataFrame([(1, "char_000003", "char_000002"), (1, "char_000001", "char_000002"), (1, "char_000002", "char_000002")], "book_id bigint, source_id string, target_id string")
    merged, names = edits.merge(p, a, wanted, known_from=2)
    got = {r["char_id"]: r for r in merged.collect()}
    assert set(got) == {"char_000001", "char_000002"} and (got["char_000002"]["canonical_name"], got["char_000002"]["first_seen_chapter"], got["char_000002"]["voice_id"]) == ("Ana", 1, "v2")
    assert {(r["name"], r["known_from_chapter"]) for r in names.collect()} == {("Anna", 2), ("Anita", 2), ("la Dama", 1)}
    renames = spark.createDataFrame([(1, "char_000002", " Anabel "), (1, "char_000003", " ")], "book_id bigint, char_id string, new_name string")
    people, old = edits.rename(p, renames)
    assert {r["canonical_name"] for r in people.collect()} == {"Narrator", "Anabel", "Anna"} and [r["name"] for r in old.collect()] == ["Ana"]
    s = rows(spark, [(1, "dialogue", "a", "Unknown", False), (1, "dialogue", "b", "Ana", False)])
    out = {r["row_id"]: r for r in edits.override_speakers(s, spark.createDataFrame([(1, "Ana"), (2, "narrator"), (2, " ")], "row_id bigint, speaker string")).collect()}
    assert (out[1]["speaker"], out[1]["confidence"], out[1]["resolution_method"]) == ("Ana", 1.0, "manual") and out[2]["speaker"] == "Ana"


def test_register(spark):
    p = cast(spark, ("Narrator", None, None, False), ("Ana", 1, None, False))
    wanted = spark.createDataFrame([(1, "ana", 2), (1, " Luis  Paz", 4), (1, "luis paz", 3), (1, "Unknown", 1), (1, "", 1), (2, "Eva", 1)], "book_id bigint, name string, chapter int")
    assert {(r["book_id"], r["char_id"], r["canonical_name"], r["first_seen_chapter"]) for r in edits.register_names(p, wanted).collect()} == {(1, "char_000003", "luis paz", 3), (2, "char_000001", "Eva", 1)}


def resolved(spark, items, **kw):
    return [(r["speaker"], r["resolution_method"]) for r in fold.resolve_speakers(rows(spark, items), **kw).orderBy("row_id").collect()]


def test_fold_rules_and_turns(spark):
    d, n = "dialogue", "narration"
    items = [(1, d, "uno", "Unknown", False), (1, n, "dijo María.", "Narrator", False), (1, d, "dos", "Unknown", False), (1, n, "respondió Pedro.", "Narrator", False), (1, d, "tres", "Unknown", False), (1, n, "dijo María.", "Narrator", False), (1, d, "cuatro", "Unknown", False)]
    got = resolved(spark, items)
    assert [x[0] for x in got] == ["María", "Narrator", "Pedro", "Narrator", "María", "Narrator", "Pedro"] and got[-1][1] == "conversation"
    three = items[:4] + [(1, d, "x", "Unknown", False), (1, n, "dijo Luis.", "Narrator", False), (1, d, "y", "Unknown", False)]
    assert resolved(spark, three)[-1][0] == "Unknown"


def test_fold_remote_answers(spark):
    items = [(1, "narration", "Entró Zoe.", "Narrator", False), (1, "dialogue", "hola", "Unknown", False)]
    new = resolved(spark, items, resolver=lambda c: {"speaker": "Zoe", "confidence": 0.9, "is_new_character": True})
    assert new[1] == ("Unknown", "llm")
    refused = resolved(spark, items, resolver=lambda c: {"speaker": "Nadie", "confidence": 0.9, "is_new_character": False})
    assert refused[1] == ("Unknown", "unknown")


def test_fold_key_equals_the_column_function(spark):
    names = ["María  Ló", "STRASSE ß", "Ａｂ"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(name_key(F.col("n"))).collect()] == [fold.key_of(n) for n in names]


def test_changes_and_warnings(spark):
    old = rows(spark, [(1, "dialogue", "a", "A", False), (2, "dialogue", "b", "A", False), (3, "dialogue", "c", "A", False)])
    new = rows(spark, [(1, "dialogue", "a", "A", False), (2, "dialogue", "b", "B", False), (3, "dialogue", "c", "A", False), (4, "dialogue", "d", "A", False)])
    changed = incremental.changed_chapters(incremental.fingerprints(old), incremental.fingerprints(new))
    assert {(r["chapter"], r["change"]) for r in changed.collect()} == {(2, "changed"), (4, "new")}
    chapters = spark.createDataFrame([(1, c, s) for c, s in ((1, "analyzed"), (2, "analyzed"), (3, "analyzed"), (5, "not_analyzed"))], "book_id bigint, chapter int, status string")
    assert [tuple(r) for r in incremental.continuity_warnings(chapters, changed).collect()] == [(1, 3, 2)]


def test_review_pages_and_voices(spark):
    s = rows(spark, [(1, "dialogue", "x", "A", False)] * 55)
    assert review.page(s, 2).count() == 5 and review.page(s, 99).count() == 5 and review.page(s, 1).count() == 50 and review.page(s.where("false"), 1).count() == 0
    v = spark.createDataFrame([("a",), ("b",)], "voice_id string")
    turn = rows(spark, [(1, "dialogue", "x", "María", False), (1, "narration", "x", "Narrator", False), (1, "dialogue", "x", "Pedro", False)])
    assert {(r["speaker"], r["voice_id"]) for r in voices.round_robin(turn, v).collect()} == {("Narrator", "a"), ("María", "b"), ("Pedro", "a")}


def test_mentions_equal_a_regular_expression(spark, monkeypatch):
    """The literal name between characters that belong to no word, the longest first, at the leftmost place, without overlap."""
    import re

    rng = random.Random(8)
    people = {"char_000001": ["Jean-Paul", "Jean"], "char_000002": ["Jean Paul", "Paul"], "char_000003": ["Álvaro", "Don Álvaro Ruiz", "álvaro ruiz"], "char_000004": ["???", "El ???"], "char_000005": ["(la Dama", "Dama Jr."], "char_000006": ["A.", "a a", "a a a"], "char_000007": ["गौरी"]}
    p = cast(spark, *((n[0], 1, None, False) for n in people.values()))
    a = aliases(spark, *((c, n, 1) for c, own in people.items() for n in own[1:]))
    bits = ["Jean", "-", " ", "Paul", "Álvaro", "ALVARO", "Ruiz", "don", "???", "?", "El", "(", "la", "Dama", "Jr.", "Jr", "A.", "a", "b", "गौरी", "गौ", ",", "_"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(14)) for _ in range(150)]
    s = rows(spark, [(1, "narration", t, "Narrator", False) for t in texts])
    wanted = {}
    for i, t in enumerate(texts, 1):
        for c, own in people.items():
            pattern = "|".join(map(re.escape, sorted({fold.key_of(n) for n in own}, key=len, reverse=True)))
            if n := len(re.findall(rf"(?<!\w)(?:{pattern})(?!\w)", fold.key_of(t))):
                wanted[(i, c)] = n
    names = C.names_over_time(p, a)
    assert {(r["row_id"], r["char_id"]): r["n"] for r in C.mentions(s, names).collect()} == wanted and len(wanted) > 200
    monkeypatch.setattr(C, "fits", lambda *x, **k: False)
    assert {(r["row_id"], r["char_id"]): r["n"] for r in C.mentions(s, names).collect()} == wanted


def test_evidence_of_aliases_and_rebuilt_profiles(spark):
    p = cast(spark, ("Narrator", None, None, False), ("Ana", 1, None, False), ("Mariana", 1, None, False), ("La Dama", 1, None, False))
    s = rows(spark, [(2, "narration", "Vino Mariana, también conocida como La Dama Gris.", "Narrator", False), (1, "narration", "Ana, llamada La Dama, calló.", "Narrator", False), (1, "dialogue", "Ana, llamada Eva.", "Ana", False), (1, "dialogue", "x", "Zoe", False), (3, "dialogue", "x", "Unknown", False)])
    found = C.alias_evidence(s, p)
    # A name that ends another one is evidence too, as it is where names are searched in the text.
    assert {(r["char_id"], r["alias"], r["known_from"]) for r in found.collect()} == {("char_000002", "La Dama", 1), ("char_000003", "La Dama Gris", 2)}
    assert [tuple(r)[1:] for r in C.duplicate_aliases(found, C.names_over_time(p, aliases(spark)), p).collect()] == [("char_000002", "char_000004")]
    assert [(r["char_id"], r["canonical_name"], r["first_seen_chapter"]) for r in C.rebuild_profiles(s).orderBy("char_id").collect()] == [("char_000001", "Narrator", None), ("char_000002", "Ana", 1), ("char_000003", "Zoe", 1)]


def test_candidates_are_active_known_and_not_pending(spark):
    p = cast(spark, ("Narrator", None, None, False), ("Ana", 1, None, False), ("Luis", 1, None, False), ("Eva", 3, None, False), ("Zoe", 1, None, False)).withColumn("pending", F.col("canonical_name") == "Zoe")
    s = rows(spark, [(1, "narration", "Ana y Zoe y Eva entran.", "Narrator", False), (1, "narration", "Silencio.", "Narrator", True), (1, "dialogue", "Hola", "Luis", False), (1, "dialogue", "Sí", "Unknown", False), (1, "narration", "Ana.", "Narrator", False)])
    got = {(r["row_id"], r["name"]): r["score"] for r in C.candidate_scores(s, C.names_over_time(p, aliases(spark)), p).collect()}
    # Ana is mentioned after, and was active before, though in another scene; Luis spoke before and is active.
    assert got == {(3, "Ana"): 3.0, (4, "Ana"): 3.0, (4, "Luis"): 3.0}
