import itertools

import regex

from lorewright.llm import p4_lookalikes as P


def test_what_changes_the_look():
    same = ["Ｔｏｍáｓ", "Tomás", "Tomás", "To​m­ás", "Тоmás", "Tοmás"]
    assert len({P.look_key(x) for x in same}) == 1
    assert P.look_key("a b") == P.look_key("a b") == "a b" and P.look_key("ﬁn") == "fin" and P.look_key("прячет") == P.look_key("пpячeт")
    for a, b in (("Tomás", "tomás"), ("Tomás", "Tomas"), ("x²", "x2"), ("l", "I"), ("0", "O"), ("a!", "a."), ("’", "'"), ("a  b", "a b")):
        assert P.look_key(a) != P.look_key(b), (a, b)


def test_plain_characters_look_only_like_themselves():
    plain = regex.compile(f"[{P.PLAIN_CLASS}]")
    chars = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000 and plain.match(chr(i)) and i != 0x138]
    assert all(P.look_key(c) == c for c in chars)


def test_letters_of_one_script_look_only_like_themselves():
    for script, letters in P.ALPHABETS.items():
        looks = [P.look_key(c) for c in letters]
        assert all(len(x) == 1 for x in looks) and len(set(looks)) == len(letters)
        assert all(P.script_of(c) in (script, P.LATIN) for c in letters)
        assert all(P.table_form(P.look_key(w), script) == w for w in {P.CYRILLIC: ["прячет", "колокол"], P.GREEK: ["μέτρησε", "υπόγειο"]}[script])


def test_the_automaton_reads_raw_characters():
    trie = P.Trie({"Tomás": 5, "Tomas": 1})
    assert trie.walk("Tοmа\u0301\u200bs") == (0.0, -5, "Tomás") and trie.walk("Ｔｏｍａｓ") == (0.0, -1, "Tomas")
    assert trie.walk("T\u200bo\u00adm\u2060as")[2] == "Tomas" and trie.walk("Tomes") is None and trie.walk("tomas") is None
    # Other edits cost one each.
    trie = P.Trie({"Tomas": 1})
    assert trie.walk("Tomes", 1)[::2] == (1.0, "Tomas") and trie.walk("Toma", 1)[2] == trie.walk("Tomaas", 1)[2] == "Tomas" and trie.walk("Tms", 1) is None
    russian = P.Trie({"прячет": 3}, P.CYRILLIC)
    assert russian.walk("пpячeт") == (0.0, -3, "прячет")


def test_one_unlisted_letter_within_the_budget():
    word = "instrument"
    trie = P.Trie({word: 2})
    strange = word.replace("m", "м")  # a small letter that no table lists
    assert P.unlisted(strange, P.LATIN) and trie.walk(strange, P.BUDGET) == (0.5, -2, word) and trie.walk(strange) is None
    assert trie.walk("instruмeпt", P.BUDGET) is None and not P.unlisted("instruмeпt", P.LATIN) and not P.unlisted("мap", P.LATIN)
    assert trie.walk("instrumemt", P.BUDGET) is None


def test_unlisted_letters_in_a_table(spark):
    texts = [(1, "El instrument suena"), (2, "El instruмent suena"), (3, "El instrumemt suena"), (4, "El мap suena"), (5, "Я прячу колокол"), (6, "Я пpячу кoлoкoл"), (7, "Αλεξάνδρα μετρά"), (8, "Aλεξάνδρα μετpά"), (9, "a‐b"), (10, "a-b"), (11, "a\r\nb"), (12, "a\nb"), (13, "é\r\nb"), (14, "é\nb"), (15, "с о р"), (16, "c o p")]
    df = spark.createDataFrame([(i, 1, t) for i, t in texts], "row_id bigint, book_id int, text string")
    assert {tuple(r) for r in P.lookalike_pairs(df, "row_id", "text", ["book_id"]).collect()} == {(1, 2), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16)}
    forms = {r["row_id"]: (r["doubtful"], r["canonical"]) for r in P.canonical_texts(df, "row_id", "text").collect()}
    assert forms[5] == (False, "Я прячу колокол") and forms[7] == (False, "Αλεξάνδρα μετρά") and forms[2] == (True, "El instrument suena") and forms[6][1] == forms[5][1] and forms[8][1] == forms[7][1]


def test_pairs_equal_brute_force(spark):
    texts = ["Hola Tomás", "Hola Tomás", "Hola Тomás", "hola Tomás", "Hola Tomás", "", None, "​", " ", "прячет ключ", "пpячет ключ", "ｶﾞ", "ガ", "x" * 3000, "x" * 2999 + "​x", "a\nb"]
    rows = [(i, i % 2, t, "z") for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "row_id bigint, book_id int, text string, look string")
    got = {tuple(r) for r in P.lookalike_pairs(df.drop("look"), "row_id", "text", ["book_id"]).collect()}
    wanted = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] and b[2] and a[2] != b[2] and P.look_key(a[2]).strip() and P.look_key(a[2]) == P.look_key(b[2])}
    assert got == wanted and got
    forms = {r["row_id"]: r["canonical"] for r in P.canonical_texts(df, "row_id", "text").collect()}
    assert forms[0] == forms[1] == forms[2] == "Hola Tomás" and forms[6] is None and forms[9] == forms[10] == "прячет ключ" and len(forms) == len(rows)
    assert P.lookalike_pairs(df.where("false").drop("look"), "row_id", "text", ["book_id"]).count() == 0
