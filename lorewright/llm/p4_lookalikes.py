"""Problem 4: one consistent form for text that looks the same.

Method: clean words of the corpus are put into vocabulary tries, character by character. A weighted edit
automaton walks the raw characters of each doubtful token through its trie: an invisible character, or a step onto a
look-alike of the letter, costs nothing; a letter of another script that no table lists costs half; any other edit costs one.
``BUDGET`` allows one such unlisted letter. Of the words reached the canonical spelling is selected
(least cost, most frequent, lowest code points); tokens that reach no word are normalised by table.
Texts are equal-looking when their canonical forms are equal.

A text has one script, by its unmistakable letters, which all texts of equal look share. A *clean* token is made of characters
of that script that the table leaves alone: two different clean tokens never look the same, so they stand for themselves
and only other tokens are walked; texts of clean tokens (most of a corpus, whatever its script) are neither exploded nor shuffled.

What changes the look: case, accents, punctuation marks, raised digits, different ASCII
characters, the number of spaces. What does not: invisible characters, the kind of space, of hyphen and of line end, width,
composition, ligatures, the script of a look-alike letter.

Defined results: null texts have a null form; texts without a visible character have the
empty form and make no pair; repeated rows make no pair among themselves (same string). Ids are unique.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.session import cut, exploded, join_hot, spread, table

# Letters of other scripts that look like the Latin letter before them.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιӏ", "j": "јϳ", "k": "κк", "l": "ⅼ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛգ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
_TWIN = {ord(c): k for k, v in LOOKALIKES.items() for c in v}
_TWIN |= {0x2010: "-", 0x2011: "-"}  # hyphens
_TWIN |= {0x41B: "Л", 0x39B: "Λ", 0x41F: "Π", 0x3A0: "Π", 0x413: "Γ", 0x393: "Γ", 0x424: "Φ", 0x3A6: "Φ", 0x2126: "Ω"}

#: Java class of characters that the table leaves alone, without Greek, Cyrillic and combining marks, and the same without Latin letters.
PLAIN_CLASS = r" !-~\n¡-¬®-ſ‒-‟†-…‰-⁞₠-₿℃™─-╿☀-➿、-〿ぁ-ゖゝ-ゟァ-ヿ一-鿿ก-๏๐-๛ء-ْ٠-ۓऀ-ॗॠ-ॿ"
_NO_LETTERS = r" !-@\[-`{-~\n¡-©«¬®-¹»-¿×÷‒-‟†-…‰-⁞₠-₿℃™─-╿☀-➿、-〿"
_SPACE = re.compile("[ \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
LATIN, CYRILLIC, GREEK = "Latin", "Cyrillic", "Greek"
#: The letters of the two other scripts in composed form; within one of them no two look the same, and each looks like one character (so without Eta with an accent).
_RANGES = {CYRILLIC: "А-яЁё", GREEK: "Α-ΡΣ-ώΆΈΊΌΎΏΐ"}
ALPHABETS = {s: "".join(c for c in map(chr, range(0x370, 0x460)) if re.match(f"[{r}]", c)) for s, r in _RANGES.items()}
#: Capitals that Greek and Cyrillic share.
_SHARED = "ΠΓΦ"
#: A letter of a foreign script that is not listed as a look-alike, and any other edit.
UNLISTED, EDIT = 0.5, 1.0
BUDGET = 0.5
#: Fewest letters of a token in which one unlisted letter is taken for a look-alike.
LEAST_LETTERS = 6


@functools.lru_cache(maxsize=1 << 16)
def symbols(char: str) -> tuple[str, ...]:
    """What one character shows: nothing, or its look-alike classes, letter before marks."""
    out: list[str] = []
    for c in unicodedata.normalize("NFD", char):
        kind = unicodedata.category(c)
        if kind in ("Cf", "Cc") and c not in "\n\r\t" or c in "͏ᅟᅠㅤﾠ" or "︀" <= c <= "️":
            continue
        if c == "\r":  # a line end that no other follows: see ``lines``
            out.append("\n")
            continue
        if kind == "Zs" or c == "\t":
            out.append(" ")
            continue
        tag = unicodedata.decomposition(c)
        if tag.startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ":
            for d in unicodedata.normalize("NFKD", c):
                out.extend(symbols(d))
            continue
        out.append(_TWIN.get(ord(c), c))
    return tuple(out)


def lines(text: str) -> str:
    """With one kind of line end."""
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def shown(text: str) -> list[str]:
    """Look-alike classes of a text in canonical order."""
    flat = "".join(s for c in lines(text) for s in symbols(c))
    return list(unicodedata.normalize("NFD", flat)) if not flat.isascii() else list(flat)


def look_key(text: str) -> str:
    """Equal for texts that look the same."""
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", "".join(shown(text)))


@functools.lru_cache(maxsize=1 << 14)
def sure(symbol: str) -> str | None:
    """The script that a symbol gives away."""
    if not symbol.isalpha() or symbol in LOOKALIKES or symbol in _SHARED:
        return None
    name = unicodedata.name(symbol, "").split(" ")[0].title()
    return name if name in (LATIN, CYRILLIC, GREEK) else None


def script_of(text: str) -> str:
    """The script of most unmistakable letters; the same for all texts of equal look."""
    count = {LATIN: 0, GREEK: 0, CYRILLIC: 0}
    for c in shown(text):
        if c > "\x7f" and (k := sure(c)):
            count[k] += 1
        elif c.isalpha() and c not in LOOKALIKES and c <= "\x7f":
            count[LATIN] += 1
    return max(count, key=count.get)


@functools.lru_cache(maxsize=None)
def _clean(script: str) -> re.Pattern:
    return re.compile(f"[{PLAIN_CLASS}]*" if script == LATIN else f"[{_NO_LETTERS}{_RANGES[script]}]*")


@functools.lru_cache(maxsize=None)
def _back(script: str) -> dict[int, str]:
    """Look of a letter -> the letter of the script."""
    return {ord(look_key(c)): c for c in ALPHABETS.get(script, "")}


def table_form(token: str, script: str = LATIN) -> str:
    """Without a vocabulary: visible, composed, of full width, look-alikes in the text's script where the token gives it away, else Latin."""
    look = look_key(token)
    return look.translate(_back(script)) if any(sure(c) == script for c in look) else look


def unlisted(token: str, script: str) -> bool:
    """Whether a token holds just one letter of another of the three scripts, or of one that imitates them, that no table lists."""
    letters = [c for c in shown(token) if c.isalpha()]
    return len(letters) >= LEAST_LETTERS and sum(_foreign(c, script) for c in letters) == 1


@functools.lru_cache(maxsize=1 << 14)
def _foreign(symbol: str, script: str) -> bool:
    if not symbol.isalpha() or symbol in LOOKALIKES or symbol in _SHARED:
        return False
    name = unicodedata.name(symbol, "").split(" ")[0]
    return name != script.upper() and name in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "DESERET")


@functools.lru_cache(maxsize=1)
def _twins() -> dict[str, str]:
    """Class -> the raw characters that show it."""
    out: dict[str, str] = {}
    for c in [*map(chr, _TWIN), *"".join(ALPHABETS.values())]:
        for d in unicodedata.normalize("NFD", c):
            own = symbols(d)
            if len(own) == 1 and d not in out.setdefault(own[0], own[0]):
                out[own[0]] += d
    return out


def _raw(token: str) -> str:
    """The characters that the automaton reads: wide forms and ligatures opened, marks after their letters."""
    if token.isascii():
        return token
    opened = "".join(unicodedata.normalize("NFKD", c) if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ" else c for c in token)
    return unicodedata.normalize("NFD", opened)


class Trie:
    """Vocabulary words by raw characters; where a word ends, its node holds (-frequency, word) under None."""

    def __init__(self, words: dict[str, int], script: str = LATIN):
        self.root, self.script = {}, script
        for word, n in words.items():
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            node[None] = min((-n, word), node.get(None, (1, "")))

    def walk(self, token: str, budget: float = 0.0) -> tuple[float, int, str] | None:
        """(cost, -frequency, word) of the best word within the budget.

        One state per node and character read, with its least cost.
        """
        twins = _twins()
        states = self._skips({id(self.root): (0.0, self.root)}, budget)
        for c in _raw(token):
            own = symbols(c)
            if not own:
                continue
            shape = own[0]
            step: dict[int, tuple[float, dict]] = {}

            def reach(node: dict, cost: float) -> None:
                if cost <= budget and cost < step.get(id(node), (budget + 1, None))[0]:
                    step[id(node)] = (cost, node)

            price = UNLISTED if _foreign(shape, self.script) else EDIT
            for cost, node in states.values():
                for v in twins.get(shape, shape):
                    if v in node:
                        reach(node[v], cost)
                if cost + price <= budget:
                    for v, child in node.items():
                        if v is not None and v.isalpha() >= (price == UNLISTED):
                            reach(child, cost + price)
                if cost + EDIT <= budget:
                    reach(node, cost + EDIT)
            states = self._skips(step, budget)
            if not states:
                return None
        return min(((cost, *node[None]) for cost, node in states.values() if None in node), default=None)

    @staticmethod
    def _skips(states: dict, budget: float) -> dict:
        """With the nodes that are reached by leaving letters of words out."""
        todo = list(states.values()) if budget >= EDIT else []
        while todo:
            cost, node = todo.pop()
            for v, child in node.items():
                if v is not None and cost + EDIT <= budget and cost + EDIT < states.get(id(child), (budget + 1, None))[0]:
                    states[id(child)] = (cost + EDIT, child)
                    todo.append(states[id(child)])
        return states


def _select(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: its words, and its doubtful tokens to be walked."""
    out = []
    for script, part in pdf.groupby("script"):
        words = part[part["word"]]
        trie = Trie(dict(zip(words["token"], words["n"])), script)
        for token, open_ in part.loc[~part["word"], ["token", "open"]].itertuples(index=False):
            if (hit := trie.walk(token, BUDGET if open_ else 0.0)) is not None:
                out.append((script, token, *hit))
    return pd.DataFrame(out, columns=["script", "token", "cost", "rank", "canonical"])


#: Distinct tokens that one trie is meant to hold.
SHARD_TOKENS = 20_000


def _script(text):
    """Script of a clean text, null for any other; a null text is clean."""
    # Most texts of Latin script hold no character beyond the first range, whose test is quick.
    plain = text.rlike(r"^[ -~\n]*$") | text.rlike(f"^[{PLAIN_CLASS}]*$")
    hit = lambda s: text.rlike(f"^[{_RANGES[s]}{_NO_LETTERS}]*$") & text.rlike("[" + "".join(c for c in ALPHABETS[s] if any(sure(x) == s for x in shown(c))) + "]")
    return F.when(text.isNull() | plain, LATIN).when(hit(CYRILLIC), CYRILLIC).when(hit(GREEK), GREEK)


def _look(token, script):
    """Look of a clean token, letter by letter."""
    alike = lambda s: F.translate(token, ALPHABETS[s], "".join(map(look_key, ALPHABETS[s])))
    return F.when(script == CYRILLIC, alike(CYRILLIC)).when(script == GREEK, alike(GREEK)).otherwise(token)


_HALVES = ("substring(look, 1, length(look) DIV 2)", "substring(look, length(look) DIV 2 + 1)")


def canonical_tokens(clean: DataFrame, doubtful: DataFrame) -> DataFrame:
    """script, token, canonical, n of every doubtful token; checkpointed.

    clean: texts with their script; doubtful: tokens with script and whether they are ``dirty``. A word is sent to the tries only if it
    has the look of a doubtful token, or, where that holds an unlisted letter, its length and one of its halves.
    """

    @F.pandas_udf("struct<look:string,open:boolean,table:string>")
    def look(tokens: pd.Series, scripts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"look": [look_key(t) for t in tokens], "open": [unlisted(t, s) for t, s in zip(tokens, scripts)], "table": [table_form(t, s) for t, s in zip(tokens, scripts)]})

    dirty = doubtful.where("dirty").groupBy("script", "token").agg(F.count(F.lit(1)).alias("n")).withColumn("_l", look("token", "script"))
    dirty = cut(dirty.select("script", "token", "n", "_l.look", "_l.open", "_l.table"))
    words = clean.select("script", F.explode_outer(F.split("text", " ", -1)).alias("token")).unionByName(doubtful.where("NOT dirty").select("script", "token")).where("token != ''")
    words = words.select("script", "token", _look(F.col("token"), F.col("script")).alias("look"))
    halves = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(h).alias("h"), F.length("look").alias("m")) for k, h in enumerate(_HALVES)]))
    shards = max(1, dirty.count() // SHARD_TOKENS)
    whole = F.pmod(F.xxhash64("script", "look"), F.lit(shards)).alias("shard")
    half = F.pmod(F.xxhash64("script", "x.k", "x.h", "x.m"), F.lit(shards)).alias("shard")
    wanted = dirty.groupBy("script", "look").agg(F.sum("n").alias("_w"))
    held = join_hot(words, wanted, ["script", "look"], "_w")
    parts = [
        held.groupBy("script", "look", "token").agg(F.count(F.lit(1)).alias("n")).select("script", "token", "n", whole, F.lit(True).alias("word"), F.lit(False).alias("open")),
        dirty.select("script", "token", "n", whole, F.lit(False).alias("word"), F.lit(False).alias("open")),
    ]
    if not dirty.where("open").isEmpty():
        opened = dirty.where("open").select("script", "token", "n", halves.alias("x")).select("script", "token", "n", "x", half)
        keys = cut(opened.groupBy("script", "x").agg(F.sum("n").alias("_w")))
        near = join_hot(words.select("script", "token", halves.alias("x")), keys, ["script", "x"], "_w")
        parts.append(near.groupBy("script", "token", "x").agg(F.count(F.lit(1)).alias("n")).select("script", "token", "n", half, F.lit(True).alias("word"), F.lit(False).alias("open")))
        parts.append(opened.select("script", "token", "n", "shard", F.lit(False).alias("word"), F.lit(True).alias("open")))
    both = functools.reduce(DataFrame.unionByName, parts)
    walked = both.groupBy("shard").applyInPandas(_select, "script string, token string, cost double, rank bigint, canonical string")
    best = walked.groupBy("script", "token").agg(F.min(F.struct("cost", "rank", "canonical")).alias("b"))
    return cut(dirty.join(best, ["script", "token"], "left").select("script", "token", F.coalesce("b.canonical", "table").alias("canonical"), "n"))


def canonical_texts(df: DataFrame, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """Id, ``doubtful``, ``canonical`` and carried columns of every row; only doubtful texts are shuffled. Ids are unique."""

    @F.pandas_udf("struct<script:string,tokens:array<struct<token:string,dirty:boolean>>>")
    def parted(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            script = script_of(t)
            own = _clean(script)
            out.append((script, [{"token": x, "dirty": not own.fullmatch(x)} for x in _SPACE.split(lines(t))]))
        return pd.DataFrame(out, columns=["script", "tokens"])

    rows = spread(df).select(F.col(id_col), F.col(text_col).alias("text"), _script(F.col(text_col)).alias("script"), *carried)
    clean = rows.where("script IS NOT NULL")
    doubtful = cut(rows.where("script IS NULL").select(id_col, *carried, parted("text").alias("p")).select(id_col, *carried, "p.*"))
    tokens = doubtful.select("script", F.explode("tokens").alias("x")).select("script", "x.*")
    names = canonical_tokens(clean.where("text IS NOT NULL").select("script", "text"), tokens)
    dirty = exploded(doubtful, [id_col, "script"], F.col("tokens"), "pos", "x").where("x.dirty").select(id_col, "script", "pos", F.col("x.token").alias("token"))
    mended = join_hot(dirty, names, ["script", "token"], "n").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pos", "canonical"))).alias("_m"))
    form = F.array_join(F.transform("tokens", lambda x, i: F.coalesce(F.element_at("_m", i), x.token)), " ")
    mended = doubtful.join(mended, id_col, "left").select(id_col, F.lit(True).alias("doubtful"), form.alias("canonical"), *carried)
    return clean.select(id_col, F.lit(False).alias("doubtful"), F.col("text").alias("canonical"), *carried).unionByName(mended)


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, within: list[str]) -> DataFrame:
    """Pairs of rows that share ``within`` and look the same but are different strings; every such pair is a row."""
    forms = canonical_texts(df.select(id_col, F.col(text_col), F.struct(*within).alias("_w"), F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(text_col, F.lit(3)).alias("b")).alias("raw")), id_col, text_col, "_w", "raw")
    look = forms.where(F.coalesce(F.trim("canonical"), F.lit("")) != "").select(id_col, "doubtful", "raw", F.struct("_w", F.xxhash64("canonical").alias("a"), F.xxhash64("canonical", F.lit(3)).alias("b")).alias("key"))
    a = cut(look.where("doubtful").select("key", F.col(id_col).alias("x"), F.col("raw").alias("rx")))
    # Only rows that have the key of a doubtful one travel.
    keys = a.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    b = join_hot(look.select("key", F.col(id_col).alias("y"), F.col("raw").alias("ry"), F.col("doubtful").alias("dy")), keys, ["key"], "_n")
    pairs = b.join(a, "key").where("rx != ry AND (NOT dy OR x < y)")
    return pairs.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as one: _id (item_table, row_id), book_id, chapter (null for names), text."""
    segments = table(spark, sf_dir, "segments", "row_id", "book_id", "chapter", "text").withColumn("item_table", F.lit("segments"))
    names = table(spark, sf_dir, "characters", "row_id", "book_id", "canonical_name").select("row_id", "book_id", F.lit(None).cast("int").alias("chapter"), F.col("canonical_name").alias("text"), F.lit("characters").alias("item_table"))
    return segments.unionByName(names).select(F.struct("item_table", "row_id").alias("_id"), "item_table", "book_id", "chapter", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike_pairs(_items(spark, sf_dir), "_id", "text", ["item_table", "book_id", "chapter"])
    return pairs.select("row_id_a.item_table", F.col("row_id_a.row_id").alias("row_id_a"), F.col("row_id_b.row_id").alias("row_id_b"))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every segment text and canonical name."""
    return canonical_texts(_items(spark, sf_dir), "_id", "text").select("_id.item_table", "_id.row_id", "canonical")


QUERIES = {"p4_found": p4_found, "p4_canonical": p4_canonical}
SQL: dict[str, str] = {}
