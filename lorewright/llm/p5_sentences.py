"""Problem 5: sentence boundaries in any language and script.

Method: the character-property sentence-break rules (terminators of every script,
closing marks, format characters that cling to what precedes them, no break
before lower case or inside numbers), tailored per language: suppressed abbreviations, initials,
ordinals, and quotations whose reporting clause follows or precedes them.

Defined results: null and empty texts have no sentence; any other text ends its last
sentence at its own end; ends count code points as stored. A blank text is one sentence.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm.p4_lookalikes import look_key
from lorewright.session import spread, table

# Abbreviations by language. "open" never ends a sentence, "number" not before a digit, "end" does before a new start.
ABBREVIATIONS = {
    "en": {"open": "mr mrs ms dr st prof rev gen col capt sgt lt hon messrs vs viz e.g i.e cf ave mt ft", "number": "no nos vol sec ch fig p pp art par", "end": "etc co inc ltd corp bros jr sr a.m p.m al jan feb mar apr jun jul aug sep sept oct nov dec u.s"},
    "es": {"open": "sr sra srta sres dr dra d dña prof avda av c gral cap lic ing ej vs hno hna fr ntra sto sta", "number": "n.º n.ª núm art pág págs vol cap p pp sec fig", "end": "etc cía cia a.m p.m ud uds vd s.a ee.uu a.c d.c"},
    "fr": {"open": "m mm mme mlle mgr dr pr me st ste av bd ex cf vs", "number": "n p pp art vol chap fig sect", "end": "etc cie j.-c apr"},
    "de": {"open": "dr fr hr prof st z.b d.h u.a i.d.r ca bzw vgl evtl ggf inkl bspw sog str geb", "number": "nr s bd kap abs art abb", "end": "usw etc co u.s.w u.dgl n.chr v.chr uhr"},
    "pt": {"open": "sr sra srta dr dra d dª dom prof profa av ex eng exmo cf vs", "number": "n.º n.ª núm art pág págs vol cap p pp fig", "end": "etc cia a.m p.m ltda s.a a.c d.c"},
    "ru": {"open": "г-н г-жа д-р проф им ул пр т.е т.к напр св ср см гр акад ген", "number": "стр гл рис табл п ст №", "end": "т.д т.п др пр г гг в вв н.э руб коп тыс млн"},
    "el": {"open": "κ κα κος κκ δρ καθ π.χ δηλ βλ αγ στρ οδ καπ", "number": "αρ σελ κεφ τομ", "end": "κ.λπ κλπ κ.ά κ.τ.λ μ.χ π.μ μ.μ"},
    "hi": {"open": "डॉ श्री प्रो पं सुश्री कु मो", "number": "सं पृ", "end": "आदि"},
    "ar": {"open": "د أ م ا ص.ب", "number": "ص رقم", "end": "إلخ الخ"},
}
# Verbs that report speech, and openers that carry on after an ellipsis; needed only where a text has no lower case.
REPORTING = "asked shouted said answered replied whispered cried murmured preguntó gritó dijo respondió contestó susurró exclamó murmuró demanda cria répondit dit fragte rief sagte antwortete flüsterte perguntou gritou disse respondeu спросил спросила кричит сказал сказала говорит ответил спрашивает отвечает φώναξε ρώτησε είπε απάντησε"
CARRY_ON = "maybe perhaps quizá quizás talvez peut-être vielleicht может ίσως"
ORDINAL_LEADS = "der die das dem den des am im vom zum zur ein eine einen einem einer jeder jeden ab bis seit nach"

_LANGS = {"eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "por": "pt", "rus": "ru", "ell": "el", "gre": "el", "hin": "hi", "ara": "ar", "jpn": "ja", "zho": "zh", "chi": "zh", "tha": "th"}
_COMMON = {k: frozenset(v.split()) for k, v in {"en": "the and of in to that was if by at", "es": "el la de que y los en por con sin del", "fr": "le la les et des du que dans sur au", "de": "der die das und den nicht mit von dem", "pt": "o a os da do que em com não uma na no"}.items()}

#: Most characters of a time of day that opens a sentence, and of what stands between an ordinal and the word before it.
OPENER = 200

_CF = r"[\p{Cf}\p{M}]*"
_CLOSE = r"[\"'”’»›)\]}】）」』〉》〕“\p{Pe}\p{Pf}]"
_MARK = regex.compile(rf"(?P<mark>(?:[.．。!！?？؟۔।॥｡⁉⁈‼…;;؛\p{{SB=STerm}}\p{{SB=ATerm}}](?:\p{{Cf}}|️)*)+)(?P<close>(?:{_CLOSE}(?:\p{{Cf}})*)*)(?P<gap>\s*)")
#: Sentence terminators of the scripts that the list above doesn't name.
_OTHER_TERM = regex.compile(r"(?![.．。!！?？؟۔।॥｡⁉⁈‼…;;؛]|⁇)\p{SB=STerm}")
_QUOTES = regex.compile(r"“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")
_LEAD = r"(?:[\s\p{Cf}\"'“”„‘’«»‹›「『（(\[¿¡—–\-*_]*)"
_NEXT = regex.compile(rf"{_LEAD}(?P<c>[^\s\p{{Cf}}])")
_WORD_BEFORE = regex.compile(r"(?:[\p{L}\p{M}\p{N}\p{Cf}][\p{L}\p{M}\p{N}\p{Cf}'’.ºª\-]*|№)\Z")
_TIME_OPENER = regex.compile(r"^[\W]*(?:(?:at|by|a|às|à|ao|en|um|gegen|vers|в|στις)\s+(?:\p{L}{1,4}\s+)?)[\d\p{No}:.,]+\s*[ap]\.?\s*m$", regex.I)
_THAI_GAP = regex.compile(r"(?<=[\p{L}\p{M}ฯๆ\"”’)!?.…][\p{Cf}]*)(?P<gap>\s+)(?=[\p{Cf}]*[\"“‘(]*\p{L})")
_HIDDEN = regex.compile(r"\p{Cf}")
_ACCENTS = regex.compile(r"[\u0300-\u036f]")
_LINE_END = regex.compile(r"(?<!\s)\s*(?:\r?\n|\u2028|\u2029)\s*")
_THAI = regex.compile(r"\p{Thai}")


@functools.lru_cache(maxsize=1 << 14)
def _folded(word: str) -> str:
    """Lower case first, so that a look-alike capital and its small letter meet; without accents."""
    out = look_key(_HIDDEN.sub("", word).lower())
    return out if out.isascii() else unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", out)))


#: After an abbreviation in a text without lower case: what hardly opens a sentence.
_FUNCTION_WORDS = frozenset(map(_folded, "desde since depuis seit de del y e and et und of da do с и και από".split()))


@functools.lru_cache(maxsize=64)
def _lists(lang: str) -> tuple[frozenset, frozenset, frozenset]:
    own = ABBREVIATIONS.get(lang, {})
    return tuple(frozenset(_folded(x) for x in own.get(k, "").split()) for k in ("open", "number", "end"))


_REPORTING, _CARRY_ON, _ORDINAL_LEADS = (frozenset(map(_folded, x.split())) for x in (REPORTING, CARRY_ON, ORDINAL_LEADS))
_SCRIPTS = [("th", regex.compile(r"\p{Thai}")), ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ar", regex.compile(r"\p{Arabic}")), ("ru", regex.compile(r"[\p{Cyrillic}]")), ("el", regex.compile(r"\p{Greek}"))]
_LATIN = regex.compile(r"\p{Latin}+")
_REPORTS_AFTER = regex.compile(r"[\p{Cf}]*(\s*)([,，、]|[—–-]\s*\p{Ll}|\p{Ll}|\p{Lo})")
_UNCASED = regex.compile(r"\p{Lo}")
_FIRST_WORD = regex.compile(r"\W*([\p{L}\p{M}-]+)")
_LEADS_IN = frozenset(":：,，")
_CLINGING = regex.compile(r"[\p{Cf}️]")
_WORD_AT = regex.compile(r"[\p{L}\p{M}'’-]+")
_LETTER_BEFORE = regex.compile(r"(?:^|[\s(,])(\p{L})[.．]\p{Cf}*\s*\Z")
_SINGLE = regex.compile(r"\p{L}\p{M}*")
_LETTER_AFTER = regex.compile(r"\p{Cf}*\p{L}\p{Cf}*[.．]")
_NOON = regex.compile(r"[ap]\.m")
_INITIALS = regex.compile(r"(?:\p{Lu}\.?-?)+")
_LAST_WORD = regex.compile(r"([\p{L}\p{M}]+)\W*\Z")


def language(code: str | None, text: str) -> str:
    """Language of a text by its script, else by its code, else by its commonest words."""
    if not text.isascii():
        sample = text
        latin = sum(map(len, _LATIN.findall(sample)))
        best, most = "", 0
        for lang, pattern in _SCRIPTS:
            n = len(pattern.findall(sample))
            if n > most and not (lang == "zh" and best == "ja"):
                best, most = lang, n
        if most > latin or most * 3 > latin and best in ("th", "ja", "zh"):
            return best
        if best in ("ru", "el") and most * 3 > latin and code and code.lower()[:2] in ("ru", "el"):
            return code.lower()[:2]
    code = (code or "").lower()
    code = _LANGS.get(code, code[:2])
    if code in _COMMON:
        return code
    words = text.lower().split()
    return max(_COMMON, key=lambda k: (sum(w in _COMMON[k] for w in words), k == "es"))


def _before(text: str, at: int) -> str:
    """The last character before a place that isn't blank."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return text[at - 1 : at]


class _Spans:
    """Whether places, asked for in rising order, lie in one of the spans, which follow each other."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans, self.at = spans, 0

    def hold(self, place: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][1] <= place:
            self.at += 1
        return self.at < len(self.spans) and self.spans[self.at][0] <= place


def _quoted(text: str, caseless: bool) -> list[tuple[int, int]]:
    """Spans in which a mark ends nothing: quotations with a reporting clause after or before them."""
    spans = []
    shouting = text.isupper()
    for m in _QUOTES.finditer(text):
        after = _REPORTS_AFTER.match(text, m.end())
        follows = bool(after) and (not _UNCASED.match(after[2]) or caseless)
        if not follows and shouting and (w := _FIRST_WORD.match(text, m.end())):
            follows = _folded(w[1]) in _REPORTING
        if follows:
            spans.append((m.start(), m.end()))
        elif _before(text, m.start()) in _LEADS_IN:
            spans.append((m.start(), m.end() - 2))
    return spans


def sentence_ends(text: str, code: str | None = None) -> list[int]:
    """End of every sentence, in code points from the start of the text."""
    n = len(text)
    if not n:
        return []
    marks = [m for m in _MARK.finditer(text) if m.end() < n]
    if not marks and (text.isascii() or not _THAI.search(text)) and not _LINE_END.search(text):
        return [n]
    lang = language(code, text)
    ends: set[int] = set()
    caseless = lang in ("th", "ja", "zh", "hi", "ar")
    cjk = lang in ("ja", "zh")
    spans = _quoted(text, caseless) if marks and any(c in text for c in "“«„「『\"") else []
    open_, number, end_ = _lists(lang)
    shouting = text.isupper()
    last, inside = 0, _Spans(spans)
    for m in marks:
        stop = m.end("close")
        mark = _CLINGING.sub("", m["mark"])
        if inside.hold(m.start()):
            continue
        if mark.strip(";;؛") == "" and not (lang == "el"):
            continue
        following = _NEXT.match(text, stop)
        if not following:
            break
        nxt = following["c"]
        weak = set(mark) <= {".", "．"} and len(mark) == 1
        ellipsis = "…" in mark and set(mark) <= {"…", "."} or len(mark) > 1 and set(mark) <= {".", "．"}
        if ellipsis and (cjk or not m["gap"]):
            continue
        wide = any(c in "。！？｡।॥؟" or _OTHER_TERM.match(c) for c in mark)
        if not m["gap"] and not wide:
            # Without a blank only a strong mark before a capital or an opened sentence parts.
            if weak or not (nxt.isupper() or text[stop] in "¿¡“«„「『"):
                continue
        if nxt.islower() or nxt in ",;:，、؛…":
            continue
        word_after = _WORD_AT.match(text, following.start("c")) if shouting else None
        after = _folded(word_after[0]) if word_after else ""
        if shouting and after and (after in _REPORTING or ellipsis and after in _CARRY_ON):
            continue
        if weak and not m["close"]:
            if text[m.start() - 1 : m.start()].isspace():
                continue
            before = _WORD_BEFORE.search(text, max(last, m.start() - 40), m.start())
            if before:
                raw = _HIDDEN.sub("", look_key(before[0]))
                word = _folded(raw)
                # "p. m.", "z. B.", "т. д.": earlier single letters belong to the abbreviation.
                head, lead = word, text[max(last, before.start() - 24) : before.start()]
                while (x := _LETTER_BEFORE.search(lead)) and len(head) < 12:
                    head = _folded(x[1]) + "." + head
                    lead = lead[: x.start(1)]
                single = _SINGLE.fullmatch(raw)
                if single and _LETTER_AFTER.match(text, following.start("c")):
                    continue
                if head in end_ or word in end_ and head == word:
                    if _NOON.fullmatch(head) and m.start() - last <= OPENER and _TIME_OPENER.match(look_key(text[last : m.start()].strip())):
                        continue
                    if shouting and after in _FUNCTION_WORDS:
                        continue
                elif head in open_ or word in open_:
                    continue
                elif (head in number or word in number) and nxt.isdigit():
                    continue
                elif single and (raw.isupper() or caseless or head != word or word in open_):
                    continue
                elif _INITIALS.fullmatch(raw) and len(raw) <= 5 and ("." in raw or "-" in raw):
                    continue
                elif lang == "de" and raw.isdigit():
                    lead_word = _LAST_WORD.search(text, max(last, before.start() - OPENER), before.start())
                    if lead_word and _folded(lead_word[1]) in _ORDINAL_LEADS:
                        continue
        ends.add(stop)
        last = stop
    if lang == "th":
        inside = _Spans(spans)
        for m in _THAI_GAP.finditer(text):
            if not inside.hold(m.start()):
                ends.add(m.start())
    for m in _LINE_END.finditer(text):
        if 0 < m.start() and m.end() < n and (not text[m.end()].islower() or text.count("\n", m.start(), m.end()) > 1):
            ends.add(m.start())
    bare = len(text.rstrip())
    ends = {e for e in ends if e < bare}
    return sorted(ends | {n})


def split_sentences(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Id and ``ends`` (array of code-point ends) of every row with text; one pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(maxsize=4096)(sentence_ends)
        for b in batches:
            ends = [known(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.list_(pa.int32()))], names=[id_col, "ends"])

    rows = df.select(id_col, F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).where("_t IS NOT NULL AND _t != ''")
    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, ends array<int>")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = split_sentences(table(spark, sf_dir, "segments", "row_id", "text", "lang"), "row_id", "text", "lang")
    return ends.select("row_id", F.explode("ends").alias("sent_end"))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
