"""Problem 1: variant spellings of one name.

Method: merge-and-rematch resolution. Every spelling of a book is a profile; spellings that
already stand under one character are merged first. Profiles that share a blocking key are
matched; a match merges them, uniting their spellings, initials and partial names, and the
richer profile re-enters blocking. This goes on until no merge occurs. Incomplete
spellings (one name, initials, title and surname) match only when exactly one profile of
the book is compatible, so they are tried again after every round.

Corpus statistics decide what is a typing error: two tokens that are both established (each
stands in many books) are two names, however alike; nicknames are learnt from quoted
nicknames and from spellings that stand under one character.

Rows are reduced to distinct (book, spelling) before anything is grouped, so a book's
group holds its cast's spellings, however many rows it has.

Defined results: null, blank, ``Narrator`` and ``Unknown`` names are ignored; repeated rows
count once; pairs whose strings stand under one char_id of the book are left out.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm.p4_lookalikes import _TWIN, LOOKALIKES, look_key
from lorewright.session import apart, cut, join_hot, table

# Titles before a name, by language; words that mark a family member; particles and articles.
TITLES = """mr mrs ms miss mister madam dr doctor prof professor captain capt sergeant sgt lieutenant lt colonel col major general sir lady lord dame brother sister father mother saint st inspector judge master mistress
sr sra srta señor señora señorita don doña d doctora dra profesor profesora capitán capitana sargento hermano hermana padre madre maestro maestra comisario
m mme mlle monsieur madame mademoiselle docteur doctoresse professeur pr capitaine sergent frère sœur soeur père mère maître commissaire
herr frau fräulein fr hr doktor doktorin professorin kapitän kapitänin hauptmann hauptmännin feldwebel meisterin kommissarin bruder schwester vater meister kommissar
senhor senhora senhorita dom dona doutor doutora capitão sargento irmão irmã padre mestre mestra
г-н г-жа господин госпожа доктор д-р профессор проф капитан кап сержант брат сестра отец мать мастер
κ κα κος κύριος κυρία δρ καθ καθηγητής καθηγήτρια καπ καπετάνιος καπετάνισσα λοχίας αδελφός αδελφή γιατρός κυρ
د الدكتور الدكتورة دكتور دكتورة القبطان قبطان السيد السيدة الأستاذ الأستاذة الرقيب الشيخ الحاج الأخ الأخت
डॉ डॉक्टर श्री श्रीमती प्रो प्रोफ़ेसर प्रोफेसर कप्तान कैप्टन सुश्री पंडित गुरु सरदार सूबेदार भाई बहन
ดร นาย นาง นางสาว คุณ หมอ ครู อาจารย์ กัปตัน จ่า ศาสตราจารย์ พี่"""
CJK_TITLES = "先生 さん 様 さま 君 くん ちゃん 殿 氏 船長 隊長 博士 教授 医師 軍曹 師匠 姉妹 兄弟 船长 大夫 医生 小姐 女士 太太 夫人 老师 师傅 队长 中士 大人 公子 姑娘"
RELATIONS = "jr junior sr senior ii iii iv hijo hija padre madre nieto nieta sobrino sobrina fils fille père mère neveu nièce cadet aîné sohn tochter vater mutter enkel filho filha pai mãe neto neta júnior sobrinho младший младшая старший старшая сын дочь отец νεότερος νεότερη πρεσβύτερος γιος κόρη الابن الابنة الأب الأم الصغير الكبير الأصغر الأكبر पुत्र पुत्री जूनियर सीनियर छोटा बड़ा ลูก พ่อ แม่ น้อย จูเนียร์"
CJK_RELATIONS = "二世 三世 ジュニア の息子 の娘 之子 之女 小 老 父 母 兄 弟 姉 妹 子"
PARTICLES = "the of and la le les el los las de del des du d der die das des dem den vom von zum zur do da dos das o a os as e y et und η ο το του της των l"
NICKNAMES = """isabel:isa,bel guadalupe:lupe concepción:concha,conchi manuel:manolo,manu francisco:paco,pancho,fran josé:pepe dolores:lola rosario:charo mercedes:merche ignacio:nacho antonio:toño,toni teresa:tere santiago:santi,yago gregorio:goyo enrique:quique beatriz:bea catalina:cata
elizabeth:liz,beth,betty,eliza,lizzie henry:harry,hank josephine:josie,jo william:bill,will,billy richard:dick,rick robert:bob,rob,bobby edward:ned,ted,eddie margaret:maggie,peggy,meg katherine:kate,kathy,kitty dorothy:dot,dolly thomas:tom,tommy charles:charlie,chuck abigail:abby eleanor:nell,ellie,nora winifred:winnie,freddie josephine:josie
frédéric:fred geneviève:ginette,viève joséphine:josette,jo édouard:ed,doudou marguerite:margot élisabeth:babette,lise alexandre:alex théodore:théo nicolas:nico
elisabeth:elli,lisbeth,sissi,lisa lieselotte:lilo,lotte heinrich:heinz,heini katharina:kathi,käthe margarete:grete,gretel johannes:hannes,hans friedrich:fritz josef:sepp maximilian:max
francisco:chico josé:zé antônio:tonho,toninho sebastião:tião eduardo:edu,dudu joaquim:quim luísa:lu helena:lena conceição:são
анастасия:настя екатерина:катя александр:саша мария:маша дмитрий:дима алексей:лёша николай:коля евгения:женя зинаида:зина валерий:валера"""

_PRE = {"Cyrillic": "CYRILLIC", "Greek": "GREEK"}
_BACK = {s: {ord(k): next(c for c in v if unicodedata.name(c, "").startswith(p)) for k, v in LOOKALIKES.items() if any(unicodedata.name(c, "").startswith(p) for c in v)} for s, p in _PRE.items()}
_SURE = {s: regex.compile(rf"(?!{'|'.join(chr(c) for c in _TWIN)})\p{{{s}}}") for s in _PRE}
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_HIDDEN = regex.compile(r"[\p{Cf}͏]")
_NICK = regex.compile(r"[\"“”„«»‘’'(（「『]\s*([^\"“”„«»‘’'()（）「」『』]{1,40}?)\s*[\"“”«»‘’')）」』]")


@functools.lru_cache(maxsize=1 << 16)
def fold(name: str) -> str:
    """Case, accents, width, hidden and look-alike characters levelled, in the name's own script."""
    text = unicodedata.normalize("NFC", _HIDDEN.sub("", name))
    script = max(_PRE, key=lambda s: len(_SURE[s].findall(text)))
    if _SURE[script].search(text):
        text = unicodedata.normalize("NFKC", text)
        other = {ord(c): chr(_BACK[script][ord(k)]) if isinstance(_BACK[script].get(ord(k)), int) else _BACK[script].get(ord(k), c) for k, v in LOOKALIKES.items() for c in v if not unicodedata.name(c, "").startswith(_PRE[script])}
        text = text.translate(_BACK[script]).translate(other)
    else:
        text = look_key(text)
    text = unicodedata.normalize("NFD", text.casefold())
    text = unicodedata.normalize("NFC", regex.sub(r"[̀-ͯ]", "", text))
    return regex.sub(r"\s+", " ", text).strip()


@functools.lru_cache(maxsize=1)
def _words() -> tuple[frozenset, frozenset, frozenset, dict]:
    nick = defaultdict(set)
    for entry in NICKNAMES.split():
        given, short = entry.split(":")
        for s in short.split(","):
            nick[fold(s)].add(fold(given))
    return frozenset(map(fold, TITLES.split())), frozenset(map(fold, RELATIONS.split())), frozenset(map(fold, PARTICLES.split())), dict(nick)


@functools.lru_cache(maxsize=1 << 16)
def parse(name: str) -> dict:
    """Parts of one spelling: tokens, abbreviated ones, nickname, number, relation, title."""
    text = unicodedata.normalize("NFC", _HIDDEN.sub("", name))
    text = regex.sub(r"\s+", " ", "".join(" " if unicodedata.category(c) == "Zs" else c for c in text)).strip()
    nick = _NICK.search(text)
    inner = nick[1] if nick and nick.start() > 0 else None
    if inner:
        text = text[: nick.start()] + " " + text[nick.end() :]
    whole = fold(text)
    titles, relations, particles, _ = _words()
    out = {"cjk": bool(_CJK.search(whole)), "nick": fold(inner) if inner else None, "title": False, "relation": None, "number": None}
    number = regex.search(r"\d+", whole)
    if number and not regex.search(r"\p{L}\d|\d\p{L}", whole) or number and out["cjk"]:
        out["number"] = str(int(number[0]))
        whole = (whole[: number.start()] + " " + whole[number.end() :]).strip()
    if out["cjk"]:
        for t in CJK_TITLES.split():
            bare = whole.removesuffix(t).strip()
            if bare == whole:
                bare = whole.removeprefix(t).strip()
                bare = bare if len(bare) > 1 else whole
            if bare and bare != whole:
                whole, out["title"] = bare, True
                break
        for r in CJK_RELATIONS.split():
            if len(r) > 1 and whole.endswith(r) and len(whole) > len(r) + 1:
                whole, out["relation"] = whole.removesuffix(r), r
        parts = [p for p in regex.split(r"[\s・·,、，=＝]+", whole) if p]
        out |= {"tokens": tuple(parts), "short": frozenset(), "phrase": False, "forms": frozenset({"".join(parts), "".join(parts[::-1])})}
        return out
    if regex.fullmatch(r"[^,،]+[,،]\s*[^,،]+", whole):
        last, first = regex.split(r"[,،]\s*", whole, maxsplit=1)
        if fold(first.rstrip(".")) in relations:
            whole = f"{last} {first}"
        else:
            whole = f"{first.strip()} {last.strip()}"
    whole = regex.sub(r"(?<=\p{L})\.(?=\p{L})", ". ", whole)
    raw = [t for t in regex.split(r"[\s,،/]+", whole) if t.strip(".'’-")]
    tokens, short = [], set()
    for t in raw:
        bare = t.strip(".'’")
        for p in ("d'", "d’", "l'", "l’"):
            bare = bare.removeprefix(p)
        bare = _ocr(bare)
        if not bare:
            continue
        if t.endswith(".") or len(bare) == 1:
            short.add(bare)
        tokens.append(bare)
    phrase = any(t in particles for t in tokens)
    while len(tokens) > 1 and (tokens[0] in titles or not phrase and tokens[0] in short and len(tokens[0]) > 1 and any(len(t) > 4 and _abbreviates(tokens[0], t) for t in titles)):
        tokens, out["title"] = tokens[1:], True
    while len(tokens) > 1 and tokens[-1] in relations:
        out["relation"] = (out["relation"] or "") + tokens[-1]
        tokens = tokens[:-1]
    kept = [t for t in tokens if t not in particles or t in short and len(tokens) < 3]
    out["phrase"] = len(kept) != len(tokens) and len(kept) > 0
    out |= {"tokens": tuple(kept or tokens), "short": frozenset(short), "forms": frozenset()}
    return out


def _ocr(token: str) -> str:
    if token.isdigit() or not any(c.isdigit() for c in token):
        return token
    return token.translate(str.maketrans("01358", "olesb"))


def distance(a: str, b: str, most: int) -> int:
    """Edits with neighbouring swaps, up to most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


@functools.lru_cache(maxsize=1 << 15)
def sound(token: str) -> str:
    """Letters that are typed for each other by ear brought together."""
    for a, b in (("rn", "m"), ("ll", "y"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("qu", "k"), ("v", "b"), ("w", "b"), ("y", "i"), ("z", "s"), ("ç", "s"), ("x", "s"), ("c", "k"), ("q", "k"), ("g", "j"), ("h", "")):
        token = token.replace(a, b)
    return regex.sub(r"(.)\1+", r"\1", token)


class Names:
    """Token statistics of one book's names: in how many books each stands, and learnt nicknames."""

    def __init__(self, spread: dict[str, int], nicknames: dict[str, set]):
        self.spread, self.nicknames = spread, nicknames

    def both_established(self, a: str, b: str) -> bool:
        lo, hi = sorted((self.spread.get(a, 1), self.spread.get(b, 1)))
        return hi >= 4 and lo >= 0.3 * hi and lo >= 2

    def typo(self, a: str, b: str) -> bool:
        n = min(len(a), len(b))
        if n < 3 or self.both_established(a, b):
            return False
        if n < 4 and max(self.spread.get(a, 1), self.spread.get(b, 1)) < 4:
            return False
        # A name and the same with another ending are a pair of names unless one of them is clearly established.
        lo, hi = sorted((self.spread.get(a, 1), self.spread.get(b, 1)))
        if (a[:-1] == b[:-1] or a == b[:-1] or b == a[:-1]) and hi < 8 * lo and a[-1] != b[-1] and {a[-1], b[-1]} & set("aeoаяεαη"):
            return False
        d = distance(a, b, 2)
        if d <= 1 or d == 2 and n >= 6 and lo <= max(1, hi // 10):
            return True
        return n >= 5 and (d == 2 and (n >= 9 or distance(sound(a), sound(b), 1) <= 1) or sound(a) == sound(b))

    def misspelt(self, a: str, b: str) -> bool:
        """A typing error between one-word names, which no second word bears out: one of them is established, or they are long and begin alike."""
        n = min(len(a), len(b))
        if a == b or n < 3 or not self.typo(a, b):
            return False
        lo, hi = sorted((self.spread.get(a, 1), self.spread.get(b, 1)))
        near = distance(a, b, 1) <= 1
        if n < 5:
            return near and a[0] == b[0] and hi >= 8 * lo
        return hi >= 3 * lo or n > 6 and near and a[0] == b[0]

    def contracts(self, short: str, full: str) -> bool:
        """fcois -> francois, cie -> compagnie: outer letters kept, of a word that stands in several books."""
        return len(short) >= 3 and len(full) - len(short) >= 2 and short[-1] == full[-1] and self.spread.get(full, 1) >= 4 and _abbreviates(short, full)

    def slip(self, a: str, b: str) -> bool:
        """A typing error in a name written without gaps: one edit, or two that bring in no new character."""
        a, b = sorted((a, b), key=lambda x: (self.spread.get(x, 1), x))
        if len(a) < 3 or len(b) < 4 or self.both_established(a, b):
            return False
        d = distance(a, b, 2)
        return d <= 1 or d == 2 and set(a) <= set(b) and len(b) >= 4 and self.spread.get(b, 1) >= 3 * self.spread.get(a, 1)

    def nickname(self, a: str, b: str) -> bool:
        return b in self.nicknames.get(a, ()) or a in self.nicknames.get(b, ())


def _abbreviates(short: str, full: str) -> bool:
    """cons -> conseil, gde -> guilde, cjo -> consejo."""
    if len(short) >= len(full) or len(short) < 2 or short[0] != full[0]:
        return False
    at = iter(full)
    return all(c in at for c in short)


def unite(members: list[dict]) -> list[dict]:
    """The profiles of one cluster: its complete spellings of equal make-up, united word by word where they share one.

    slots: alternatives of each word; short: abbreviations; nicks: incomplete names that stand beside the complete ones;
    orders: the spellings' words in any order.
    """
    nicks = {p["tokens"][0] for p in members if is_word(p)} | {p["nick"] for p in members if p["nick"]}
    out: list[dict] = []
    for p in members:
        if is_partial(p):
            continue
        words = p["tokens"]
        for q in out:
            if any(p[k] != q[k] for k in ("cjk", "number", "relation", "phrase")):
                continue
            if p["cjk"]:
                q["spellings"] += not p["forms"] <= q["forms"]
                q["forms"] |= p["forms"]
                break
            if len(words) != len(q["slots"]):
                continue
            ways = (words, words[::-1]) if len(words) == 2 else (words,)
            best = max(ways, key=lambda way: sum(w in slot for w, slot in zip(way, q["slots"])))
            if any(len(w) > 1 and w in slot for w, slot in zip(best, q["slots"])):
                for w, slot in zip(best, q["slots"]):
                    slot.add(w)
                q["turned"] |= best != words
                q["short"] |= p["short"]
                q["orders"].add(tuple(sorted(words)))
                break
        else:
            out.append({k: p[k] for k in ("cjk", "number", "relation", "phrase")} | {"forms": set(p["forms"]), "short": set(p["short"]), "slots": [{w} for w in words], "orders": {tuple(sorted(words))}, "turned": False, "spellings": 1})
    for q in out:
        # An initial whose name is known fits no other name.
        q["slots"] = [{w for w in slot if len(w) > 1 or not any(len(x) > 1 and x.startswith(w) for x in slot)} for slot in q["slots"]]
        q["nicks"] = nicks - set().union(*q["slots"])
    # Where surname and given name stand in both orders, either may be meant.
    return out + [q | {"slots": q["slots"][::-1]} for q in out if q["turned"]]


def full_match(p: dict, q: dict, names: Names, initials: bool = False) -> bool:
    """Whether two profiles of complete spellings are one name; initials: a letter may stand for a name, which more than one may fit."""
    if p["number"] != q["number"] or p["relation"] != q["relation"] or p["cjk"] != q["cjk"]:
        return False
    if p["cjk"]:
        if p["forms"] & q["forms"]:
            return True
        return any(names.slip(a, b) and (distance(a, b, 1) <= 1 or _share_key(a, b)) for a in p["forms"] for b in q["forms"])
    a, b = p["slots"], q["slots"]
    if len(a) == 1 and len(b) == 1:
        return bool(a[0] & b[0]) or any((p["number"] is not None or len(s) > 6) and names.typo(s, t) for s in a[0] for t in b[0])
    if len(a) < 2 or len(b) < 2:
        return False
    if p["orders"] & q["orders"]:
        return True
    if len(a) > len(b):
        p, q, a, b = q, p, b, a
    if len(a) == len(b):
        for x in (b, b[::-1]) if len(b) == 2 else (b,):
            equal = fuzzy = slips = 0
            for k, (u, v) in enumerate(zip(a, x)):
                both = [(s, t) for s in u for t in v]
                if any(s == t and len(s) > 1 for s, t in both):
                    equal += 1
                elif any(s == t for s, t in both):
                    continue
                elif any(len(s) > 1 and len(t) > 1 and names.typo(s, t) for s, t in both):
                    slips += 1
                elif any(s in p["short"] and _abbreviates(s, t) or t in q["short"] and _abbreviates(t, s) for s, t in both):
                    fuzzy += 1
                elif any(names.contracts(s, t) or names.contracts(t, s) for s, t in both):
                    fuzzy += 1
                elif any(names.nickname(s, t) for s, t in both) or k == 0 and not p["phrase"] and not q["phrase"] and (u & q["nicks"] or v & p["nicks"]):
                    fuzzy += 1
                elif initials and any(len(s) == 1 and t.startswith(s) or len(t) == 1 and s.startswith(t) for s, t in both):
                    continue
                else:
                    break
            else:
                if equal and fuzzy + slips <= 1 or equal and not fuzzy and slips == 2:
                    return True
                # Both parts mistyped: each by one edit in a long token.
                if slips == 2 and len(a) == 2 and all(any(min(len(s), len(t)) >= 5 and s[0] == t[0] and (distance(s, t, 1) <= 1 or sound(s) == sound(t)) for s in u for t in v) for u, v in zip(a, x)):
                    return True
        return False
    if len(b) - len(a) == 1:
        # A further surname, or a middle name or initial.
        for k in range(1, len(b)):
            rest = b[:k] + b[k + 1 :]
            if all(u & v for u, v in zip(rest, a)) and not b[k] <= _words()[1]:
                return p["phrase"] == q["phrase"]
    return False


def _share_key(a: str, b: str) -> bool:
    """Whether two forms are equal but for one character left out of each."""
    return not _near_keys(a, 1).isdisjoint(_near_keys(b, 1))


def doubtful_match(p: dict, q: dict, names: Names) -> bool:
    """Whether p may be q, as others may be: by initials, or by two edits apart of a spelling that nothing nearer explains."""
    if p["cjk"] != q["cjk"] or p["number"] != q["number"]:
        return False
    if not p["cjk"]:
        return any(len(w) == 1 for slot in p["slots"] for w in slot) and full_match(p, q, names, True)
    return p["relation"] == q["relation"] and p["spellings"] == 1 and any(names.spread.get(a, 1) < names.spread.get(b, 1) and names.slip(a, b) for a in p["forms"] for b in q["forms"])


def partial_match(p: dict, q: dict, names: Names, loose: bool) -> bool:
    """Whether an incomplete spelling p can stand for the profile q; loose: by a nickname too."""
    if p["number"] is not None or q["number"] is not None or p["cjk"] != q["cjk"]:
        return False
    if p["relation"] != q["relation"]:
        return False
    if p["cjk"]:
        return any(len(a) >= 2 - p["title"] and (a == b or len(a) < len(b)) and (b.startswith(a) or b.endswith(a) or loose and names.slip(a, b)) for a in p["forms"] for b in q["forms"])
    a, b = p["tokens"], q["slots"]
    if q["phrase"] or len(b) < 2:
        return False
    if len(a) == 1:
        return len(a[0]) > 1 and (any(a[0] in v for v in b) or loose and any(names.nickname(a[0], t) for t in b[0]))
    if len(a) == 2:
        for x in (a, a[::-1]):
            s, t = x
            if (len(s) == 1 or s in p["short"]) and any(w.startswith(s) for w in b[0]) and len(t) > 1 and (t in b[1] or t in b[-1] or any(names.typo(t, w) for w in b[1])):
                return True
            if (len(t) == 1 or t in p["short"]) and any(w.startswith(t) for w in b[1]) and len(s) > 1 and (s in b[0] or any(names.nickname(s, w) for w in b[0])):
                return True
    return False


def is_word(p: dict) -> bool:
    """A name of one word, without number, in a script with gaps or marks between words."""
    return not p["cjk"] and p["number"] is None and len(p["tokens"]) == 1 and len(p["tokens"][0]) > 1


def misspelt_part(p: dict, q: dict, names: Names) -> bool:
    """Whether the one-word spelling p can be a misspelt part of the complete one q."""
    if p["cjk"] != q["cjk"] or q["number"] is not None or p["relation"] != q["relation"] or q["phrase"] or len(q["tokens"]) < 2:
        return False
    return any(names.misspelt(p["tokens"][0], t) for t in q["tokens"])


def is_partial(p: dict) -> bool:
    if p["number"] is not None:
        return False
    if p["cjk"]:
        return len(p["tokens"]) == 1 and len(p["tokens"][0]) <= 3
    return len(p["tokens"]) == 1 or len(p["tokens"]) == 2 and any(len(t) == 1 for t in p["tokens"])


def _keys(p: dict) -> Iterator[tuple]:
    """Blocking keys of a profile: two true variants share at least one."""
    extra = (p["number"],)
    if p["cjk"]:
        for f in p["forms"]:
            for k in _near_keys(f):
                yield ("-", k, *extra)
        return
    for slot in p["slots"]:
        for t in slot:
            if len(t) > 1:
                yield ("t", t, *extra)
    if len(p["slots"]) == 2:
        for s in p["slots"][0]:
            for t in p["slots"][1]:
                yield ("i", *sorted((s[0], t[0])), *extra)
    if len(p["slots"]) == 1:
        for t in p["slots"][0]:
            yield ("s", sound(t), *extra)
            for k in _near_keys(t):
                yield ("-", k, *extra)


@functools.lru_cache(maxsize=1 << 14)
def _near_keys(token: str, most: int = 2) -> frozenset[str]:
    """The token with up to so many characters left out: spellings within that many edits or swaps share one."""
    out = {token}
    for _ in range(most):
        out |= {t[:k] + t[k + 1 :] for t in out for k in range(len(t))}
    return frozenset(out)


def _slip_keys(token: str) -> set[tuple]:
    """Keys of which a word and its misspelling share one."""
    return {*(("-", k) for k in _near_keys(token)), ("s", sound(token))}


def _part_keys(p: dict, names: Names) -> Iterator[tuple]:
    """Blocking keys of an incomplete spelling: the profiles that ``partial_match`` takes share one of ``_whole_keys``."""
    if p["cjk"]:
        for f in p["forms"]:
            yield ("e", f)
            for k in _near_keys(f):
                yield ("-", k)
        return
    for t in p["tokens"]:
        if len(t) > 1:
            yield ("t", t)
            yield ("n", t)
            for given in names.nicknames.get(t, ()):
                yield ("g", given)
            if len(p["tokens"]) > 1:
                for k in _slip_keys(t):
                    yield k


def _whole_keys(q: dict, names: Names, pairs: bool = True) -> Iterator[tuple]:
    """pairs: with those that only incomplete spellings of two words ask for."""
    if q["cjk"]:
        for f in q["forms"]:
            for k in range(1, len(f)):
                yield ("e", f[:k])
                yield ("e", f[k:])
            yield ("e", f)
            for k in _near_keys(f):
                yield ("-", k)
        return
    for slot in q["slots"]:
        for t in slot:
            yield ("t", t)
    for t in q["slots"][0]:
        yield ("g", t)
        for short in names.nicknames.get(t, ()):
            yield ("n", short)
    for slot in q["slots"][1:2] if pairs else ():
        for t in slot:
            for k in _slip_keys(t):
                yield k


class Blocks:
    """Entries by key: candidates are looked up, never paired one with all."""

    def __init__(self) -> None:
        self.held: dict[tuple, list[int]] = defaultdict(list)

    def add(self, entry: int, keys: Iterator[tuple]) -> None:
        for k in set(keys):
            self.held[k].append(entry)

    def near(self, keys: Iterator[tuple]) -> list[int]:
        return sorted({x for k in set(keys) for x in self.held.get(k, ())})


def resolve(names_in: list[str], chars: list[list[str]], names: Names) -> list[int]:
    """Cluster number of every spelling of one book."""
    parent = list(range(len(names_in)))
    parsed = [parse(n) for n in names_in]
    complete = [not is_partial(p) for p in parsed]  # whether the cluster of a root holds a complete spelling

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def merge(x: int, y: int) -> bool:
        x, y = sorted((find(x), find(y)))
        parent[y], complete[x] = x, complete[x] or complete[y]
        return x != y

    seen: dict = {}
    for i, own in enumerate(chars):
        for c in own:
            merge(i, seen.setdefault(("c", c), i))
        merge(i, seen.setdefault(("f", fold(names_in[i])), i))
    for i, p in enumerate(parsed):
        if p["nick"] and len(p["tokens"]) > 1:
            names.nicknames.setdefault(p["nick"], set()).add(p["tokens"][0])
    whole = [i for i, p in enumerate(parsed) if not is_partial(p)]
    part = [i for i, p in enumerate(parsed) if is_partial(p)]
    # One-word names: any of them may be another one's or a longer name's misspelling.
    words = [i for i in part if is_word(parsed[i])]
    near: dict[tuple, list[int]] = defaultdict(list)
    for i in words:
        token = parsed[i]["tokens"][0]
        for k in {*_near_keys(token), ("s", sound(token))}:
            near[k, parsed[i]["relation"]].append(i)
    pairs = {(x, y) for block in near.values() for x, y in combinations(block, 2)}
    pairs = sorted((x, y) for x, y in pairs if names.misspelt(parsed[x]["tokens"][0], parsed[y]["tokens"][0]))
    long = Blocks()
    for j in whole if words else ():
        if not parsed[j]["cjk"] and len(parsed[j]["tokens"]) > 1:
            long.add(j, (k for t in parsed[j]["tokens"] for k in _slip_keys(t)))
    slipped = {i: [j for j in long.near(_slip_keys(parsed[i]["tokens"][0])) if misspelt_part(parsed[i], parsed[j], names)] for i in words}
    same: dict[tuple, list[int]] = defaultdict(list)
    for i in part:
        same[parsed[i]["tokens"]].append(i)
    united: dict[tuple, list[dict]] = {}
    tried: set[tuple[int, int]] = set()
    keyed: dict[int, frozenset] = {}  # of profiles that ``united`` keeps
    pairs_of_words = any(not parsed[i]["cjk"] and len(parsed[i]["tokens"]) > 1 for i in part)
    changed = True
    while changed:
        changed = False
        # Complete spellings: every cluster's profiles, enriched by the last round's merges, are blocked and matched anew.
        members: dict[int, list[int]] = defaultdict(list)
        for i in range(len(parsed)):
            members[find(i)].append(i)
        profiles: list[tuple[int, dict]] = []
        for root, own in members.items():
            if tuple(own) not in united:
                united[tuple(own)] = unite([parsed[i] for i in own])
            profiles += [(root, q) for q in united[tuple(own)]]
        blocks: dict[tuple, list[int]] = defaultdict(list)
        for n, (_, q) in enumerate(profiles):
            for k in set(_keys(q)):
                blocks[k].append(n)
        pairs_now = sorted({xy for block in blocks.values() for xy in combinations(block, 2)})
        for x, y in pairs_now:
            (i, p), (j, q) = profiles[x], profiles[y]
            if find(i) != find(j) and (id(p), id(q)) not in tried:
                tried.add((id(p), id(q)))
                changed |= full_match(p, q, names) and merge(i, j)
        if changed:
            continue
        # What others may fit as well: only where a single profile is compatible.
        doubtful = defaultdict(set)
        for x, y in pairs_now:
            for (i, p), (j, q) in ((profiles[x], profiles[y]), (profiles[y], profiles[x])):
                if i != j and doubtful_match(p, q, names):
                    doubtful[i].add(j)
        for i, fits in sorted(doubtful.items()):
            if len(fits) == 1:
                changed |= merge(i, *fits)
        if changed:
            continue
        # Incomplete ones: only where a single profile is compatible.
        free = set()
        around = Blocks()
        for n, (_, q) in enumerate(profiles):
            if id(q) not in keyed:
                keyed[id(q)] = frozenset(_whole_keys(q, names, pairs_of_words))
            around.add(n, keyed[id(q)])
        for i in part:
            near_by = [profiles[n] for n in around.near(_part_keys(parsed[i], names))]
            fits = {find(j) for j, q in near_by if partial_match(parsed[i], q, names, False)} or {find(j) for j, q in near_by if partial_match(parsed[i], q, names, True)}
            alike = {find(j) for j in same[parsed[i]["tokens"]] if j != i}
            own = {find(i)} if complete[find(i)] else set()
            if len(fits) == 1 and not (own - fits):
                changed |= merge(i, next(iter(fits)))
            elif not fits and not own and len(alike) == 1:
                changed |= merge(i, alike.pop())
            if not fits and i in slipped:
                fits = {find(j) for j in slipped[i]}
                if len(fits) == 1 and not (own - fits):
                    changed |= merge(i, fits.pop())
                elif not fits:
                    free.add(i)
        # One-word names that are no part of a complete one stand for themselves and are matched like complete ones.
        for x, y in pairs:
            if x in free and y in free and find(x) != find(y):
                changed |= merge(x, y)
    return [find(i) for i in range(len(names_in))]


def spellings(characters: DataFrame, aliases: DataFrame, segments: DataFrame) -> DataFrame:
    """book_id, name, chars (char_ids that hold it) of every distinct spelling."""
    parts = [
        characters.select("book_id", F.col("canonical_name").alias("name"), "char_id"),
        aliases.select("book_id", "name", "char_id"),
        segments.select("book_id", F.col("speaker").alias("name"), F.lit(None).cast("string").alias("char_id")).distinct(),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("book_id IS NOT NULL AND name IS NOT NULL AND name NOT IN ('Narrator', 'Unknown') AND trim(name) != ''")
    return rows.groupBy("book_id", "name").agg(F.collect_set("char_id").alias("chars"))


def _token_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse(n) for n in pdf["name"]]
        tokens = [sorted({*p["tokens"], *p["forms"]}) for p in parsed]
        nick = [[f"{p['nick']}\t{p['tokens'][0]}"] if p["nick"] and len(p["tokens"]) > 1 else [] for p in parsed]
        yield pdf.assign(tokens=tokens, nick=nick)


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nickname pairs of one book: spellings under one character with equal surname and unlike given name."""
    out, by_char = set(), defaultdict(set)
    for name, chars in zip(pdf["name"], pdf["chars"]):
        p = parse(name)
        if not p["cjk"] and len(p["tokens"]) == 2 and not p["short"] and p["relation"] is None and not p["phrase"]:
            for c in chars:
                by_char[c].add(p["tokens"])
        if p["nick"] and len(p["tokens"]) > 1:
            out.add((p["nick"], p["tokens"][0]))
    for own in by_char.values():
        for a, b in combinations(sorted(own), 2):
            if a[1] == b[1] and a[0] != b[0] and distance(a[0], b[0], 2) > 1 and a[0] != b[1]:
                out |= {(a[0], b[0]), (b[0], a[0])}
    return pd.DataFrame(sorted(out), columns=["token", "given"]).assign(book_id=pdf["book_id"].iloc[0])[["book_id", "token", "given"]]


def _resolve_book(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("name", ignore_index=True)
    spread: dict[str, int] = {}
    nicknames: dict[str, set] = defaultdict(set)
    for short, given in _words()[3].items():
        nicknames[short] |= given
    for stats in pdf["stats"]:
        for s in stats:
            spread[s["token"]] = int(s["books"])
            if s["givens"] is not None:
                nicknames[s["token"]] |= set(s["givens"])
    cluster = resolve(pdf["name"].tolist(), [list(c) for c in pdf["chars"]], Names(spread, nicknames))
    return pd.DataFrame({"book_id": pdf["book_id"], "name": pdf["name"], "chars": pdf["chars"], "entity": cluster})


def resolve_names(characters: DataFrame, aliases: DataFrame, segments: DataFrame) -> DataFrame:
    """book_id, name, chars, entity (number within the book) of every distinct spelling; checkpointed."""
    kind = characters.schema["book_id"].dataType.simpleString()
    base = spellings(characters, aliases, segments)
    rows = cut(base.mapInPandas(_token_lists, f"book_id {kind}, name string, chars array<string>, tokens array<string>, nick array<string>"))
    spread = rows.select("book_id", F.explode("tokens").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("books"))
    learnt = apart(rows, "book_id").groupBy("book_id").applyInPandas(_learn, f"book_id {kind}, token string, given string")
    learnt = learnt.groupBy("token", "given").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("token").agg(F.collect_set("given").alias("givens"))
    # The token statistics go to each name by way of a join that holds hot tokens apart, never as one table to all tasks.
    known = cut(spread.join(learnt, "token", "left").withColumn("_w", F.col("books")))
    stats = join_hot(rows.select("book_id", "name", F.explode("tokens").alias("token")), known, ["token"], "_w")
    stats = stats.groupBy("book_id", "name").agg(F.collect_list(F.struct("token", "books", "givens")).alias("stats"))
    ready = rows.select("book_id", "name", "chars").join(stats, ["book_id", "name"], "left").withColumn("stats", F.coalesce("stats", F.array().cast("array<struct<token:string,books:bigint,givens:array<string>>>")))
    return cut(apart(ready, "book_id").groupBy("book_id").applyInPandas(_resolve_book, f"book_id {kind}, name string, chars array<string>, entity int"))


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """Pairs of spellings of one entity that no char_id holds together."""
    a = resolved.select("book_id", "entity", F.col("name").alias("name_a"), F.col("chars").alias("ca"))
    b = resolved.select("book_id", "entity", F.col("name").alias("name_b"), F.col("chars").alias("cb"))
    pairs = a.join(b, ["book_id", "entity"]).where("name_a < name_b AND NOT arrays_overlap(ca, cb)")
    return pairs.select("book_id", "name_a", "name_b")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_names(table(spark, sf_dir, "characters", "book_id", "char_id", "canonical_name"), table(spark, sf_dir, "aliases", "book_id", "char_id", "name"), table(spark, sf_dir, "segments", "book_id", "speaker"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(_resolved(spark, sf_dir))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its entity and the entity's number of spellings."""
    rows = _resolved(spark, sf_dir)
    sizes = rows.groupBy("book_id", "entity").agg(F.count(F.lit(1)).alias("n_spellings"))
    return rows.join(sizes, ["book_id", "entity"]).select("book_id", "name", "entity", "n_spellings")


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities}
SQL: dict[str, str] = {}
