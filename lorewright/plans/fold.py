"""Speaker resolution in reading order.

Rule attribution, scenes and later neighbours are columns computed by windows beforehand. Only
what depends on earlier answers is folded: rows are partitioned by book, sorted, and
streamed through one Python state per book, so memory holds a book's cast and eight rows,
never its text. Books are independent tasks.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.config import CharacterConfig
from lorewright.operators.context import REPLY_VERBS, rule_speaker
from lorewright.operators.tables import NARRATOR, UNKNOWN
from lorewright.session import apart

SCHEMA = "row_id bigint, book_id bigint, speaker string, confidence double, resolution_method string, review_needed boolean, new_character_candidate string"
#: A remote resolver gets a context dict and returns {"speaker", "confidence", "is_new_character"} or None.
Resolver = Callable[[dict], dict | None]


@functools.lru_cache(maxsize=1 << 14)
def key_of(name: str) -> str:
    text = unicodedata.normalize("NFKD", " ".join(name.split()))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


@functools.lru_cache(maxsize=1 << 13)
def _whole(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")


@dataclass
class Person:
    name: str
    seen: int
    pending: bool = False
    aliases: dict[str, int] = field(default_factory=dict)  # key -> chapter
    last: deque = field(default_factory=lambda: deque(maxlen=64))

    def __post_init__(self) -> None:
        self.key = key_of(self.name)


class Cast:
    """The people of one book met so far."""

    def __init__(self) -> None:
        self.people: list[Person] = []
        self.by_key: dict[str, list[Person]] = {}
        self.memo: dict[tuple[str, int], dict[str, int]] = {}  # mentions in the last rows' texts, until the cast changes
        self.register(NARRATOR, 0)

    def register(self, name: str, chapter: int, pending: bool = False) -> Person:
        found = self.find(name, chapter or None) or next((p for p in self.by_key.get(key_of(name), ()) if p.key == key_of(name)), None)
        if found:
            if chapter and found.seen > chapter:
                found.seen = chapter
                self.memo.clear()
            return found
        self.memo.clear()
        p = Person(" ".join(name.split()), chapter, pending)
        self.people.append(p)
        self.by_key.setdefault(key_of(name), []).append(p)
        return p

    def alias(self, p: Person, name: str, chapter: int) -> None:
        k = key_of(name)
        p.aliases[k] = min(chapter, p.aliases.get(k, chapter))
        self.by_key.setdefault(k, []).append(p)
        self.memo.clear()

    def find(self, name: str, chapter: int | None) -> Person | None:
        k = key_of(name)
        for p in self.by_key.get(k, ()):
            if chapter is None or p.seen <= chapter and (p.key == k or p.aliases.get(k, 1 << 30) <= chapter):
                return p
        return None

    def mentions(self, folded: str, chapter: int) -> dict[str, int]:
        """Visible people whose name, or alias, stands in the folded text as whole words. A text is searched once while it is near."""
        if (known := self.memo.get((folded, chapter))) is not None:
            return known
        if len(self.memo) > 64:
            self.memo.clear()
        out = self.memo[folded, chapter] = {}
        for p in self.people:
            if p.seen > chapter:
                continue
            names = (p.key, *(k for k, c in p.aliases.items() if c <= chapter))
            if any(k in folded for k in names) and (n := len(_whole(names).findall(folded))):
                out[p.name] = n
        return out


class BookFold:
    def __init__(self, config: CharacterConfig, resolver: Resolver | None) -> None:
        self.config, self.resolver = config, resolver
        self.cast, self.near, self.chapter, self.cache = Cast(), deque(maxlen=8), None, {}

    def step(self, r) -> tuple:
        chapter = max(1, int(r.chapter))
        if chapter != self.chapter:
            self.near.clear()
            self.chapter = chapter
        text = r.text if isinstance(r.text, str) else ""
        folded = key_of(text)
        if r.resolution_method == "manual":
            out = (r.speaker, r.confidence, "manual", bool(r.review_needed), r.new_character_candidate)
        elif r.type == "narration":
            out = (NARRATOR, 1.0, "system", bool(r.review_needed), None)
        else:
            out = self.policy(self.resolve(r, chapter, text), chapter)
        speaker = out[0] if isinstance(out[0], str) else UNKNOWN
        who = self.cast.find(speaker, chapter)
        for name in {*self.cast.mentions(folded, chapter), *([who.name] if who and r.type != "narration" else [])}:
            self.cast.find(name, None).last.append((chapter, int(r.seg_order)))
        self.near.append((r.type, speaker, folded, int(r.scene_id), text, bool(r.scene_break_before)))
        return (r.row_id, r.book_id, *out)

    def resolve(self, r, chapter: int, text: str) -> tuple | None:
        """(speaker, confidence, source, is_new) by rule, turn, label or remote answer."""
        if isinstance(r.rule_speaker, str):
            return r.rule_speaker, 0.99, "rule", False
        before = [x for x in list(self.near)[-4:] if x[3] == r.scene_id]
        cut = bool(r.scene_break_before) or any(x[5] for x in list(self.near)[-4:])
        named_ = lambda rows: [x[1] for x in rows if x[0] == "dialogue" and x[1] not in (NARRATOR, UNKNOWN)]
        previous = named_(before if cut else self.near)
        order = int(r.seg_order)
        active = {p.name for p in self.cast.people if not p.pending and p.name != NARRATOR and any(c <= chapter and 0 <= order - o <= self.config.active_window for c, o in p.last)}
        if cut:
            active &= {x[1] for x in before} | {n for x in before for n in self.cast.mentions(x[2], chapter)}
        scores: dict[str, float] = dict.fromkeys(active, 1.0)
        for distance, x in enumerate(reversed(before), 1):
            for name, n in self.cast.mentions(x[2], chapter).items():
                scores[name] = scores.get(name, 0) + n * 4 / distance
            if x[0] == "dialogue" and (p := self.cast.find(x[1], chapter)) and not p.pending:
                scores[p.name] = scores.get(p.name, 0) + 2
        for later in r.after_texts if r.after_texts is not None else ():
            for name, n in self.cast.mentions(key_of(later), chapter).items():
                scores[name] = scores.get(name, 0) + 2 * n
        scores = {n: s for n, s in scores.items() if n not in (NARRATOR, UNKNOWN) and (p := self.cast.find(n, chapter)) and not p.pending}
        candidates = sorted(scores, key=lambda n: (-scores[n], n))[: self.config.candidates]
        turn = previous[-3:]
        quiet = all(x[0] != "narration" or x[4].lstrip().lower().startswith(tuple(REPLY_VERBS.split())) for x in before)
        if r.type == "dialogue" and len(turn) == 3 and turn[0] == turn[2] != turn[1] and set(candidates) == set(turn) and len(text) <= 220 and quiet:
            return turn[1], 0.86, "conversation", False
        if before and before[-1][0] == "narration" and (label := before[-1][4].strip()).endswith(":"):
            p = self.cast.find(label[:-1], chapter)
            if p and not p.pending and p.name in candidates:
                return p.name, 0.97, "candidate", False
        return self.remote(r, chapter, text, before, candidates, previous) if self.resolver else None

    def remote(self, r, chapter: int, text: str, before: list, candidates: list[str], previous: list[str]) -> tuple | None:
        """Asked once per context; failures aren't kept."""
        context = {"chapter": chapter, "type": r.type, "text": text, "before": [x[4] for x in before], "after": list(r.after_texts if r.after_texts is not None else ()), "candidates": candidates, "previous": previous[-3:]}
        key = json.dumps([context, self.config.prompt_version], sort_keys=True, ensure_ascii=False)
        if key not in self.cache:
            try:
                answer = self.resolver(context)
            except Exception:
                return None
            if not isinstance(answer, dict):
                return None
            self.cache[key] = answer
        a = self.cache[key]
        speaker, conf, is_new = a.get("speaker"), a.get("confidence"), a.get("is_new_character", False)
        if not isinstance(speaker, str) or not 0 < len(speaker.strip()) <= 100 or isinstance(conf, bool) or not isinstance(conf, (int, float)) or not 0 <= conf <= 1 or not isinstance(is_new, bool):
            return None
        speaker = speaker.strip()
        if is_new:
            evidence = key_of(" ".join([*context["before"], text, *context["after"]]))
            return (speaker, float(conf), "llm", True) if speaker not in candidates and key_of(speaker) in evidence else None
        p = self.cast.find(speaker, chapter)
        speaker = p.name if p and p.name in candidates else speaker
        return (speaker, float(conf), "llm", False) if speaker in (*candidates, UNKNOWN) else None

    def policy(self, answer: tuple | None, chapter: int) -> tuple:
        """D10 with its effect on the cast."""
        conf = answer[1] if answer else None
        if answer and answer[0] in (NARRATOR, UNKNOWN):
            answer = None
        speaker, candidate = UNKNOWN, None
        if answer and conf >= self.config.review:
            p = self.cast.find(answer[0], chapter)
            if answer[3]:
                candidate = self.cast.register(answer[0], chapter, pending=True).name
            elif p and p.pending and answer[2] != "rule":
                candidate = p.name
            else:
                p = self.cast.register(answer[0], chapter)
                p.pending, speaker = False, p.name
        return speaker, conf, answer[2] if answer else "unknown", speaker == UNKNOWN or conf is None or conf < self.config.accept, candidate


def fold_batches(config: CharacterConfig, resolver: Resolver | None, aliases: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, fold = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if fold is None or r.book_id != book:
                    book, fold = r.book_id, BookFold(config, resolver)
                out.append(fold.step(r))
            yield pd.DataFrame(out, columns=names)

    return run


def resolve_speakers(segments: DataFrame, config: CharacterConfig | None = None, resolver: Resolver | None = None) -> DataFrame:
    """K1: the speaker, confidence and method of every row."""
    w = Window.partitionBy("book_id", "chapter", "scene_id").orderBy("seg_order", "row_id")
    rows = rule_speaker(segments).withColumn("after_texts", F.collect_list(F.coalesce("text", F.lit(""))).over(w.rowsBetween(1, 4)))
    rows = rows.select("row_id", "book_id", "chapter", "seg_order", "type", "text", "speaker", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "resolution_method", "review_needed", "new_character_candidate", "scene_break_before", "scene_id", "rule_speaker", "after_texts")
    return apart(rows, "book_id").sortWithinPartitions("book_id", "chapter", "seg_order", "row_id").mapInPandas(fold_batches(config or CharacterConfig(), resolver), SCHEMA)


def reanalyze(segments: DataFrame, review_too: bool = False, **kw) -> DataFrame:
    """Only open rows are resolved anew; the others stand as if set by hand, and feed the state."""
    open_ = (F.coalesce("speaker", F.lit(UNKNOWN)) == UNKNOWN) | (F.coalesce("review_needed", F.lit(False)) if review_too else F.lit(False))
    again = open_ & (F.col("type") != "narration") & ~F.col("resolution_method").eqNullSafe("manual")
    kept = segments.withColumn("_m", F.col("resolution_method")).withColumn("resolution_method", F.when(again, F.lit(None).cast("string")).otherwise("manual"))
    done = resolve_speakers(kept.drop("_m"), **kw)
    return done.join(segments.select("row_id", F.col("resolution_method").alias("_m")), "row_id").withColumn("resolution_method", F.when(F.col("resolution_method") == "manual", F.col("_m")).otherwise(F.col("resolution_method"))).drop("_m")
