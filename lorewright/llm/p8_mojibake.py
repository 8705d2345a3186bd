"""Problem 8: text garbled by a wrong character encoding.

Method: every record has a latent encoding chain (right bytes decoded by the wrong table,
once or twice, or nothing happened). A character-bigram model counted over the whole corpus
scores each stretch of a record as it stands and as every chain would restore it;
the difference is the record's evidence for the chain. Weak evidence is pooled:
expectation-maximisation learns, per source and field, how often each chain occurs there, and
each record is then judged, and repaired, by its posterior.

Every distinct token is scored under every chain that could have made it; a batch's tokens are scored
together, a chain at a time, by look-up tables. Pair counts are kept in 2**23 hashed cells, so what reaches the driver and the tasks has
a bound that the corpus can't exceed.

Evidence is binned before the M-step. A source with more than ``GROUP`` combinations of bins is split by hash; each part is
pooled by itself and their expected records are added up, so no task holds an unbounded source.

Defined results: null, empty and ASCII texts are never found; a replacement character is
evidence of a loss that can't be repaired, the text then stays as it is; where only a stretch
is garbled, only that stretch is repaired; repeated documents are each reported.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.session import cut, join_hot, small, spread, table

LOST = "lost"
NONE = "none"
#: Evidence in nats beyond which a posterior no longer changes, and the width of its bins.
MOST, BIN = 25.0, 1.0
PRIOR_WEIGHT = 20.0  # records by which the pooled prior of all sources counts in one source
BASE_RATE = 1e-3
ROUNDS = 12
GROUP = 50_000
#: Nats that a character costs which the corpus hardly knows; least nats of a token for a possible chain, and those for an impossible one.
STRANGE, LEAST, IMPOSSIBLE = 4.0, -8.0, -6.0

_SINGLE = ["latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "iso8859_15", "cp866", "cp1254", "cp852", "cp1253", "mac_cyrillic"]
_WIDE = ["gb18030", "shift_jis", "big5", "euc_jp", "euc_kr"]
_FAR = ["cp1251", "koi8_r", "iso8859_5", "cp866", "cp1253", "iso8859_7", "cp1256", "iso8859_6", "cp874", "gb18030", "big5", "euc_jp", "shift_jis", "euc_kr", "cp1255"]
_NEAR = ["cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866", "cp1253", "cp852"]
_CYRILLIC = ["cp1251", "koi8_r", "iso8859_5", "cp866", "mac_cyrillic"]


@functools.lru_cache(maxsize=None)
def _bytes_of(wrong: str) -> dict[str, bytes]:
    """Character -> byte of a one-byte table; bytes it doesn't define stand for the control characters of that number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, bytes([b]))
    return out


@functools.lru_cache(maxsize=None)
def _high(wrong: str) -> str:
    return "".join(re.escape(c) for c, b in _bytes_of(wrong).items() if b[0] >= 0x80)


@functools.lru_cache(maxsize=None)
def _utf8_pattern(wrong: str) -> re.Pattern:
    table_ = {b[0]: c for c, b in _bytes_of(wrong).items()}
    some = lambda lo, hi: "[" + "".join(re.escape(table_[b]) for b in range(lo, hi + 1) if b in table_) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{tail}|{some(0xF0, 0xF4)}{tail}{tail}{tail})+")


def _encode(text: str, wrong: str) -> bytes:
    own = _bytes_of(wrong)
    return b"".join(own[c] for c in text)


def _from_utf8(text: str, wrong: str) -> str | None:
    pattern = _utf8_pattern(wrong)
    if not pattern.search(text):
        return None

    def mend(m: re.Match) -> str:
        try:
            return _encode(m[0], wrong).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    out = pattern.sub(mend, text)
    return out if out != text else None


@functools.lru_cache(maxsize=None)
def _run_pattern(wrong: str) -> re.Pattern:
    return re.compile(f"([\x21-\x7e]*[{_high(wrong)}](?:[\x21-\x7e]|[{_high(wrong)}])*)")


def _from_table(text: str, right: str, wrong: str) -> str | None:
    """Runs of the wrong table's characters read by the right one; None if that fails or changes nothing."""

    def mend(m: re.Match) -> str:
        return _encode(m[0], wrong).decode(right)

    try:
        out = _run_pattern(wrong).sub(mend, text)
    except (UnicodeDecodeError, LookupError):
        return None
    return out if out != text else None


def _from_wide(text: str, wrong: str) -> str | None:
    if not any(ord(c) > 0x2E7F for c in text):
        return None
    try:
        out = text.encode(wrong).decode("utf-8")
    except UnicodeError:
        return None
    return out if out != text else None


@functools.lru_cache(maxsize=1)
def chains() -> dict[str, tuple]:
    """Name -> steps that undo it, each (kind, right, wrong)."""
    out: dict[str, tuple] = {}
    for w in _SINGLE:
        out[f"utf-8>{w}"] = (("utf8", "", w),)
    for w in _WIDE:
        out[f"utf-8>{w}"] = (("wide", "", w),)
    for w in ("latin-1", "cp1252", "cp437", "cp850", "mac_roman"):
        for v in ("latin-1", "cp1252"):
            out[f"utf-8>{v}>utf-8>{w}"] = (("utf8", "", w), ("utf8", "", v))
    for w in ("latin-1", "cp1252", "mac_roman", "cp437", "cp850"):
        for r in _FAR:
            out[f"{r}>{w}"] = (("table", r, w),)
    for w in ("cp1251", "cp1250"):
        for r in ("cp1253", "cp1256", "cp1255", "cp874", "koi8_r"):
            out.setdefault(f"{r}>{w}", (("table", r, w),))
    for w in _NEAR:
        for r in ("cp1252", "mac_roman", "cp850", "cp437"):
            if r != w:
                out.setdefault(f"{r}>{w}", (("table", r, w),))
    for r in ("mac_roman", "cp850", "cp437", "cp1250"):
        for w in ("latin-1", "cp1252"):
            out[f"{r}>{w}"] = (("table", r, w),)
    for r in _CYRILLIC:
        for w in _CYRILLIC:
            if r != w:
                out[f"{r}>{w}"] = (("table", r, w),)
    return out


def undo(text: str, chain: str) -> str | None:
    """The text without the chain's damage; None where it can't have come from it."""
    for kind, right, wrong in chains()[chain]:
        text = _from_utf8(text, wrong) if kind == "utf8" else _from_wide(text, wrong) if kind == "wide" else _from_table(text, right, wrong)
        if text is None:
            return None
    return text


CELLS = 23
_ALONE = 1 << 42


def _cells(pairs: np.ndarray) -> np.ndarray:
    """Cell of each pair (first << 21 | second)."""
    with np.errstate(over="ignore"):
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


class Model:
    """Log-probabilities of character bigrams, backing off to single characters.

    keys: the cell of a pair, or _ALONE | character for one alone.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        alone = keys >= _ALONE
        self.pairs = np.zeros(1 << CELLS, np.float32)
        self.pairs[keys[~alone]] = counts[~alone]
        single = np.zeros(0x110000, np.float32)
        single[keys[alone] - _ALONE] = counts[alone]
        total = float(counts[alone].sum()) + 1.0
        self.back = (4.0 * (single + 0.05) / (total + 1e4)).astype(np.float32)
        self.single = single + np.float32(4.0)
        self.strange = single < 3
        self.strange[:128] = False

    def logs(self, codes: np.ndarray) -> np.ndarray:
        first, second = codes[:-1], codes[1:]
        return np.log((self.pairs[_cells(first << 21 | second)] + self.back[second]) / self.single[first])

    def scores(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Score of each token of a line of tokens; at: the place of the blank before each."""
        return np.add.reduceat(self.logs(codes), at)

    def gains(self, codes: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How much likelier the tokens are than what they were made from."""
        strange = np.add.reduceat(self.strange[codes[:-1]].astype(np.float32), at)
        return np.maximum(LEAST, self.scores(codes, at) - before - STRANGE * strange)


def _line(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens between blanks as codes, and the place of the blank before each."""
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])])
    codes = _codes("\x01" + "\x01".join(tokens) + "\x01")
    codes[at] = 32
    return codes, at[:-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ascii_pairs, parts = np.zeros(1 << 14, np.int64), []
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        if not texts:
            continue
        c = _codes(" " + " ".join(texts) + " ")
        c[(c == 10) | (c == 13) | (c == 9)] = 32
        first, second = c[:-1], c[1:]
        plain = (first < 128) & (second < 128)
        ascii_pairs += np.bincount(first[plain] << 7 | second[plain], minlength=1 << 14)
        parts.append(np.unique((first << 21 | second)[~plain], return_counts=True))
        if len(parts) > 16:
            parts = [_merge(parts)]
    at = np.flatnonzero(ascii_pairs)
    keys, counts = _merge([*parts, ((at >> 7) << 21 | at & 127, ascii_pairs[at])])
    keys, counts = _merge([(_cells(keys), counts), (keys >> 21 | _ALONE, counts)])
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def train(df: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts for ``Model`` over every text: one row per cell or character in use, so no more than 2**23 + 0x110000."""
    counts = spread(df.select(text_col)).mapInArrow(_count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    return counts["key"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64)


_TOKEN = re.compile(r"[^ \n\r\t]+")
_ONE_BYTE = frozenset(["cp1251", "koi8_r", "iso8859_5", "cp866", "cp1253", "iso8859_7", "cp1256", "iso8859_6", "cp874", "cp1255", "mac_cyrillic", "mac_roman", "cp850", "cp437", "cp1250", "cp1252", "cp852"])


@functools.lru_cache(maxsize=1)
def _by_wrong() -> tuple[list, list]:
    """Single-step table chains by the wrong table, those read by one-byte tables apart, and all other chains."""
    groups: dict[str, tuple[list, list]] = {}
    rest = []
    for name, steps in chains().items():
        if len(steps) == 1 and steps[0][0] == "table":
            groups.setdefault(steps[0][2], ([], []))[steps[0][1] not in _ONE_BYTE].append((name, steps[0][1]))
        else:
            rest.append((name, steps[0][0]))
    return [(w, *x) for w, x in groups.items()], rest


@functools.lru_cache(maxsize=None)
def _high_set(wrong: str) -> frozenset:
    return frozenset(c for c, b in _bytes_of(wrong).items() if b[0] >= 0x80)


@functools.lru_cache(maxsize=None)
def _high_table(wrong: str) -> np.ndarray:
    out = np.zeros(0x10001, bool)
    out[[ord(c) for c in _high_set(wrong)]] = True
    return out


@functools.lru_cache(maxsize=None)
def _reading(right: str, wrong: str) -> np.ndarray:
    """Per code point what a one-byte table reads instead: itself outside the wrong table, -1 where the right one has nothing."""
    out = np.arange(0x10001, dtype=np.int64)
    for c, b in _bytes_of(wrong).items():
        if b[0] >= 0x80:
            try:
                out[ord(c)] = ord(b.decode(right))
            except UnicodeDecodeError:
                out[ord(c)] = -1
    return out


_PAIR = re.compile(r"[^\x00-\x7f]{2}")


def _slow_candidates(token: str) -> Iterator[tuple[str, str]]:
    """(chain, mended token) of the chains with sequences of bytes that could have made the token."""
    groups, rest = _by_wrong()
    high = {c for c in token if c > "\x7f"}
    # A sequence of bytes shows as two characters beyond ASCII side by side, or one and an ASCII one behind it; UTF-8 as the former, or as one of a wide table.
    for wrong, _, rights in groups:
        own = _high_set(wrong)
        if not rights or own.isdisjoint(high):
            continue
        if own.issuperset(high):
            parts = [_encode(token, wrong)]
        else:  # only runs of the table's characters are read anew
            parts = [_encode(x, wrong) if k % 2 else x for k, x in enumerate(_run_pattern(wrong).split(token))]
        for name, right in rights:
            try:
                yield name, "".join([x if isinstance(x, str) else x.decode(right) for x in parts])
            except UnicodeDecodeError:
                pass
    paired, wide = bool(_PAIR.search(token)), any(c > "\u2e7f" for c in high)
    for name, kind in rest:
        if (wide if kind == "wide" else paired) and (mended := undo(token, name)) is not None:
            yield name, mended


def tokens_evidence(tokens: list[str], model: Model) -> list[dict[str, float]]:
    """For each token, the nats of every chain that could have made it; absent chains can't have."""
    out: list[dict[str, float]] = [{} for _ in tokens]
    if not tokens:
        return out
    codes, at = _line(tokens)
    before = model.scores(codes, at)
    short = np.minimum(codes, 0x10000)
    owner = np.repeat(np.arange(len(tokens)), np.diff(np.append(at, len(codes) - 1)))
    for wrong, fast, _ in _by_wrong()[0]:
        own = np.unique(owner[_high_table(wrong)[short[:-1]]])
        if not len(own):
            continue
        part, place = _line([tokens[i] for i in own.tolist()])
        low, was = np.minimum(part, 0x10000), before[own]
        for name, right in fast:
            read = np.where(part > 0xFFFF, part, _reading(right, wrong)[low])
            differs = read != part
            ok = ~np.logical_or.reduceat(read[:-1] < 0, place) & np.logical_or.reduceat(differs[:-1], place)
            if ok.any():
                gain = model.gains(np.where(read < 0, part, read), place, was)
                for i, v in zip(own[ok].tolist(), gain[ok].tolist()):
                    out[i][name] = v
    found = [(i, name, mended) for i, t in enumerate(tokens) for name, mended in _slow_candidates(t) if mended and mended != t]
    if found:
        distinct = {x: k for k, x in enumerate(dict.fromkeys((i, mended) for i, _, mended in found))}
        gain = model.gains(*_line([m for _, m in distinct]), before[[i for i, _ in distinct]])
        for i, name, mended in found:
            out[i][name] = float(gain[distinct[i, mended]])
    return out


class Evidence:
    """Evidence of tokens, kept while few enough: (all nats by chain as two arrays, the positive ones)."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most, self.names = model, most, list(chains())
        self.number = {c: k for k, c in enumerate(self.names)}
        self.known: dict[str, tuple] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        new = sorted(tokens - self.known.keys())
        for lo in range(0, len(new), 20_000):
            own = new[lo : lo + 20_000]
            for t, e in zip(own, tokens_evidence(own, self.model)):
                self.known[t] = (np.array([self.number[c] for c in e], np.uint8), np.fromiter(e.values(), np.float32, len(e)), {self.number[c]: v for c, v in e.items() if v > 0.0})

    def of(self, token: str) -> dict[int, float]:
        chain, nats, _ = self.known[token]
        return dict(zip(chain.tolist(), nats.tolist()))


def high_tokens(text: str) -> list[tuple[int, int, str]]:
    """First and last code point and the text of each token with a character beyond ASCII."""
    return [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text) if not m[0].isascii() and m[0].strip()]


def stretch_evidence(text: str, tokens: list[tuple[int, int, str]], evidence: Evidence) -> dict[str, tuple[float, int, int]]:
    """Best stretch for each chain: nats less the stretch's own cost, first and last code point."""
    cost = math.log(len(tokens) + 1)
    hope: dict[int, float] = {}
    for _, _, t in tokens:
        for c, v in evidence.known[t][2].items():
            hope[c] = hope.get(c, 0.0) + v
    # No stretch has more nats than all tokens that speak for its chain.
    hope = {c: v for c, v in hope.items() if v - cost > 0.5}
    out = {}
    if hope:
        # Lone symbols in a row are an ornament or a list of letters: no word speaks for any reading of them.
        lone = [hi - lo == 1 for lo, hi, _ in tokens]
        muted = [x and (i > 0 and lone[i - 1] and tokens[i][0] - tokens[i - 1][1] == 1 or i + 1 < len(lone) and lone[i + 1] and tokens[i + 1][0] - tokens[i][1] == 1) for i, x in enumerate(lone)]
        scores = [evidence.of(t) for _, _, t in tokens]
        for chain in hope:
            best, run, begin = (0.0, 0, 0), 0.0, 0
            for (lo, hi, _), s, mute in zip(tokens, scores, muted):
                if run <= 0.0:
                    run, begin = 0.0, lo
                v = s.get(chain, IMPOSSIBLE)
                run += min(v, 0.0) if mute else v
                if run > best[0]:
                    best = (run, begin, hi)
            nats = best[0] - cost
            if nats > 0.5:
                out[evidence.names[chain]] = (nats, best[1], best[2])
    if "�" in text:
        out[LOST] = (MOST, text.index("�"), text.rindex("�") + 1)
    return out


def gather(df: DataFrame, id_col: str, text_col: str, source, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per record with evidence: the id, _source and ``found``, an array of (chain, nats, first, last).

    Every chain with evidence is kept: many mend a record alike, and only its source's other records tell which of them is the true one.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    item = pa.list_(pa.struct([("chain", pa.string()), ("nats", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(Model(*shared.value))
        for b in batches:
            texts = {i: (t, high_tokens(t)) for i, t in enumerate(b.column(1).to_pylist()) if t and not t.isascii()}
            evidence.learn({t for _, own in texts.values() for _, _, t in own})
            at, found = [], []
            for i, (text, own) in texts.items():
                if x := stretch_evidence(text, own, evidence):
                    best = sorted(x.items(), key=lambda kv: (-kv[1][0], kv[0]))
                    at.append(i)
                    beyond = max(0.0, best[0][1][0] - MOST)  # cut alike for all, so that their differences stay
                    found.append([{"chain": c, "nats": max(0.0, v[0] - beyond), "first": v[1], "last": v[2]} for c, v in best])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(found, item)], names=[id_col, "_source", "found"])

    return spread(df.where(F.col(text_col).isNotNull()).select(id_col, text_col, source.alias("_source"))).mapInArrow(run, f"`{id_col}` {kind}, _source string, found array<struct<chain:string,nats:double,first:int,last:int>>")


def _pool(pdf: pd.DataFrame, start: dict[str, float]) -> pd.DataFrame:
    """EM over one group of binned evidence: the expected number of records of each chain. Rows without evidence count in ``records``; start: the prior rates."""
    records = float(pdf["records"].iloc[0])
    groups = [[x.rsplit(":", 1) for x in k.split("|")] for k in pdf["key"]]
    names = sorted({c for g in groups for c, _ in g})
    number = {c: k for k, c in enumerate(names)}
    row = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    chain = np.array([number[c] for g in groups for c, _ in g])
    lift = np.exp(np.array([float(b) * BIN for g in groups for _, b in g]))
    n = pdf["n"].to_numpy(dtype=float)
    prior = np.array([start.get(c, BASE_RATE / max(1, len(names))) for c in names])
    rate = prior
    for _ in range(ROUNDS):
        weight = rate[chain] * lift
        total = max(1e-9, 1.0 - rate.sum()) + np.bincount(row, weight, len(groups))
        mass = np.bincount(chain, n[row] * weight / total[row], len(names))
        rate = (mass + PRIOR_WEIGHT * prior) / (records + PRIOR_WEIGHT)
    return pd.DataFrame({"_source": pdf["_source"].iloc[0], "chain": names, "mass": mass})


def judge(df: DataFrame, id_col: str, text_col: str, source_col: str, field: str = "text", least: float = 0.5, group: int = GROUP) -> DataFrame:
    """Id, chain, posterior (of any damage), first, last of every record judged damaged. Ids are unique."""
    source = F.concat(F.lit(field + ":"), F.coalesce(F.col(source_col), F.lit("\x00")))
    found = cut(gather(df, id_col, text_col, source, train(df, text_col)))
    key = F.array_join(F.array_sort(F.transform("found", lambda x: F.concat_ws(":", x.chain, F.floor(x.nats / BIN).cast("string")))), "|")
    counts = found.groupBy("_source", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(source.alias("_source")).agg(F.count(F.lit(1)).alias("all"))
    sizes = counts.groupBy("_source").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts"), F.sum("n").alias("with")).join(totals, "_source")
    sizes = cut(sizes)
    counts = cut(join_hot(counts, sizes, ["_source"], "with").select("_source", F.pmod(F.xxhash64("key"), "parts").alias("part"), "key", "n", (F.col("all") / F.col("parts")).alias("records")))

    def masses(start: dict[str, float]) -> DataFrame:
        return counts.groupBy("_source", "part").applyInPandas(lambda pdf: _pool(pdf, start), "_source string, chain string, mass double")

    # One row per chain: what all sources have in common is the prior of each.
    records = float(sizes.agg(F.sum("all")).first()[0] or 0)
    mass = {r[0]: r[1] for r in masses({}).groupBy("chain").agg(F.sum("mass")).collect()}
    pooled = {c: (m + PRIOR_WEIGHT * BASE_RATE / len(mass)) / (records + PRIOR_WEIGHT) for c, m in mass.items()}
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in pooled.items() for x in kv]), F.col("chain")) if pooled else F.lit(0.0)
    rates = masses(pooled).groupBy("_source", "chain").agg(F.sum("mass").alias("mass")).join(sizes, "_source")
    rates = rates.groupBy("_source", "with").agg(F.map_from_entries(F.collect_list(F.struct("chain", ((F.col("mass") + PRIOR_WEIGHT * prior) / (F.col("all") + PRIOR_WEIGHT)).alias("rate")))).alias("rates"))
    weigh = lambda x: F.element_at("rates", x.chain) * F.exp(x.nats)
    judged = join_hot(found, cut(rates), ["_source"], "with").withColumn("w", F.transform("found", lambda x: F.struct(weigh(x).alias("w"), x.alias("x"))))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.w)
    best = F.array_max("w")
    judged = judged.select(id_col, (total / (total + F.greatest(F.lit(1e-9), 1 - F.aggregate(F.map_values("rates"), F.lit(0.0), lambda a, x: a + x)))).alias("posterior"), best.x.alias("x"))
    return judged.where(F.col("posterior") >= least).select(id_col, "x.chain", "posterior", "x.first", "x.last")


def mend(text: str, chain: str, first: int, last: int) -> str:
    """The text with the chain undone between two code points; UTF-8 sequences, which nobody means, in the whole text."""
    if chains()[chain][0][0] == "utf8":
        first, last = 0, len(text)
    return text[:first] + _TOKEN.sub(lambda m: m[0] if m[0].isascii() else undo(m[0], chain) or m[0], text[first:last]) + text[last:]


def repair(df: DataFrame, id_col: str, text_col: str, source_col: str, **kw) -> DataFrame:
    """Damaged records: id, chain, posterior, recovered, and ``repaired``, the text as it was meant."""
    judged = cut(judge(df, id_col, text_col, source_col, **kw))

    @F.pandas_udf("string")
    def mended(text: pd.Series, chain: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([t if c == LOST else mend(t, c, a, b) for t, c, a, b in zip(text, chain, first, last)], dtype=object)

    out = df.select(id_col, F.col(text_col).alias("_t")).join(small(judged), id_col)
    return out.select(id_col, "chain", "posterior", (F.col("chain") != LOST).alias("recovered"), mended("_t", "chain", "first", "last").alias("repaired"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_documents(spark, sf_dir), "doc_id", "text", "source").select("doc_id")


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_documents(spark, sf_dir), "doc_id", "text", "source")


QUERIES = {"p8_found": p8_found, "p8_repaired": p8_repaired}
SQL: dict[str, str] = {}
