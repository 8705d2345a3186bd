"""Problem 7: held-out evaluation passages inside the training corpus.

Method: q-gram lemma filtering. Texts are folded (case, accents, punctuation, line
breaks) into words. Character q-grams that begin at word starts are looked up in an index
of the passages; hits are counted per passage in overlapping diagonal bands (document
word minus passage word). A passage's threshold is the number of q-grams that any region
within the edit budget must share, so a band below it cannot hold a case. Bands that
reach it are verified by banded alignment of words with furthest-reaching points.

A case: at least 14 consecutive words of the passage, or at least 24 of which no more than
one in eight is replaced, added or left out.

The passages are the stated query set. Their measured size decides the number of passes over the documents: up to
``INDEX_BYTES`` of passages, indexed in blocks of ``BLOCK_ITEMS`` by the executors, are broadcast for one pass without a shuffle.

Scripts without blanks between words (Han, kana, Thai, Lao, Khmer, Burmese) count each letter as a word.

Defined results: null, empty and very short texts hold no case; repeated documents are
each reported; two items of equal text are both reported.
"""

from __future__ import annotations

import functools
import math
import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.session import cut, spread, table

EXACT_WORDS, FUZZY_WORDS, PER_EDIT, RUN_WORDS = 14, 24, 8, 6
Q_SIZES = (20, 16, 12, 8, 5)
BLOCK_ITEMS = 5_000
INDEX_BYTES = 16 << 20
BAND = 16
#: Passage words looked at together, and table cells held at a time, in the verification.
WINDOW, CELLS = 2_048, 1 << 22
#: First and last code point of the scripts whose letters are words.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Per code point: 0 to delete, 32 for a gap, else the folded character."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000 or 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xD7B0 or i >= 0x20000:
            out[i] = i if i < 0xE0000 else 0
            continue
        c = chr(i)
        kind = unicodedata.category(c)
        if c.isspace() or kind[0] == "Z" or c in "—–―":
            out[i] = 32
        elif kind[0] in "LN":
            for d in unicodedata.normalize("NFKD", c.lower()):
                if unicodedata.category(d)[0] in "LN":
                    out[i] = ord(d.lower()[0])
                    break
    return out


@functools.lru_cache(maxsize=1)
def _alone() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    for lo, hi in UNSPACED:
        out[lo : hi + 1] = True
    return out


def _parted(chars: np.ndarray) -> np.ndarray:
    """With a gap on either side of each letter that is a word."""
    alone = _alone()[chars]
    if not alone.any():
        return chars
    width = np.where(alone, 3, 1)
    out = np.repeat(chars, width)
    at = (np.cumsum(width) - width)[alone]
    out[at] = out[at + 2] = 32
    return out


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))


class Folded:
    """Several texts as folded characters, words and word hashes."""

    def __init__(self, texts: list[str | None]):
        joined = "\n\x01\n".join((t or "").replace("\x01", " ") for t in texts)
        if "ß" in joined or "ẞ" in joined:
            joined = joined.replace("ß", "ss").replace("ẞ", "ss")
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        folded = _fold_table()[raw]
        folded[raw == 1] = 1
        folded = _parted(folded[folded != 0])
        gap = folded == 32
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        self.chars = np.concatenate([folded[keep], np.full(max(Q_SIZES) + 1, 32, np.uint32)]).astype(np.uint64)
        gap = self.chars == 32
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        self.starts, self.lengths = starts, ends[: len(starts)] - starts
        is_mark = self.chars[starts] == 1
        self.text_of = np.cumsum(is_mark)  # the marks themselves are words that match nothing
        self.is_mark = is_mark
        if len(starts):
            offset = np.arange(len(self.chars)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(self.chars)]])))
            inside = ~gap
            weight = _powers(int(offset[inside].max()) + 1)
            with np.errstate(over="ignore"):
                value = np.where(inside, (self.chars + np.uint64(7)) * weight[np.where(inside, offset, 0)], np.uint64(0))
                self.words = np.add.reduceat(value, starts)
        else:
            self.words = np.empty(0, np.uint64)
        self.words[is_mark] = np.arange(int(is_mark.sum()), dtype=np.uint64)

    def runs(self) -> np.ndarray:
        """Hash of the RUN_WORDS words from every word on."""
        padded = np.concatenate([self.words, np.arange(RUN_WORDS, dtype=np.uint64)])
        out = np.zeros(len(self.words), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, w in enumerate(_powers(RUN_WORDS)):
                out += (padded[k : k + len(out)] ^ (padded[k : k + len(out)] >> np.uint64(31))) * w
            return out ^ (out >> np.uint64(29))

    def grams(self, q: int) -> np.ndarray:
        """Hash of the q characters from every word start on."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, w in enumerate(_powers(q)):
                out += (self.chars[self.starts + k] + np.uint64(7)) * w
            return out ^ (out >> np.uint64(29))


def _need(lengths: np.ndarray, q: int) -> int:
    """Fewest q-grams at word starts that a case in a passage with these word lengths shares."""
    n = len(lengths)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    # An edit at word j spoils the grams that begin at or before it and reach it.
    last = np.minimum(np.searchsorted(begin, begin[:n] + q - 1, side="right") - 1, n - 1)
    change = np.bincount(np.arange(n), minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)
    kills = np.cumsum(change)[:n]

    def worst(size: int, edits: int) -> int:
        if n < size:
            return 1 << 20
        at = np.arange(n - size + 1)
        inside = np.clip(np.searchsorted(begin, begin[at + size] - 1 - q, side="right") - at, 0, size)
        spoilt = np.sort(np.lib.stride_tricks.sliding_window_view(kills, size), axis=1)[:, size - edits :].sum(axis=1)
        return int((inside - spoilt).min())

    # A fuzzy case of 48 words or more holds one of 24 to 47 that keeps the budget.
    return min(worst(EXACT_WORDS, 0), *(worst(s, s // PER_EDIT) for s in range(FUZZY_WORDS, 2 * FUZZY_WORDS)))


class Index:
    """Passages by q-gram; q is chosen per passage so that its threshold stays positive."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.asarray(ids, dtype=np.int64)
        folded = Folded(texts)
        self.items = []
        mark = folded.chars[folded.starts] == 1
        needs, sizes = [], []
        for k in range(len(ids)):
            at = np.flatnonzero((folded.text_of == k) & ~mark)
            self.items.append(folded.words[at])
            lengths = folded.lengths[at]
            need, q = 0, Q_SIZES[-1]
            if len(at) >= EXACT_WORDS:
                for q in Q_SIZES:
                    if (need := _need(lengths, q)) >= 2:
                        break
            needs.append(max(1, need))
            sizes.append(q)
        self.needs = np.asarray(needs)
        first = np.concatenate([[0], np.flatnonzero(mark) + 1])
        size_of = np.asarray(sizes + [0])[folded.text_of.clip(0, len(ids))]
        self.tables = {q: self._postings(folded, first, folded.grams(q), (size_of == q) & ~mark) for q in sorted(set(sizes))}
        long = np.asarray([len(w) >= EXACT_WORDS for w in self.items] + [False])[folded.text_of.clip(0, len(ids))]
        self.run_table = self._postings(folded, first, folded.runs(), long & ~mark)

    @staticmethod
    def _postings(folded: Folded, first: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> tuple:
        at = np.flatnonzero(own)
        keys, item, word = hashes[at], folded.text_of[at], at - first[folded.text_of[at]]
        order = np.argsort(keys, kind="stable")
        keys, item, word = keys[order], item[order], word[order]
        unique, begin = np.unique(keys, return_index=True)
        width = min(22, max(12, len(unique).bit_length() + 5))
        bits = np.zeros(1 << width, dtype=bool)
        bits[(unique >> np.uint64(64 - width)).astype(np.int64)] = True
        return unique, begin, np.diff(np.append(begin, len(keys))), item, word, bits, np.uint64(64 - width)

    def _hits(self, docs: Folded, first: np.ndarray, hashes: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        """document * passages + passage, and the diagonal (document word minus passage word), of every hit."""
        unique, begin, count, item, word, bits, shift = table
        at = np.flatnonzero(bits[(hashes >> shift).astype(np.int64)])
        pos = np.searchsorted(unique, hashes[at]).clip(0, max(0, len(unique) - 1))
        same = unique[pos] == hashes[at] if len(unique) else np.zeros(0, bool)
        at, pos = at[same], pos[same]
        n = count[pos]
        source = np.repeat(at, n)
        posting = np.repeat(begin[pos] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
        doc = docs.text_of[source]
        return doc.astype(np.int64) * len(self.ids) + item[posting], source - first[doc] - word[posting]

    def search(self, texts: list[str | None] | Folded) -> list[tuple[int, int]]:
        """(position of the text, position of the passage) of every case."""
        docs = texts if isinstance(texts, Folded) else Folded(texts)
        if not len(docs.starts):
            return []
        first = np.concatenate([[0], np.flatnonzero(docs.is_mark) + 1, [len(docs.starts) + 1]])
        # A band's number is its lowest diagonal, counted from the lowest there can be.
        longest = max(map(len, self.items), default=0)
        bands = (int(np.diff(first).max()) + longest) // BAND + 3
        number = lambda pair, diagonal, shift: pair * bands + (diagonal + longest + shift) // BAND
        keys = []
        run_pair, run_diagonal = self._hits(docs, first, docs.runs(), self.run_table)
        possible = np.unique(run_pair)
        if not len(possible):
            return []
        for q, table in self.tables.items():
            pair, diagonal = self._hits(docs, first, docs.grams(q), table)
            near = possible[np.searchsorted(possible, pair).clip(0, len(possible) - 1)] == pair
            pair, diagonal = pair[near], diagonal[near]
            for shift in (0, BAND // 2):
                key, counts = np.unique(number(pair, diagonal, shift), return_counts=True)
                key = key[counts >= self.needs[key // bands % len(self.ids)]]
                key = np.intersect1d(key, number(run_pair, run_diagonal, shift))
                keys.append(np.stack([key // bands, key % bands * BAND - shift - longest]))
        pair, low = np.concatenate(keys, axis=1)
        doc, item = pair // len(self.ids), pair % len(self.ids)
        likely = self._plausible(docs, first, doc, item, low)
        found: dict[tuple[int, int], bool] = {}
        for d, k, at in zip(doc[likely].tolist(), item[likely].tolist(), low[likely].tolist()):
            found[d, k] = found.get((d, k)) or leaks(self.items[k], docs.words[first[d] : first[d + 1] - 1], at)
        return [x for x, yes in found.items() if yes]

    def _plausible(self, docs: Folded, first: np.ndarray, d: np.ndarray, k: np.ndarray, low: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Bands with enough equal words: any case holds one whose diagonals spread over at most half a band."""
        sizes = np.asarray([len(w) for w in self.items])
        order = np.argsort(sizes[k], kind="stable")
        yes = np.zeros(len(k), dtype=bool)
        least = FUZZY_WORDS - (2 * FUZZY_WORDS - 1) // PER_EDIT
        at = 0
        while at < len(order):
            c = order[at : at + chunk]
            c = c[: max(1, CELLS // max(1, int(sizes[k[c[-1]]])))]
            at += len(c)
            n = int(sizes[k[c[-1]]])
            words = np.zeros((len(c), n), dtype=np.uint64)
            for row, x in enumerate(k[c].tolist()):
                words[row, : sizes[x]] = self.items[x]
            begin, end = first[d[c]][:, None], first[d[c] + 1][:, None] - 1
            equal = np.zeros((len(c), n), dtype=bool)
            place = begin + low[c][:, None] + np.arange(n)
            for _ in range(BAND):
                equal |= (docs.words[place.clip(0, len(docs.words) - 1)] == words) & (place >= begin) & (place < end)
                place += 1
            equal &= np.arange(n) < sizes[k[c]][:, None]
            total = np.concatenate([np.zeros((len(c), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32)], axis=1)
            fits = (total[:, EXACT_WORDS:] - total[:, :-EXACT_WORDS]).max(axis=1) >= EXACT_WORDS
            if n >= FUZZY_WORDS:
                fits |= (total[:, FUZZY_WORDS:] - total[:, :-FUZZY_WORDS]).max(axis=1) >= least
            yes[c] = fits
        return yes


def leaks(item: np.ndarray, doc: np.ndarray, low: int) -> bool:
    """Banded verification around the diagonals [low, low + BAND).

    Every case holds one of less than 2 * FUZZY_WORDS words, so long passages are verified window by window.
    """
    most = 2 * FUZZY_WORDS
    return any(_leaks(item[at : at + WINDOW], doc, low + at) for at in range(0, max(1, len(item) - most), WINDOW - most))


def _leaks(item: np.ndarray, doc: np.ndarray, low: int) -> bool:
    n, m = len(item), len(doc)
    if n < EXACT_WORDS:
        return False
    margin = 2 * FUZZY_WORDS // PER_EDIT + 1
    at = np.arange(n) + np.arange(low - margin, low + BAND + margin)[:, None]
    equal = (doc[at.clip(0, m - 1)] == item) & (at >= 0) & (at < m)
    # Length of the run of equal words that starts at each cell.
    runs = np.zeros((len(equal), n + 1), dtype=np.int32)
    for i in range(n - 1, -1, -1):
        runs[:, i] = np.where(equal[:, i], runs[:, i + 1] + 1, 0)
    if runs[margin : margin + BAND].max() >= EXACT_WORDS:
        return True
    if n < FUZZY_WORDS:
        return False
    core = equal[margin : margin + BAND]
    begins = core & ~np.concatenate([np.zeros((BAND, 1), bool), core[:, :-1]], axis=1)
    for r, i in zip(*np.nonzero(begins)):
        if _reach(runs, int(r) + margin, int(i), n):
            return True
    return False


def _reach(runs: np.ndarray, row: int, start: int, n: int) -> bool:
    """Furthest passage word per diagonal for 0, 1, 2 ... edits from a run's start."""
    far = {row: start + int(runs[row, start])}
    for edits in range(min(n - start, 2 * FUZZY_WORDS) // PER_EDIT + 1):
        if edits:
            step: dict[int, int] = {}
            for r, i in far.items():
                for to, j in ((r, i + 1), (r + 1, i), (r - 1, i + 1)):  # replaced, added, left out
                    if 0 <= to < len(runs) and j <= n and step.get(to, -1) < j:
                        step[to] = j
            far = {r: i + int(runs[r, i]) if i < n else i for r, i in step.items()}
        # An edit may not be the last word: the case would be as good without it.
        best = max(far.values()) - start
        if best >= FUZZY_WORDS and best >= PER_EDIT * edits:
            return True
        if best < PER_EDIT * edits - PER_EDIT * 3:
            return False
    return False


def _built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One index for all passages of a partition."""
    rows = pd.concat([pd.DataFrame({"i": [], "t": []}), *batches])
    if len(rows):
        rows = rows.sort_values("i")
        yield pd.DataFrame({"index": [pickle.dumps(Index([int(i) for i in rows["i"]], rows["t"].tolist()), protocol=5)]})


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_ITEMS, most: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id of every document that repeats a passage."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, `{item_id}` {item_kind}"
    texts = docs.select(doc_id, doc_text).where(f"`{doc_text}` IS NOT NULL")
    passages = cut(items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL AND i IS NOT NULL").distinct())
    number, size = passages.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    passes = max(1, math.ceil((size or 0) / most))
    out = spark.createDataFrame([], schema)
    for p in range(passes if number else 0):
        own = passages.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p) if passes > 1 else passages
        built = own.repartition(max(1, math.ceil(number / passes / block)), "i").mapInPandas(_built, "index binary").collect()
        part = spark.sparkContext.broadcast([bytes(r[0]) for r in built])

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in part.value]
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    rows = batch.slice(lo, 512)
                    folded = Folded(rows.column(1).to_pylist())
                    for index in indexes:
                        found = index.search(folded)
                        if found:
                            ids = rows.column(0).take(pa.array([d for d, _ in found]))
                            yield pa.RecordBatch.from_arrays([ids, pa.array([int(index.ids[k]) for _, k in found], pa.int64())], names=[doc_id, item_id])

        out = out.unionByName(spread(texts).mapInArrow(run, schema))
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_passages", "item_id", "text")).distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p7_found(spark, sf_dir).groupBy("item_id").count().withColumnRenamed("count", "n_documents")


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
