"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer.

Method: a tree of halves. Each leaf is encoded alone; two neighbours are
joined by re-encoding a window around their border. The window grows until
both of its edges are *certain* cuts: positions where the pre-tokenizer splits
whatever surrounds them, because no alternative of its pattern can match
across. Encoding is a homomorphism over certain cuts, so the tokens outside
the window are proven final and those inside are replaced. Without a certain
cut the window becomes the whole of both neighbours, which is exact too.

Defined results: null and empty texts give an empty list; text that spells a
special token is plain text; decoding joins the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lorewright.session import spread, table

#: Folder of the public vocabulary files; LOREWRIGHT_TOKENIZERS names another.
TOKENIZER_DIR = os.environ.get("LOREWRIGHT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 1024
#: Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters, marks and spaces whose class is the same in every Unicode version in use.
_L = r"A-Za-zÀ-ÖØ-öø-ſΑ-ΡΣ-Ωα-ωА-яаёء-غف-يअ-हก-ะぁ-ゔァ-ヺ一-龥"
_P = r"!-&\(-/:;<=>?@\[\]\\^_`{|}~。、，！？：；「」『』（）“”«»…।"
_CERTAIN = regex.compile(rf"(?<=[{_L}0-9{_P}'])(?=[ \n\r\t])|(?<=[{_L}])(?=[{_P}'0-9])|(?<=[{_P}])(?=[{_L}0-9])|(?<=[0-9])(?=[{_L}{_P}'])")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _join(text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int], encode) -> list[int]:
    width = 64
    while True:
        a, b = max(lo, mid - width), min(hi, mid + width)
        p = lo if a == lo else next((m.start() for m in _CERTAIN.finditer(text, a, mid)), None)
        q = hi if b == hi else next((m.start() for m in _CERTAIN.finditer(text, mid + width // 2, b)), None)
        if p is not None and q is not None:
            break
        width *= 4
    keep = len(left) - len(encode(text[p:mid]))
    drop = len(encode(text[mid:q]))
    return left[:keep] + encode(text[p:q]) + right[drop:]


def encode_tree(text: str, encode, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of a text; encode is the tokenizer's function for one string."""

    def node(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(text[lo:hi])
        mid = (lo + hi) // 2
        return _join(text, lo, mid, hi, node(lo, mid), node(mid, hi), encode)

    return node(0, len(text)) if text else []


def decode_tree(ids: list[int], token_bytes) -> bytes:
    """Bytes of a token list, joined pairwise; token_bytes gives those of one id."""
    if len(ids) <= 64:
        return b"".join(map(token_bytes, ids))
    mid = len(ids) // 2
    return decode_tree(ids[:mid], token_bytes) + decode_tree(ids[mid:], token_bytes)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """The id column and ``ids`` of each row; no shuffle, one pass over the text column."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes, flat = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    flat.append(np.asarray(encode_tree(text, encode, leaf), dtype=np.int32))
                    sizes.append(len(flat[-1]))
                else:
                    sizes.append(0)
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
