"""Four-gram SimHash fingerprints and their similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from notelake.functions.text import WORD

GRAM = 4

#: Kinds of fingerprints: how many bits, how a text's case is folded, and a gram's digest. SQL has
#: md5, of which the first 15 hex digits fit a signed long.
HASHES = {
    "blake2b": (64, str.casefold, lambda gram: int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")),
    "md5": (60, str.lower, lambda gram: int(hashlib.md5(gram.encode()).hexdigest()[:15], 16)),
}


def _line(text: str | None, folded: Callable[[str], str]) -> str:
    words = regex.findall(WORD, text or "")
    return f"  {folded(' '.join(words))}  " if words else ""


def _votes(digests: list[int], bits: int) -> np.ndarray:
    """+1 for each set bit of each digest, -1 for the others."""
    own = np.array(digests, np.uint64)
    return (2 * (own[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.int8) - 1).astype(np.int8)


def _signed(total: np.ndarray) -> int:
    """The bits with more votes for than against, as a signed long."""
    return int.from_bytes(np.packbits(total > 0, bitorder="little").tobytes().ljust(8, b"\0"), "little", signed=True)


def fingerprints(texts: list[str | None], kind: str = "blake2b") -> list[int | None]:
    """Of each text: bit k is set where four-grams with bit k outnumber those without; None without
    words. Each different gram of the batch is hashed once."""
    bits, folded, digest = HASHES[kind]
    lines = [_line(t, folded) for t in texts]
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) for x in lines])
    if not len(points):
        return [None] * len(texts)
    letters, code = np.unique(points, return_inverse=True)
    if len(letters) > 1 << 15:  # four codes wouldn't fit in a key: halve the batch, or the text's letters are too many
        half = len(texts) // 2
        return [*fingerprints(texts[:half], kind), *fingerprints(texts[half:], kind)] if half else [_slow(lines[0], kind)]
    code = code.astype(np.int64)
    n = len(code) - GRAM + 1
    key = ((code[:n] << 45) | (code[1 : n + 1] << 30) | (code[2 : n + 2] << 15) | code[3 : n + 3]).astype(np.int64)
    distinct, place = np.unique(key, return_inverse=True)
    chars = letters[np.stack([distinct >> 45 & 32767, distinct >> 30 & 32767, distinct >> 15 & 32767, distinct & 32767], axis=1)]
    text = chars.astype(np.uint32).tobytes().decode("utf-32-le")
    votes = _votes([digest(text[i : i + GRAM]) for i in range(0, len(text), GRAM)], bits)
    out: list[int | None] = []
    for line, end in zip(lines, ends.tolist(), strict=True):
        if not line:
            out.append(None)
            continue
        total = np.zeros(bits, np.int64)
        for at in range(end - len(line), end - GRAM + 1, 1 << 16):
            total += votes[place[at : min(at + (1 << 16), end - GRAM + 1)]].sum(axis=0, dtype=np.int64)
        out.append(_signed(total))
    return out


def _slow(line: str, kind: str) -> int | None:
    """The same for one line, some grams at a time."""
    bits, _, digest = HASHES[kind]
    total = np.zeros(bits, np.int64)
    for at in range(0, len(line) - GRAM + 1, 1 << 12):
        total += _votes([digest(line[i : i + GRAM]) for i in range(at, min(at + (1 << 12), len(line) - GRAM + 1))], bits).sum(axis=0, dtype=np.int64)
    return _signed(total) if line else None


def _kernel(kind: str):
    @F.pandas_udf(LongType())
    def kernel(texts: pd.Series) -> pd.Series:
        out: list[int | None] = []
        for at in range(0, len(texts), 200):
            out += fingerprints([None if t is None or t is pd.NA else t for t in texts[at : at + 200]], kind)
        return pd.Series(out, index=texts.index, dtype="Int64")

    return kernel


def fingerprint_column(text: Column, kind: str = "blake2b") -> Column:
    """The fingerprint of a text; null without words."""
    return _kernel(kind)(text)


def simhash(docs: DataFrame, id_col: str, text_col: str, kind: str = "blake2b") -> DataFrame:
    """(id, fingerprint) of each text with words, as a signed long.

    No built-in has blake2b, or sums 64 signed votes per gram without a row for each; an Arrow UDF
    hashes each distinct gram of a batch once.
    """
    return docs.select(id_col, fingerprint_column(F.col(text_col), kind).alias("fingerprint")).where("fingerprint IS NOT NULL")


def fingerprint_similarity(a: Column, b: Column, kind: str = "blake2b") -> Column:
    """The share of equal bits, to four places; halves go to the even digit."""
    return F.bround(F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(HASHES[kind][0])), 4)


def lexical_similarity(query_words: Column, text_words: Column) -> Column:
    """The share of the query's distinct words that the text has; 0 if either has none."""
    shared = F.size(F.array_intersect(query_words, text_words))
    return F.when((F.size(query_words) == 0) | (F.size(text_words) == 0), 0.0).otherwise(shared / F.size(query_words))


def similar_kind(similarity: Column) -> Column:
    return F.when(similarity >= 0.8, "duplicate_candidate").otherwise("related")
