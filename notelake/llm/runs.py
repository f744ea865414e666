"""Periodic runs of words, found with bit-parallel lags.

A text's words get numbers, and each bit of these numbers makes one plane: a big integer with one
bit for each word. Shifted by a lag and XORed with itself, a plane shows where words that far apart
differ in that bit; ORed over the planes, where they differ at all. A run with that period is a long
enough stretch of zeros, which shift-doubling ANDs isolate: after each step a bit stands for twice
as many equal words on end.

Nulls and empty texts have no words and no runs. A text of any length is searched whole, within one
task; it costs a pass over its planes for each lag up to a quarter of its words. Rows that repeat an
id are searched one by one, a null id stays null, and columns other than the id and the text are
not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Words, fresh, session_of, slices

#: A run has so many words at least, and repeats its period so often.
LEAST, REPEATS = 6, 4

#: From so many words on, a lag must show equal words at some of its multiples before it is tried.
#: Any run does, so this drops none; in shorter texts trying the lag costs no more than looking.
LOOK_FIRST = 1 << 16

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def isolated(bits: int, need: int) -> int:
    """The places where ``need`` set bits on end begin."""
    have = 1
    while bits and 2 * have <= need:
        bits &= bits >> have
        have *= 2
    return bits & bits >> (need - have)


def stretches(places: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of set bits."""
    bits = np.unpackbits(np.frombuffer(places.to_bytes((places.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=0, append=0)).tolist()
    return [(a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def planes_of(ids: np.ndarray) -> list[int]:
    """The bit planes of word numbers, those that part the words most evenly first."""
    distinct, ids = np.unique(ids, return_inverse=True)
    bits = [ids >> b & 1 for b in range(max(1, int(len(distinct) - 1).bit_length()))]
    bits.sort(key=lambda x: abs(2 * int(x.sum()) - len(x)))
    return [int.from_bytes(np.packbits(x.astype(np.uint8), bitorder="little").tobytes(), "little") for x in bits]


def runs_of(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start, then period.

    A run is a stretch with smallest period q of ``max(least, repeats * q)`` words or more that
    neither neighbouring word extends; ``repeats`` is 2 or more.
    """
    n = len(ids)
    if n < least:
        return []
    planes = planes_of(ids)
    found: dict[tuple[int, int], int] = {}
    whole = (1 << n) - 1
    for q in range(1, n // repeats + 1):
        whole >>= 1
        if n >= LOOK_FIRST and not _equal_at_multiples(ids, q, repeats):
            continue
        need = max(least - q, (repeats - 1) * q)
        differ = 0
        for k, plane in enumerate(planes):
            differ |= plane ^ plane >> q
            # Most lags are out after two planes; the others need them all.
            if k == 1 and not isolated(whole & ~differ, need):
                break
        else:
            for start, more in stretches(places) if (places := isolated(whole & ~differ, need)) else ():
                # The same stretch found with a smaller lag has that period, and q is a multiple of it.
                found.setdefault((start, more + need - 1 + q), q)
            if (0, n) in found:  # all has that period: a longer one can't be a run's smallest
                break
    return sorted((start, length, q) for (start, length), q in found.items())


def _equal_at_multiples(ids: np.ndarray, q: int, repeats: int) -> bool:
    """Whether as many multiples of q on end as a run must cover hold the same word."""
    at = ids[::q]
    same = at[1:] == at[:-1]
    together = len(same) - repeats + 2
    out = same[:together].copy()
    for k in range(1, repeats - 1):
        out &= same[k : k + together]
    return bool(out.any())


def repeats_in(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words is in some run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: the runs (start, length, period) of its words
    by start, then period, and its text with each run cut to its first period, words joined by one
    space. Words are what white space of ASCII parts."""
    session_of(docs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=False)
                pool = words.distinct.to_pylist()
                sizes, flat, texts = [0], [], []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    codes = words.codes[a:b]
                    runs = runs_of(codes)
                    if runs:
                        codes = codes[~repeats_in(b - a, runs)]
                    flat += runs
                    sizes.append(len(flat))
                    texts.append(" ".join([pool[c] for c in codes.tolist()]))
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first)), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search, SCHEMA)


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the texts, chosen by their id's checksum, repeat a part of
    theirs to their end. With checksum h and g = h div 10, the n words from a = g mod n on become
    the first p = 1 + (n - a) div (3 + g mod 8) of them over and over. Rows without an id or without
    words stay as they are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("words"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")
    rows = rows.withColumn("a", a).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what
    periodic_runs() gives: the strongest run by exact length / period, ties to the smaller start,
    then period (nulls without a run), and digests of all runs and of the collapsed text."""
    best = fresh(found, "best")
    stronger = lambda old, new: F.when(new["length"] * old["period"] > old["length"] * new["period"], new).otherwise(old)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn(best, F.aggregate("runs", F.get("runs", F.lit(0)), stronger))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(best)[c].alias(c) for c in ("start", "length", "period")],
        F.expr(f"1000 * {best}.length div {best}.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
