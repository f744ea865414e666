"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash over the last 32 bytes picks the chunk ends, so that an insertion moves only the
chunks it touches. Chunks end after white space (words stay whole) where two hash bits are zero,
about every fourth word; after each line end; and, in text without white space, between
characters where nine bits are zero. Two chunks on end have a digest, 128 bits of XXH3 (a text's
only chunk has one by itself), so that a phrase or line which many documents have says nothing of
what stands next to it. Of a digest's occurrences the first by (document, place) stays; chains of
later occurrences that are long enough to be a passage are removed, shorter repeats (stock
phrases, licence lines) stay.

The table of digests is never grouped as a whole: counts and first occurrences are combined
before the shuffle, and the second pass sends on only those that may be repeated, by a bit table
of fixed size that is checked exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import _SPACE, Scratch, fresh, hash_bits, marked, record, session_of, slices, small_or_plain, stored, text_bytes

#: The gear: a pseudo-random 32-bit value for each byte, from a fixed seed.
GEAR = np.random.default_rng(20240613).integers(0, 1 << 32, 256, dtype=np.uint32)
_WINDOW = 32
_WORD_CUT = np.uint32(0b11 << 30)
_ANY_CUT = np.uint32(0x1FF << 23)

#: Words that a removed run has at least, and words of it that one earlier document has.
MIN_WORDS = 25
MIN_OWNED = 20

#: The bit table of repeated digests has 2**TABLE_BITS bits (8 MB).
TABLE_BITS = 26

#: Spans that are sent to all tasks; more are joined by a shuffle.
SENT_SPANS = 200_000

_CHUNKS = "h1 long, h2 long, doc_id long, text_key long, start long, size int, words int, next_words int"


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks end in texts laid on end: ascending places, each text's end among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[data]
    # After these steps h[i] sums the last 32 bytes' gears, each shifted by its age.
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step)
        h[step:] += older
    space = _SPACE[data]
    # Near a text's start the window would reach into the text before: hash those bytes anew.
    heads = [(a, min(a + _WINDOW, b)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if a and b > a]
    if heads:
        begin = np.array([a for a, _ in heads])
        length = np.array([b - a for a, b in heads])
        value = np.zeros(len(heads), np.uint32)
        for k in range(_WINDOW):
            live = length > k
            at = begin[live] + k
            value[live] = (value[live] << np.uint32(1)) + GEAR[data[at]]
            h[at] = value[live]
    inside = np.ones(n, bool)  # the next byte doesn't continue a character
    inside[:-1] = (data[1:] & 0xC0) != 0x80
    cut = (space & ((h & _WORD_CUT) == 0)) | (data == 10) | (inside & ((h & _ANY_CUT) == 0))
    cut[offsets[1:][offsets[1:] > 0] - 1] = True
    return np.flatnonzero(cut) + 1


def chunks(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """The digests of (doc_id, text_key, text), a row for each two chunks on end; of those in
    ``known``, a table of hash_bits(), if given."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                ends = chunk_ends(data, offsets)
                if not len(ends):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                row = np.searchsorted(offsets, starts, side="right") - 1
                # A chunk and the next one of its text; a text's last chunk goes with the one before.
                same = np.append(row[1:] == row[:-1], False)
                only = ~same & ~np.concatenate([[False], same[:-1]])
                at = np.flatnonzero(same | only)
                to = np.where(same[at], np.append(ends[1:], 0)[at], ends[at])
                raw = data.tobytes()
                digest = xxhash.xxh3_128_digest
                pairs = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts[at].tolist(), to.tolist(), strict=True)]), ">i8").reshape(-1, 2).astype(np.int64)
                if known is not None:
                    keep = marked(known, np.ascontiguousarray(pairs[:, 0]).view(np.uint64))
                    at, to, pairs = at[keep], to[keep], pairs[keep]
                space = _SPACE[data]
                begins = ~space
                begins[1:] &= space[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                begins[heads] |= ~space[heads]
                done = np.concatenate([[0], np.cumsum(begins)])
                names, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
                yield record(
                    [x.split()[0] for x in _CHUNKS.split(", ")],
                    [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), names[row[at]].astype(np.int64), keys[row[at]].astype(np.int64), starts[at] - offsets[row[at]]]
                    + [x.astype(np.int32) for x in (to - starts[at], done[ends[at]] - done[starts[at]], done[to] - done[ends[at]])],
                )

    return docs.mapInArrow(scan, _CHUNKS)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text) of rows with an id and a text. ``text_key`` is 0, but a hash of the
    text where different texts share the id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    key = F.xxhash64("text")
    twice = rows.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low < high").select("doc_id", F.lit(True).alias("shared"))
    return rows.join(small_or_plain(stored(twice, "shared-ids")), "doc_id", "left").select("doc_id", F.when(F.col("shared"), key).otherwise(F.lit(0)).cast("long").alias("text_key"), "text")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_owned: int = MIN_OWNED) -> DataFrame:
    """The passages that also occur before: (doc_id, start, length, words, source_id, owned_words, text_key).

    ``start`` and ``length`` count bytes of UTF-8. A span is a maximal chain of chunks whose
    digests occur earlier, in a document with a smaller id or further up in the same one, with at
    least ``min_words`` words, ``min_owned`` of them in digests first seen in ``source_id``. A
    digest's first occurrence, and what overlaps it, is never in a span.

    Rows with a null id or a null or empty text have no spans. Rows that repeat an id and text
    count as one document; different texts that share an id are documents of their own, in order
    of ``text_key`` (0 for all others). No rows give no spans; other columns are ignored. A text
    of any length is scanned whole, in one worker (about 30 bytes a byte of it).
    """
    scratch = Scratch(session_of(docs))
    chosen = keyed(docs, id_col, text_col)
    seen = chunks(chosen).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("first")).where("n > 1")
    seen = scratch.stored(seen.select("h1", "h2", F.col("first.doc_id").alias("owner"), F.col("first.text_key").alias("owner_key"), F.col("first.start").alias("owner_start")), "chunk-firsts")
    again = chunks(chosen, hash_bits(seen, "h1", TABLE_BITS)).join(seen, ["h1", "h2"])
    own = (F.col("doc_id") == F.col("owner")) & (F.col("text_key") == F.col("owner_key"))
    again = again.where(~own | (F.col("start") >= F.col("owner_start") + F.col("size"))).select("doc_id", "text_key", "start", "size", "words", "next_words", "owner").distinct()
    place = Window.partitionBy("doc_id", "text_key").orderBy("start")
    end = F.col("start") + F.col("size")
    runs = again.withColumn("new", F.when(F.lag(end).over(place) > F.col("start"), 0).otherwise(1)).withColumn("w", F.col("words") + F.when(F.lead("start").over(place) < end, 0).otherwise(F.col("next_words"))).withColumn("run", F.sum("new").over(place))
    owned = runs.groupBy("doc_id", "text_key", "run", "owner").agg(F.min("start").alias("a"), F.max(end).alias("b"), F.sum("w").alias("w"))
    spans = owned.groupBy("doc_id", "text_key", "run").agg(F.min("a").alias("start"), (F.max("b") - F.min("a")).alias("length"), F.sum("w").alias("words"), F.max(F.struct("w", (-F.col("owner")).alias("o"))).alias("top"))
    spans = spans.select("doc_id", "start", "length", "words", (-F.col("top.o")).alias("source_id"), F.col("top.w").alias("owned_words"), "text_key")
    out = stored(spans.where((F.col("words") >= min_words) & (F.col("owned_words") >= min_owned)), "spans")
    scratch.drop()
    return out


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the spans of repeated_spans() cut out of their texts; all columns stay.

    Texts without spans come back unchanged, also those that share an id with one that has some.
    A text that is one repeat becomes empty. Null ids and null texts stay as they are; no rows give
    no rows; columns may have any names.
    """
    doc, key, cuts = (fresh(docs, c) for c in ("span_doc", "span_key", "span_cuts"))
    lists = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cuts)).withColumnsRenamed({"doc_id": doc, "text_key": key})
    few = spans.count() <= SENT_SPANS
    mine = (F.col(id_col).cast("long") == F.col(doc)) & ((F.col(key) == 0) | (F.col(key) == F.xxhash64(F.col(text_col).cast("string"))))
    joined = docs.join(F.broadcast(lists) if few else lists, mine, "left")

    names, at = docs.columns, docs.columns.index(text_col)

    # The same kind of worker as all else here: another kind would keep a second pool of them alive.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(cuts))
            texts, columns = batch.column(at), [batch.column(k) for k in range(len(names))]
            if own.null_count < len(own):
                new = texts.to_pylist()
                for k in np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    if new[k] is not None:
                        raw, done, kept = new[k].encode(), 0, []
                        for span in own[k].as_py():
                            kept.append(raw[done : span["start"]])
                            done = span["start"] + span["length"]
                        new[k] = b"".join([*kept, raw[done:]]).decode()
                columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.drop(doc, key).select(*docs.columns, cuts).mapInArrow(cut, docs.schema)
