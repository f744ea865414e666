"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, weighted verification.

A benchmark item is a multiset of word shingles, each weighted by how few items have it. Windows
of as many words as an item are taken around every place where a document has one of the items'
shingles (a window without any can't be similar). A window's 64-bit SimHash is looked up in a
multi-index: four blocks of 16 bits, each listing the items whose block is within 4 bits of a
value; by the pigeonhole principle that finds every item within RADIUS = 19 bits. Candidates are
then verified by exact similarity: the weight of the item's shingles that the window has, over
the item's weight.

Weights are counted over the whole benchmark. It is sent to all tasks in groups of at most
ITEMS_AT_ONCE items; a larger benchmark takes more passes over the documents, with the same result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Words, fresh, mixed, record, row_shingles, session_of, slices, small_or_plain, stored

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 19
ITEMS_AT_ONCE = 2000
_REACH = RADIUS // 4
#: Places of a text whose votes are summed at once.
_STRETCH = 8192

_SCHEMA = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"
_KEYED = f"{_SCHEMA}, text_key long"


def simhash(hashes: np.ndarray, weights: np.ndarray) -> int:
    """64 weighted votes: bit k is set if the shingles with bit k outweigh those without."""
    signs = np.unpackbits(mixed(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
    return int(np.packbits(weights @ signs > 0).view(">u8")[0])


class Items:
    """The index of a group of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], width: int, total: int | None = None, counts: dict[int, int] | None = None):
        """``counts`` has how many of the benchmark's ``total`` items have each shingle, if there
        are more items than these rows."""
        self.ids, self.width = [i for i, _ in rows], width
        words = Words(pa.array([t for _, t in rows], pa.string()))
        self.lengths = np.diff(words.first)
        self.sets = [np.unique(x) for x in row_shingles(words, width)]
        having: dict[int, list[int]] = defaultdict(list)
        for k, own in enumerate(self.sets):
            for h in own.tolist():
                having[h].append(k)
        self.weight = {h: 1.0 + float(np.log((total or len(rows)) / (counts[h] if counts else len(own)))) for h, own in having.items()}
        self.having = dict(having)
        self.known = np.array(sorted(having), np.uint64)
        self.known_weight = np.array([self.weight[h] for h in self.known.tolist()], np.float64)
        self.total = np.array([sum(self.weight[h] for h in own.tolist()) for own in self.sets])
        self.marks = np.array([simhash(own, np.array([self.weight[h] for h in own.tolist()])) if len(own) else 0 for own in self.sets], np.uint64)
        self.index = [self._block(b) for b in range(4)]

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For each 16-bit value, the items whose block is within reach: (offsets, items)."""
        own = (self.marks >> np.uint64(16 * b)).astype(np.uint16)
        values = np.arange(1 << 16, dtype=np.uint16)
        where, items = [], []
        for k, mark in enumerate(own):
            near = np.flatnonzero(np.bitwise_count(values ^ mark) <= _REACH)
            where.append(near)
            items.append(np.full(len(near), k, np.int32))
        at = np.concatenate(where) if where else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        offsets = np.zeros((1 << 16) + 1, np.int64)
        np.cumsum(np.bincount(at, minlength=1 << 16), out=offsets[1:])
        return offsets, (np.concatenate(items) if items else np.zeros(0, np.int32))[order]

    def near(self, mark: int) -> list[int]:
        """All items within RADIUS bits."""
        found: set[int] = set()
        for b, (offsets, items) in enumerate(self.index):
            value = mark >> (16 * b) & 0xFFFF
            found.update(items[offsets[value] : offsets[value + 1]].tolist())
        return [k for k in found if (int(self.marks[k]) ^ mark).bit_count() <= RADIUS]

    def search(self, found: np.ndarray, n_words: int, threshold: float) -> dict[int, tuple[float, int, int]]:
        """For a document's shingles in order: item -> (similarity, distance, first word)."""
        if not len(self.known) or not len(found):
            return {}
        at = np.searchsorted(self.known, found)
        at[at == len(self.known)] = 0
        hit = self.known[at] == found
        if not hit.any():
            return {}
        places: dict[int, list[int]] = defaultdict(list)  # window length -> shingles around which to look
        for p in np.flatnonzero(hit).tolist():
            for size in {int(self.lengths[k]) for k in self.having[int(found[p])]}:
                places[size].append(p)
        # Shingles that no item has vote with the least weight.
        weights = np.where(hit, self.known_weight[at], 1.0)
        best: dict[int, tuple[float, int, int]] = {}
        for size in sorted(places):
            many = max(size - self.width + 1, 1)
            edge = np.zeros(len(found) + 1, np.int32)  # windows begin from one place to another
            around = np.array(places[size])
            np.add.at(edge, np.maximum(around - max(size - self.width, 0), 0), 1)
            np.add.at(edge, around + 1, -1)
            first = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            first = first[(first + many <= len(found)) | (first == 0)]
            while len(first):
                part, first = first[first < first[0] + _STRETCH], first[first >= first[0] + _STRETCH]
                self._windows(found, hit, weights, part, many, threshold, best)
        return best

    def _windows(self, found: np.ndarray, hit: np.ndarray, weights: np.ndarray, first: np.ndarray, many: int, threshold: float, best: dict[int, tuple[float, int, int]]) -> None:
        """Looks up the windows of ``many`` shingles that begin at these places, and keeps each item's best."""
        base, last = int(first[0]), np.minimum(first + many, len(found))
        own = slice(base, int(last[-1]))
        signs = np.unpackbits(mixed(found[own]).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
        votes = np.zeros((len(signs) + 1, 64))
        np.cumsum(signs * weights[own][:, None], axis=0, out=votes[1:])
        marks = np.packbits(votes[last - base] - votes[first - base] > 0, axis=1).view(">u8").ravel().tolist()
        for a, b, mark in zip(first.tolist(), last.tolist(), marks, strict=True):
            has = None
            for k in self.near(mark):
                if has is None:
                    has = set(found[a:b][hit[a:b]].tolist())
                shared = sum(self.weight[h] for h in self.sets[k].tolist() if h in has)
                similarity = shared / self.total[k] if self.total[k] else 0.0
                if similarity >= threshold:
                    distance = (int(self.marks[k]) ^ mark).bit_count()
                    if k not in best or (-similarity, distance, a) < (-best[k][0], best[k][1], best[k][2]):
                        best[k] = similarity, distance, a


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that hold a benchmark item: (doc_id, item_id, similarity, distance, first_word, n_words).

    One row per document and item, for the item's best window: its exact weighted similarity
    (threshold or more), its SimHash's distance and its first word's place. Words are lowered in
    A-Z; items with fewer than ``width`` words are one shingle, found in texts of just that
    sequence. Items without words, with a null id, and documents with a null id or no words make
    no rows; items that repeat an id count once for each text; documents that repeat an id make
    one row each; empty tables make none; other columns are ignored. A text of any length is
    searched whole: about 60 bytes a word of it, and more only around shingles of items.
    """
    return _found(docs, benchmark, id_col, text_col, item_col, item_text_col, width, threshold).drop("text_key")


def _key(text_col: str) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """What contaminated() gives, with a hash of the document's text."""
    session_of(docs)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i IS NOT NULL AND trim(t) <> ''").distinct().orderBy("i", "t")

    rows = stored(rows, "benchmark-items").orderBy("i", "t")

    def passes() -> Iterator[list[tuple[int, str]]]:
        held: list[tuple[int, str]] = []
        for row in rows.toLocalIterator():  # the benchmark, in groups of fixed size
            held.append((row["i"], row["t"]))
            if len(held) == ITEMS_AT_ONCE:
                yield held
                held = []
        if held:
            yield held

    total = rows.count()
    counts = _counted(rows, width) if total > ITEMS_AT_ONCE else None
    out = None
    for group in passes():
        found = _pass(chosen, Items(group, width, total, _counts_of(counts, group, width)), threshold)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else chosen.sparkSession.createDataFrame([], _KEYED)


def _counted(items: DataFrame, width: int) -> DataFrame:
    """(h, n): how many items have each shingle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [np.unique(x) for x in row_shingles(Words(batch.column("t")), width)]
                yield record(["h"], [np.concatenate(sets).view(np.int64)])

    return stored(items.select("t").mapInArrow(each, "h long").groupBy("h").agg(F.count("*").alias("n")), "shingle-items")


def _counts_of(counts: DataFrame | None, group: list[tuple[int, str]], width: int) -> dict[int, int] | None:
    """The counts of the shingles of a group, at most ITEMS_AT_ONCE items' worth."""
    if counts is None:
        return None
    words = Words(pa.array([t for _, t in group], pa.string()))
    own = np.unique(np.concatenate(list(row_shingles(words, width)))).view(np.int64)
    wanted = counts.sparkSession.createDataFrame([(x,) for x in own.tolist()], "h long")
    return {r["h"] % (1 << 64): r["n"] for r in counts.join(F.broadcast(wanted), "h").collect()}


def _pass(chosen: DataFrame, items: Items, threshold: float) -> DataFrame:
    sent = chosen.sparkSession.sparkContext.broadcast(items)
    width = items.width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                words = Words(part.column("text"))
                sizes = np.diff(words.first).tolist()
                for doc, key, n, found in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), sizes, row_shingles(words, width), strict=True):
                    for k, (similarity, distance, first) in index.search(found, n, threshold).items():
                        out.append((doc, index.ids[k], similarity, distance, first, int(index.lengths[k]), key))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield record([x.split()[0] for x in _KEYED.split(", ")], [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)])

    return chosen.mapInArrow(scan, _KEYED)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text holds no benchmark item. Rows with a null id stay; rows
    that share an id are told apart by their texts."""
    doc = fresh(docs, "found_id")
    key = fresh(docs, "found_key")
    found = stored(_found(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "contaminated")
    return docs.join(small_or_plain(found), (F.col(id_col).cast("long") == F.col(doc)) & (_key(text_col) == F.col(key)), "left_anti")
