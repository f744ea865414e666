"""The best rows of many queries, scored where the rows are.

The parts that phrases add to rows' scores are packed, dealt to blocks by row and shuffled once. The
batch of queries is dealt to chunks; a task reads the blocks of a span one after another with one
chunk, sums, and keeps the few best rows of each query over all of them; only these are merged. Blocks
meet chunks by a replicated nested loop, which reads both where they lie: neither the batch nor what
is kept of it is written once a block, so what is shuffled grows with the postings read and with the
queries, not with their product. Queries that ask the same are scored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.lineage import cut

#: Rows of the index that share a block, and different queries that share a chunk, about; for how many
#: tasks the blocks are dealt to spans where there are few chunks.
BLOCK_ROWS, CHUNK_ASKS, TASKS = 8_000, 16_384, 64

#: Parts that are packed at once; kept rows from which a task drops those that are no longer best.
_PACKED, _KEPT = 1_000_000, 500_000


def best(phrases: DataFrame, parts: DataFrame, limit: int, rows: float, some: bool = False) -> DataFrame:
    """(query_id, run, row_id, score, rank, groups): the ``limit`` best rows of each query and run.

    ``phrases`` has (query_id, run, group_id, key), ``parts`` (key, row_id, part). A row matches
    that has a phrase of each group, or with ``some`` of any; ``groups`` are those it has a phrase
    of. Smaller scores are better; they are compared to nine places, ties by row.
    """
    own = phrases.groupBy("query_id", "run").agg(F.array_sort(F.collect_list(F.struct("group_id", "key"))).alias("own"))
    asks = cut(own.groupBy("own").agg(F.collect_list(F.struct("query_id", "run")).alias("who")).withColumn("ask", F.monotonically_increasing_id()))
    blocks = max(1, int(-(-rows // BLOCK_ROWS)))
    chunks = max(1, -(-asks.count() // CHUNK_ASKS))
    chunk = F.pmod(F.xxhash64("ask"), F.lit(chunks)).cast("int")
    asked = asks.select(chunk.alias("chunk"), F.struct("ask", F.col("own.group_id").alias("groups"), F.col("own.key").alias("keys")).alias("asked"))
    whole = asked.groupBy("chunk").agg(F.collect_list("asked").alias("asks")).repartitionById(chunks, F.col("chunk"))
    # A block's pieces meet the chunk's number alone; the row that leads them meets its queries.
    sent = whole.select("chunk", F.explode(F.array(F.col("asks"), F.lit(None))).alias("asks"))
    block = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    pieces = parts.select(block.alias("block"), "key", "row_id", "part").mapInArrow(_packer, "block int, piece binary")
    leads = phrases.sparkSession.range(0, blocks, 1, 1).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("binary").alias("piece"))
    dealt = pieces.unionByName(leads).repartitionById(blocks, F.col("block")).coalesce(min(blocks, -(-TASKS // chunks)))
    pairs = (F.isnull("piece") & F.isnotnull("asks")) | (F.isnotnull("piece") & F.isnull("asks"))
    met = dealt.hint("shuffle_replicate_nl").join(sent, pairs)
    id_type = parts.schema["row_id"].dataType.simpleString()
    found = met.mapInArrow(_scorer(limit, some), f"ask long, row_id {id_type}, score double, near double, groups array<int>")
    order = Window.partitionBy("ask").orderBy("near", "row_id")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    named = kept.join(asks.select("ask", F.explode("who").alias("who")), "ask")
    return named.select("who.query_id", "who.run", "row_id", "score", "rank", "groups")


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, piece): the parts (block, key, row_id, part), about _PACKED at once, packed into one
    value for each block among them."""
    held: list[pa.RecordBatch] = []
    many = 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= _PACKED:
            yield _pack(held)
            held, many = [], 0
    if many:
        yield _pack(held)


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = pa.Table.from_batches(batches)
    block = _one(parts.column("block")).to_numpy()
    order = np.argsort(block, kind="stable")
    taken = parts.select(["key", "row_id", "part"]).take(pa.array(order)).combine_chunks()
    heads = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
    pieces = []
    for start, end in zip(heads, np.append(heads[1:], len(order)), strict=True):
        piece = taken.slice(start, end - start)
        piece = piece.set_column(0, "key", _one(piece.column("key")).dictionary_encode())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(piece)
        pieces.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(block[order][heads], pa.int32()), pa.array(pieces, pa.binary())], ["block", "piece"])


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _scorer(limit: int, some: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, _Chunk] = {}
        for batch in batches:
            for block, piece, chunk, asks in zip(batch.column("block").to_pylist(), batch.column("piece"), batch.column("chunk").to_pylist(), batch.column("asks"), strict=True):
                chunks.setdefault(chunk, _Chunk(limit, some)).add(block, piece, asks)
        for each in chunks.values():
            yield from each.end()

    return score


class _Chunk:
    """What a task holds of a chunk of queries: the pieces of the block that it reads, and the best
    rows so far. A block's rows follow each other."""

    def __init__(self, limit: int, some: bool) -> None:
        self.limit, self.some = limit, some
        self.block, self.pieces, self.asks = None, [], None
        self.kept: list[pa.Table] = []
        self.many = self.fewest = 0

    def add(self, block: int, piece: pa.Scalar, asks: pa.Scalar) -> None:
        if block != self.block:
            self._close()
            self.block = block
        if piece.is_valid:
            self.pieces.append(piece.as_buffer())
        else:
            self.asks = asks.values

    def end(self) -> list[pa.RecordBatch]:
        self._close()
        self._prune()
        return [batch for table in self.kept for batch in table.to_batches()]

    def _close(self) -> None:
        if self.pieces:
            parts = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in self.pieces]).unify_dictionaries()
            found = _answers(self.asks, parts, self.limit, self.some)
            if found.num_rows:
                self.kept.append(found)
                self.many += found.num_rows
            if self.many > max(_KEPT, 2 * self.fewest):
                self._prune()
        self.pieces, self.asks = [], None

    def _prune(self) -> None:
        if len(self.kept) > 1:
            table = pa.concat_tables(self.kept).combine_chunks()
            order = pc.sort_indices(table, [("ask", "ascending"), ("near", "ascending"), ("row_id", "ascending")]).to_numpy()
            ask = _one(table.column("ask")).to_numpy()[order]
            heads = np.flatnonzero(np.append(True, ask[1:] != ask[:-1]))
            place = np.arange(len(ask)) - np.repeat(heads, np.diff(np.append(heads, len(ask))))
            self.kept = [table.take(pa.array(order[place < self.limit]))]
        self.many = self.fewest = sum(table.num_rows for table in self.kept)


def _answers(asks: pa.StructArray, parts: pa.Table, limit: int, some: bool) -> pa.Table:
    """The best rows in a block of each query of a chunk."""
    coded = _one(parts.column("row_id")).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    names = coded.dictionary.take(order)
    block = Block(place[coded.indices.to_numpy()], _one(parts.column("key")), _one(parts.column("part")).to_numpy(), len(names))
    out = list(block.answers(asks.field("keys"), asks.field("groups"), limit, some))
    if not out:
        return _table([], names.slice(0, 0), [], [], [])
    ask = asks.field("ask").to_numpy()
    rows = np.concatenate([r for _, r, _, _ in out])
    return _table(np.repeat(ask[[a for a, _, _, _ in out]], [len(r) for _, r, _, _ in out]), names.take(pa.array(rows)), np.concatenate([s for _, _, s, _ in out]), rows, [g for *_, groups in out for g in groups])


def _table(asks, names: pa.Array, scores, rows, groups: list) -> pa.Table:
    scores = np.asarray(scores, np.float64)
    return pa.table({"ask": pa.array(asks, pa.int64()), "row_id": names, "score": pa.array(scores), "near": pa.array(np.round(scores, 9)), "groups": pa.array(groups, pa.list_(pa.int32()))})


class Block:
    """Some rows' parts of scores, by phrase: ``rows`` numbers them in the order of their ids."""

    def __init__(self, rows: np.ndarray, keys: pa.Array, parts: np.ndarray, n: int) -> None:
        coded = keys if pa.types.is_dictionary(keys.type) else keys.dictionary_encode()
        of = coded.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        self.keys, self.rows, self.parts, self.n = coded.dictionary, rows[order], parts[order], n
        self.start = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))

    def answers(self, keys: pa.Array, groups: pa.Array, limit: int, some: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(number, rows, scores, each row's groups) of every query that rows here match."""
        at = pc.fill_null(pc.index_in(keys.flatten(), value_set=self.keys), -1).to_numpy()
        group = groups.flatten().to_numpy()
        ends = np.cumsum(pc.list_value_length(keys).to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        own = np.repeat(np.arange(len(ends)), ends - starts)
        found = np.where(at >= 0, self.start[at + 1] - self.start[at], 0)
        first = np.ones(len(at), bool)
        first[1:] = (own[1:] != own[:-1]) | (group[1:] != group[:-1])
        heads = np.flatnonzero(first)
        has = np.add.reduceat(found, heads) if len(heads) else found
        alive = np.zeros(len(ends), bool) if some else np.ones(len(ends), bool)
        alive[own[heads][has > 0] if some else own[heads][has == 0]] = some
        seen, sums = np.zeros(self.n, bool), np.zeros(self.n)
        for q in np.flatnonzero(alive & (ends > starts)):
            here = slice(*np.searchsorted(heads, [starts[q], ends[q]]))
            bounds = np.append(heads[here], ends[q])
            spans = [[slice(self.start[k], self.start[k + 1]) for k in at[a:b] if k >= 0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if some or len(spans) == 1:
                every = [s for g in spans for s in g]
                rows = np.concatenate([self.rows[s] for s in every])
                total = np.bincount(rows, np.concatenate([self.parts[s] for s in every]), self.n)
                seen[rows] = True
                rows = np.flatnonzero(seen)
                seen[rows] = False
                scores = -total[rows]
            else:
                rows = None
                for g in np.argsort(has[here], kind="stable"):  # the group that fewest rows have comes first
                    for s in spans[g]:
                        seen[self.rows[s]] = True
                    rows = np.flatnonzero(seen) if rows is None else rows[seen[rows]]
                    for s in spans[g]:
                        seen[self.rows[s]] = False
                    if not len(rows):
                        break
                if not len(rows):
                    continue
                every = [s for g in spans for s in g]
                for s in every:
                    sums[self.rows[s]] += self.parts[s]  # a phrase has a row once
                scores = -sums[rows]
                for s in every:
                    sums[self.rows[s]] = 0.0
            if len(rows) > limit:
                chosen = _smallest(np.round(scores, 9), limit)
                rows, scores = rows[chosen], scores[chosen]
            names = group[heads[here]]
            if some:
                table = np.zeros((len(rows), len(names)), bool)
                for g, own_spans in enumerate(spans):
                    for s in own_spans:
                        seen[self.rows[s]] = True
                    table[:, g] = seen[rows]
                    for s in own_spans:
                        seen[self.rows[s]] = False
                yield q, rows, scores, [names[t] for t in table]
            else:
                yield q, rows, scores, [names] * len(rows)


def _smallest(values: np.ndarray, limit: int) -> np.ndarray:
    """The places of the smallest values; of equal ones the first."""
    bound = np.partition(values, limit - 1)[limit - 1]
    under = np.flatnonzero(values < bound)
    return np.concatenate([under, np.flatnonzero(values == bound)[: limit - len(under)]])
