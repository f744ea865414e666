"""Token-id output: one wavelet matrix per shard, readable without unpacking the ids.

A shard is one byte string: a header, the compressed table of the documents' ids and token counts,
a directory, and one bit-plane per bit of the largest id, most significant first. In each plane the
ids of the level above are stably parted by that bit, zeros first. Planes are compressed in blocks
of BLOCK_BITS bits; the directory has each block's place and the ones before it, so access, count,
rank and select each unpack one or two blocks a plane, whatever the shard's size.

Shards are rows of a Parquet table, written by Spark's committer into the shared folder: a lost
task leaves nothing behind, and no machine needs another's disk. ``Shard`` also reads the bytes
of a shard saved as a file of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import record, session_of, slices, written
from notelake.llm.tokens import crc, encoder

MAGIC = b"NLWM0002"
#: The magic, ids, documents, bits of an id, bytes of the documents' table.
_HEAD = struct.Struct("<8sQQIQ")
BLOCK_BITS = 1 << 16
#: Blocks that a reader keeps unpacked.
_KEPT = 256

#: Tokens at which a shard is closed; a document is never split, so one long document makes a longer shard.
SHARD_TOKENS = 1 << 20

SHARD_SCHEMA = "part int, shard int, first_token long, n_docs long, n_tokens long, payload binary"


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, level: int = 1) -> bytes:
    """The bytes of a shard of documents with ``counts[i]`` ids each, all ids on end."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    out = zstandard.ZstdCompressor(level=level)
    valid = np.array([x is not None for x in doc_ids], bool)
    docs = out.compress(np.packbits(valid).tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.asarray(counts, "<i8").tobytes())
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    step = BLOCK_BITS // 8
    blobs: list[bytes] = []
    ranks = []
    for b in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << b)) != 0
        plane = np.packbits(one, bitorder="little")
        blobs += [out.compress(plane[at : at + step]) for at in range(0, len(plane), step)]
        full = np.zeros(-(-len(plane) // step) * step, np.uint8)
        full[: len(plane)] = plane
        ones = np.bitwise_count(full.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        if b:
            now = np.concatenate([now[~one], now[one]])
    directory = np.array([len(x) for x in blobs], "<u4").tobytes() + np.concatenate(ranks).astype("<i8").tobytes()
    return _HEAD.pack(MAGIC, n, len(doc_ids), bits, len(docs)) + docs + directory + b"".join(blobs)


class Shard:
    """A shard read from its bytes. Blocks are unpacked when first needed."""

    def __init__(self, payload: bytes):
        magic, self.n, self.n_docs, self.bits, size = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self._payload, self._docs = payload, (_HEAD.size, _HEAD.size + size)
        self.blocks = -(-self.n // BLOCK_BITS)
        at = _HEAD.size + size
        sizes = np.frombuffer(payload, "<u4", self.bits * self.blocks, at).astype(np.int64)
        at += 4 * len(sizes)
        self._ranks = np.frombuffer(payload, "<i8", self.bits * (self.blocks + 1), at).reshape(self.bits, -1)
        self._starts = at + 8 * self._ranks.size + np.concatenate([[0], np.cumsum(sizes)])
        self._kept: dict[int, np.ndarray] = {}
        self._unpack = zstandard.ZstdDecompressor()

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """(document ids, tokens of each), in order."""
        table = self._unpack.decompress(self._payload[slice(*self._docs)])
        mask = (self.n_docs + 7) // 8
        valid = np.unpackbits(np.frombuffer(table, np.uint8, mask))[: self.n_docs]
        ids = np.frombuffer(table, "<i8", self.n_docs, mask).tolist()
        counts = np.frombuffer(table, "<i8", self.n_docs, mask + 8 * self.n_docs)
        return [x if v else None for x, v in zip(ids, valid, strict=True)], counts

    def _read(self, j: int) -> bytes:
        return self._unpack.decompress(self._payload[self._starts[j] : self._starts[j + 1]])

    def _block(self, k: int, j: int) -> np.ndarray:
        """The packed bits of block j of plane k, 0 the most significant."""
        at = k * self.blocks + j
        if at not in self._kept:
            if len(self._kept) >= _KEPT:
                del self._kept[next(iter(self._kept))]
            self._kept[at] = np.frombuffer(self._read(at), np.uint8)
        return self._kept[at]

    def _bit(self, k: int, i: int) -> int:
        return int(self._block(k, i // BLOCK_BITS)[i % BLOCK_BITS >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        j, rest = divmod(i, BLOCK_BITS)
        count = int(self._ranks[k, j])
        if rest:
            block = self._block(k, j)
            count += int(np.bitwise_count(block[: rest >> 3]).sum())
            if rest & 7:
                count += (int(block[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count()
        return count

    def _zeros(self, k: int) -> int:
        return self.n - int(self._ranks[k, -1])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self._zeros(k) + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """In the lowest order, where the token's occurrences before place i lie."""
        a, b = 0, i
        for k in range(self.bits):
            ones_a, ones_b = self._ones(k, a), self._ones(k, b)
            if token >> (self.bits - 1 - k) & 1:
                a, b = self._zeros(k) + ones_a, self._zeros(k) + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """The place of the (j + 1)-th such bit of plane k."""
        before = self._ranks[k] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self._ranks[k]
        at = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self._block(k, at), count=min(BLOCK_BITS, self.n - at * BLOCK_BITS), bitorder="little")
        return at * BLOCK_BITS + int(np.flatnonzero(bits == bit)[j - int(before[at])])

    def select(self, token: int, j: int) -> int:
        """The place of the token's (j + 1)-th occurrence; -1 if there are fewer."""
        if token < 0 or token >> self.bits or j < 0:
            return -1
        a, b = self._range(token, self.n)
        if a + j >= b:
            return -1
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select_bit(k, bit, i - self._zeros(k) if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            plane = b"".join([self._read(k * self.blocks + j) for j in range(self.blocks)])
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").astype(bool)
            zeros = self.n - int(np.count_nonzero(one))
            above = np.empty(self.n, kind)
            above[~one] = values[:zeros]
            above[one] = values[zeros:] | kind(1 << (self.bits - 1 - k))
            values = above
        return values


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = SHARD_TOKENS, folds: bool = False) -> DataFrame:
    """Encodes all texts, writes shards in ascending order of id to ``path``, returns that table.

    Rows are range-partitioned by id, those that share one (or have none) by a hash of the text as
    well; (part, shard) orders the shards, and ``first_token`` counts
    the ids before a shard in its part. Null texts count as empty, a null id comes first; rows that
    repeat an id are kept, in the order of that hash and of their texts; no rows give an empty table;
    other columns are ignored. A document lies whole in one shard, so a text of any length is
    encoded in one worker (about 40 bytes a byte of it). ``folds``: see tokens.ColumnEncoder.
    """
    spark = session_of(docs, 16)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = chosen.withColumn("key", F.xxhash64("text"))
    ordered = chosen.repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard, first = encoder(tokenizer_path, folds), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, first
            own = np.concatenate(ids)
            payload = encode_shard(own, names, np.concatenate(counts))
            out = record([x.split()[0] for x in SHARD_SCHEMA.split(", ")], [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), [first], [len(names)], [len(own)], pa.array([payload], pa.binary())])
            shard, first = shard + 1, first + len(own)
            ids.clear(), counts.clear(), names.clear()
            return out

        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                tokens, offsets = enc.encode(piece.column("text"), end_id)
                names += piece.column("doc_id").to_pylist()
                ids.append(tokens.astype(np.uint16) if tokens.max() < 65536 else tokens)
                counts.append(np.diff(offsets))
                if sum(map(len, ids)) >= shard_tokens:
                    yield close()
        if names:
            yield close()

    return written(ordered.mapInArrow(encode, SHARD_SCHEMA), path, "none")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone.

    ``start`` counts the ids of all documents before it. The running sum goes over the parts'
    totals, one row for each task that wrote, and not over documents.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(payload.as_py())
                names, counts = shard.documents()
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                sums = [crc(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield record(["doc_id", "part", "at", "n_tokens", "ids_crc32"], [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), starts + first, counts, pa.array(sums, pa.int64())])

    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    found = shards.select("part", "first_token", "payload").mapInArrow(read, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
