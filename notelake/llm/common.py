"""What the operators share: Arrow text kernels, tables in the shared folder, bounded hash tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library keeps freed memory as it likes
    _libc = None

#: Rows of a table that may be broadcast: at 8 to 64 bytes each, 64 MB at most.
BROADCAST_ROWS = 1_000_000

#: Bytes that split words: space and the five from tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b".,;:!?")] = True


# --- session and shared folder -------------------------------------------------------


def session_of(df: DataFrame, batch_mb: int = 2) -> SparkSession:
    """The frame's session, with Arrow batches held to a size that fits a Python worker."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_mb << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set, in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="notelake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as what is written inside is done; else they stay until the driver
    happens to collect its garbage. The session's own setting comes back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """The frame written as Parquet to a path and read back."""
    with tidy(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: lineage ends here."""
    return written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables of one computation in the shared folder, deleted when they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """As stored(), but gone after drop()."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return written(df, path)

    def drop(self) -> None:
        """Deletes the tables; frames that read them can't be used after this."""
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the frame is counted to have few rows; else the frame as it is, which
    joins by shuffle. For narrow frames only."""
    return F.broadcast(df) if df.count() <= rows else df


# --- Arrow text kernels --------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size.astype(np.int64))
    at = 0
    while at < n:
        base = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Gives freed memory back to the machine: idle workers share an executor's memory with busy ones."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sign_starts(data: np.ndarray) -> np.ndarray:
    """Whether each byte is one of .,;:!? right after a letter from a to z in any case."""
    out = _SIGN[data]
    out[1:] &= _LETTER[data[:-1]]
    out[:1] = False
    return out


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings over one buffer without copying it."""
    offsets = np.ascontiguousarray(offsets, dtype=np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """The words of a column: maximal runs of bytes other than space and tab to carriage return.

    ``codes[k]`` is the place of word k in ``distinct``; the words of row i are
    ``codes[first[i]:first[i + 1]]``. A-Z are lowered if ``lower``; with ``signs`` a word also ends
    before a sign that follows a letter.
    """

    def __init__(self, column: pa.Array, lower: bool = True, signs: bool = False):
        data, offsets = text_bytes(column)
        if lower:
            data = _LOWER[data]
        n = len(data)
        space = _SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)  # a row begins or ends here
        edge[offsets] = True
        begins = ~space
        begins[1:] &= space[:-1] | edge[1:n]
        ends = ~space
        if signs:
            after = sign_starts(data)
            begins |= after
            edge[:n] |= after
        ends[:-1] &= space[1:] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)
        places = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.cumsum(self.stops - self.starts, out=places[1:])
        encoded = strings(data[~space], places).dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.distinct = encoded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.to_pylist()), np.uint64, len(self.distinct))
        return own[self.codes]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes, one for each place where a run begins."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out


def whole_shingle(hashes: np.ndarray) -> int:
    """The hash of a text with too few words for a shingle: its whole sequence as one."""
    return xxhash.xxh3_64_intdigest(b"short" + hashes.tobytes())


def row_shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each row in order of place; empty without words."""
    hashes = words.hashes()
    every = shingles(hashes, width)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            yield every[a : b - width + 1]
        elif b > a:
            yield np.array([whole_shingle(hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


# --- bounded hash tables ----------------------------------------------------------------

_BLOCKS = 32


def hash_counts(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], bits: int) -> np.ndarray:
    """A table of 2**bits counts over all rows, of that size whatever the input.

    ``fill(table, batch)`` adds a batch's counts to a task's table. The tasks' tables are cut into
    blocks, summed by block on the executors, and only the sum (8 * 2**bits bytes) is collected.
    """
    size = (1 << bits) // _BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if batch.num_rows:
                table = np.zeros(1 << bits, np.uint32) if table is None else table
                fill(table, batch)
        if table is not None:
            parts = [table[k * size : (k + 1) * size].tobytes() for k in range(_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a few blocks reach a task; one array for each is all it holds.
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(counts, np.uint32).astype(np.uint64)
                if block in total:
                    total[block] += part
                else:
                    total[block] = part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    summed = df.mapInArrow(count, "block int, counts binary").repartition(_BLOCKS, "block").mapInArrow(add, "block int, counts binary")
    table = np.zeros(1 << bits, np.uint64)
    for row in summed.collect():  # at most one row for each block
        table[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["counts"], np.uint64)
    return table


def hash_bits(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2**bits booleans in packed bytes: which values of a long column's top bits occur.

    Of a fixed size; with many values it lets more through, so users check exactly afterwards.
    """
    size = (1 << bits) // 8 // _BLOCKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if batch.num_rows:
                table = np.zeros((1 << bits) // 8, np.uint8) if table is None else table
                at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits))
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        if table is not None:
            parts = [table[k * size : (k + 1) * size].tobytes() for k in range(_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "marks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(marks, np.uint8)
                total[block] = total[block] | part if block in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "marks"])

    summed = df.select(column).mapInArrow(mark, "block int, marks binary").repartition(_BLOCKS, "block").mapInArrow(merge, "block int, marks binary")
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in summed.collect():
        table[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["marks"], np.uint8)
    return table


def marked(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each uint64 value is marked in a table of hash_bits()."""
    bits = int(len(table) * 8).bit_length() - 1
    at = values >> np.uint64(64 - bits)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def record(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names)


# --- connected components --------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60, owner: Scratch | None = None) -> DataFrame:
    """(node, root): root is the smallest node connected to node, over edges (a, b) of longs.

    Alternating large and small stars: edges move to ever smaller centres until every node hangs
    on its component's smallest. Nodes and edges stay on the executors; each round is written to
    the shared folder, and what the round before wrote is deleted (the result's table with ``owner``). Nodes without edges are absent.
    Rounds grow with the logarithm of a component's longest path: 60 do for any that has an id.
    """
    scratch, last = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    now = scratch.stored(edges.where("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        centre = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(centre, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        now = last.stored(small, "edges")
        scratch.drop()
        scratch, last = last, scratch
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if owner is not None:
        owner.paths += scratch.paths
    roots = now.selectExpr("u AS node", "v AS root")
    return roots.unionByName(now.selectExpr("v AS node", "v AS root").distinct())
