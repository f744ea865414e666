"""The full-text index as plain tables, and its incremental upkeep.

An index has postings, one row for each term and row that holds it, with the weighted number of its
occurrences, their places and the row's length; a vocabulary, one row for each term, with the number
of rows that hold it; a manifest, one row for each indexed row, with a digest of all its indexed
columns; and a list of dead rows. On disk postings and vocabulary lie in folders by a hash of the
term and are sorted by it, so that a batch of queries opens the folders of its own terms alone.
There the postings of a term that a task made together are packed into one row, their numbers as
one value, so that far fewer rows and values are shuffled, sorted and written; what is read of them
is unpacked once its terms are chosen.

An update writes what changed as a new run and marks the versions before as dead. Compaction merges
all runs into one without the dead rows. A one-row state is written last: until it is there, readers
see the state before. One writer at a time is assumed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import index_terms
from notelake.operators.lineage import SENT_ROWS, cut, remove

#: How much a match in each column weighs, for notes and for passages.
NOTE_WEIGHTS = {"path": 0.1, "type": 1.5, "title": 8.0, "description": 4.0, "tags": 6.0, "aliases": 6.0, "systems": 5.0, "signals": 5.0, "body": 0.2, "content": 3.0}
PASSAGE_WEIGHTS = {"type": 1.5, "title": 8.0, "tags": 6.0, "systems": 5.0, "heading": 4.0, "text": 1.0, "content": 3.0}

#: Folders of a run at least; bytes of text that a folder is made for; bytes of text whose postings
#: one task sorts and writes; rows whose postings of one term may share a file, so that a term that
#: all rows hold is spread over many.
BUCKETS, BUCKET_BYTES, TASK_BYTES, FILE_ROWS = 32, 512 << 20, 32 << 20, 4_000_000

#: Terms of a batch that are looked up by their values; those of larger batches are joined.
LOOKED_UP = 5_000

#: Runs, and the share of dead rows, from which repaired() compacts.
MOST_RUNS, MOST_DEAD = 8, 0.25

_STATE = "version int, runs array<struct<version: int, buckets: int>>, n long, total long, dead long, weights array<double>"

#: Rows whose terms are grouped at once, and about how many postings are packed and unpacked at once.
_GROUPED, _PACKED, _UNPACKED = 500, 400_000, 100_000

#: The folder of a run that has the rows' lengths, beside those of postings.
_LENGTHS = -1


@dataclass(frozen=True)
class Index:
    """``postings`` has (term, row_id, f, len, places), where f sums the weights of a term's
    occurrences, len is the row's number of terms, and places lists its places, the number of the
    field above 32 bits of the position there; ``weights`` are those of the fields by number;
    ``lengths`` has (row_id, len). A stored index also has ``vocabulary`` (term, df), its runs as
    (version, buckets), its size, its postings as they are packed, and dead rows (row_id, version) whose
    postings don't count."""

    postings: DataFrame
    lengths: DataFrame
    weights: tuple[float, ...]
    vocabulary: DataFrame | None = None
    runs: tuple[tuple[int, int], ...] = ()
    size: tuple[float, float] | None = None
    dead: DataFrame | None = None
    packed: DataFrame | None = None

    def of(self, terms: DataFrame | list[str], places: bool = True) -> DataFrame:
        """The postings (term, row_id, f, len, places) of a batch's terms (term); without ``places``
        these may be null."""
        if self.packed is None:
            return self._living(self._only(self.postings, terms))
        return self._living(_unpacked(self._only(self.packed, terms), places))

    def met(self, terms: DataFrame) -> DataFrame:
        """The postings of a batch's terms with the columns that ``terms`` (term, ...) has beside them;
        places may be null. The terms are sent to the postings, however many they are; see _dealt()."""
        out = []
        for own, table in self._dealt(self.postings if self.packed is None else self.packed, terms):
            kept = table.join(F.broadcast(own.select("term")), "term", "left_semi")
            out.append(self._living(kept if self.packed is None else _unpacked(kept, places=False)).join(F.broadcast(own), "term"))
        return reduce(DataFrame.unionByName, out)

    def _dealt(self, table: DataFrame, terms: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """Terms in shares of about SENT_ROWS at most, each with the table's rows to look in. Shares
        are made by folder, so that a folder is read for one of them alone, as long as all runs have
        as many folders."""
        shares = -(-terms.count() // SENT_ROWS)
        if shares <= 1:
            return [(terms, table)]
        shares += shares // 4 + 1  # folders don't hold quite as many terms each
        folders = {b for _, b in self.runs}
        hashed = F.crc32(F.col("term").cast("binary"))
        if len(folders) != 1 or shares > min(folders):
            return [(terms.where(hashed % shares == k), table) for k in range(shares)]
        bucket = hashed % min(folders)
        return [(terms.where(bucket % shares == k), table.where(F.col("bucket") % shares == k)) for k in range(shares)]

    def all(self) -> DataFrame:
        """All postings that count."""
        return self._living(self.postings)

    def terms(self) -> DataFrame:
        """(term) of the vocabulary; of a stored index it is read from its own small table."""
        return (self.postings if self.vocabulary is None else self.vocabulary).select("term").distinct()

    def frequencies(self, terms: DataFrame | list[str]) -> DataFrame:
        """(term, df) of a batch's terms: looked up where no row is dead, else counted."""
        if self.vocabulary is None or self.dead is not None:
            return self.of(terms).groupBy("term").agg(F.count("*").alias("df"))
        return self._only(self.vocabulary, terms).groupBy("term").agg(F.sum("df").alias("df"))

    def sized(self, df: DataFrame) -> DataFrame:
        """The frame with n, the number of indexed rows, and mean, their mean length."""
        if self.size is not None:
            return df.withColumns({"n": F.lit(self.size[0]), "mean": F.lit(self.size[1])})
        return df.crossJoin(F.broadcast(self.lengths.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("mean"))))  # one row

    def _living(self, postings: DataFrame) -> DataFrame:
        if self.dead is not None:
            postings = postings.join(self.dead, ["row_id", "version"], "left_anti")
        return postings.select("term", "row_id", "f", "len", "places")

    def _only(self, table: DataFrame, terms: DataFrame | list[str]) -> DataFrame:
        """A table's rows of these terms. Few terms are a filter on folders and values; more are joined."""
        if isinstance(terms, DataFrame):
            found = [r["term"] for r in terms.distinct().limit(LOOKED_UP + 1).collect()]
            if len(found) > LOOKED_UP:
                once = cut(terms.distinct())
                return reduce(DataFrame.unionByName, [part.join(F.broadcast(own), "term", "left_semi") for own, part in self._dealt(table, once)])
            terms = found
        kept = table.where(F.col("term").isin(terms))
        if not self.runs:
            return kept
        folders = [(F.col("version") == v) & F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % b for t in terms})) for v, b in self.runs]
        place = folders[0]
        for other in folders[1:]:
            place = place | other
        return kept.where(place)


def _fields(rows: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """(row_id, len, fields): the terms of every indexed column, and their number."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(w).alias("weight"), index_terms(F.col(c)).alias("terms")) for c, w in weights.items()])
    per_row = rows.select(F.col(key).alias("row_id"), fields.alias("fields"))
    return per_row.select("row_id", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["terms"])).alias("len"), "fields")


def occurrences(rows: DataFrame, weights: dict[str, float], key: str = "path") -> DataFrame:
    """(row_id, len, field, weight, pos, term): every term of every indexed column, one row each."""
    per_field = _fields(rows, weights, key).select("row_id", "len", F.explode("fields").alias("f"))
    return per_field.select("row_id", "len", F.col("f.field").alias("field"), F.col("f.weight").alias("weight"), F.posexplode("f.terms").alias("pos", "term"))


def row_lengths(rows: DataFrame, weights: dict[str, float], key: str = "path") -> DataFrame:
    """(row_id, len): terms over all indexed columns; rows without terms have 0."""
    return rows.select(F.col(key).alias("row_id"), _length(weights).alias("len"))


def _length(weights: dict[str, float]) -> Column:
    total = F.lit(0)
    for c in weights:
        total = total + F.size(index_terms(F.col(c)))
    return total


def _postings(rows: DataFrame, weights: dict[str, float], key: str, packed: bool = False) -> DataFrame:
    """(term, row_id, f, len, places) of rows that don't repeat a key. ``packed`` as _packer() does,
    with a row without a term for each of them as well, for its length. A row's occurrences of a term
    are grouped where the row is, so that postings alone are shuffled."""
    per_row = rows.select(F.col(key).alias("row_id"), F.array(*[index_terms(F.col(c)) for c in weights]).alias("terms"))
    id_type = per_row.schema["row_id"].dataType.simpleString()
    group = _grouper(np.array(list(weights.values())))
    if packed:
        return per_row.mapInArrow(lambda batches: _packer(group(batches)), _packed(id_type))
    return per_row.mapInArrow(group, f"term string, row_id {id_type}, f double, len int, places array<bigint>").where("term IS NOT NULL")


def _grouper(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["term", "row_id", "f", "len", "places"]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _GROUPED):
                part = batch.slice(start, _GROUPED)
                fields = part.column("terms").flatten()
                terms = fields.flatten().dictionary_encode()
                many = pc.list_value_length(fields).to_numpy().astype(np.int64)
                length = many.reshape(part.num_rows, len(weights)).sum(axis=1)
                none = lambda kind, n=part.num_rows: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([none(pa.string()), part.column("row_id"), none(pa.float64()), pa.array(length, pa.int32()), none(pa.list_(pa.int64()))], names)
                if not len(terms):
                    continue
                row = np.repeat(np.arange(part.num_rows), length)
                field = np.repeat(np.tile(np.arange(len(weights)), part.num_rows), many)
                pos = np.arange(len(terms)) - np.repeat(np.cumsum(many) - many, many)
                each = row * len(terms.dictionary) + terms.indices.to_numpy()
                order = np.argsort(each, kind="stable")
                each = each[order]
                heads = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
                at = row[order][heads]
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(each)), pa.int32()), pa.array((field << 32 | pos)[order]))
                columns = [terms.dictionary.take(pa.array(each[heads] % len(terms.dictionary))), part.column("row_id").take(pa.array(at)), pa.array(np.add.reduceat(weights[field[order]], heads)), pa.array(length[at], pa.int32()), places]
                yield pa.RecordBatch.from_arrays(columns, names)

    return group


def _packed(id_type: str) -> str:
    return f"term string, n long, ids array<{id_type}>, numbers binary"


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_packed() of postings (term, row_id, f, len, places), about _PACKED at once: a row for each term
    among them, with its postings' row ids and, as little-endian integers of 32 bits, their f (two
    for each), len, how many places they have, and these places (two for each)."""
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
    postings = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    coded = postings.column("term").dictionary_encode(null_encoding="encode")
    of = coded.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
    bounds = np.append(heads, len(of))
    taken = postings.take(pa.array(order))
    places = taken.column("places")
    size = pc.fill_null(pc.list_value_length(places), 0).to_numpy().astype(np.int64)
    at = _Layout(np.diff(bounds), size)
    numbers = np.empty(at.ends[-1], "<u4")
    for half, where in enumerate((at.f, at.f + 1)):
        numbers[where] = pc.fill_null(taken.column("f"), 0.0).to_numpy().view("<u4")[half::2]
    numbers[at.f_end] = taken.column("len").to_numpy()
    numbers[at.sizes] = size
    for half, where in enumerate((at.places, at.places + 1)):
        numbers[where] = places.flatten().to_numpy().view("<u4")[half::2]
    packed = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(at.ends * 4), pa.py_buffer(numbers)]).cast(pa.binary())
    ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), taken.column("row_id"))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(of[order][heads])), pa.array(np.diff(bounds)), ids, packed], ["term", "n", "ids", "numbers"])


class _Layout:
    """Where the numbers of packed postings stand: rows of ``n`` postings each, with ``size`` places."""

    def __init__(self, n: np.ndarray, size: np.ndarray | None, ends: np.ndarray | None = None, numbers: np.ndarray | None = None):
        self.row = np.repeat(np.arange(len(n)), n)
        each = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        if ends is None:
            held = np.bincount(self.row, size, len(n)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(4 * n + 2 * held)])
        self.ends, start, many = ends, ends[self.row], n[self.row]
        self.f, self.f_end, self.sizes = start + 2 * each, start + 2 * many + each, start + 3 * many + each
        self.size = numbers[self.sizes].astype(np.int64) if size is None else size
        first = np.cumsum(self.size) - self.size  # a row's places follow each other
        if len(each):
            first = first - np.repeat(first[each == 0], n[n > 0])
        self.places = np.repeat(start + 4 * many + 2 * first, self.size) + 2 * (np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size))


def _unpacked(packed: DataFrame, places: bool = True) -> DataFrame:
    """(term, row_id, f, len, places, version) of packed postings; without ``places`` these are null."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + _UNPACKED, side="right")))
                yield _unpack(batch.slice(at, end - at), places)
                at = end

    id_type = packed.schema["ids"].dataType.elementType.simpleString()
    return packed.select("term", "ids", "numbers", "version").mapInArrow(unpack, f"term string, row_id {id_type}, f double, len int, places array<bigint>, version int")


def _unpack(part: pa.RecordBatch, places: bool) -> pa.RecordBatch:
    binary = part.column("numbers").cast(pa.large_binary())
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    numbers = np.frombuffer(binary.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4")
    at = _Layout(pc.list_value_length(part.column("ids")).to_numpy().astype(np.int64), None, (ends - ends[0]) // 4, numbers)
    wide = lambda where, kind: np.stack([numbers[where], numbers[where + 1]], axis=1).ravel().view(kind)
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at.size)]), pa.int32()), pa.array(wide(at.places, "<i8"))) if places else pa.nulls(len(at.row), pa.list_(pa.int64()))
    rows = pa.array(at.row)
    return pa.RecordBatch.from_arrays([part.column("term").take(rows), part.column("ids").flatten(), pa.array(wide(at.f, "<f8")), pa.array(numbers[at.f_end].astype(np.int32)), listed, part.column("version").take(rows)], ["term", "row_id", "f", "len", "places", "version"])


def built(rows: DataFrame, weights: dict[str, float], key: str = "path") -> Index:
    """The index of the rows, as plans over them. Rows that repeat a key count as one row with all
    their terms; stored indexes don't take them so, see update()."""
    number = F.array_position(F.array(*map(F.lit, weights)), F.col("field")) - 1
    place = F.shiftleft(number, 32).bitwiseOR(F.col("pos"))
    grouped = occurrences(rows, weights, key).groupBy("term", "row_id").agg(F.sum("weight").alias("f"), F.first("len").alias("len"), F.collect_list(place).alias("places"))
    return Index(grouped, row_lengths(rows, weights, key), tuple(weights.values()))


def update(rows: DataFrame, weights: dict[str, float], folder: str, key: str = "path", whole: bool = True) -> dict[str, int]:
    """Brings the index in a folder up to date with the rows, and counts what changed.

    Without an index there it is built in full. A row is read again if any of its indexed columns
    changed, whichever; rows that are gone become dead, unless the rows aren't the ``whole`` table. Of rows that repeat a key one counts, that
    with the smallest digest; rows without a key aren't indexed.
    """
    spark = rows.sparkSession
    state = _state(spark, folder)
    if state and list(state["weights"]) != list(weights.values()):
        raise ValueError(f"the index in {folder} has other weights")
    version = state["version"] + 1 if state else 0
    signed = rows.where(F.col(key).isNotNull()).withColumn("_sha256", _digest(weights))
    now = signed.select(F.col(key).alias("path"), F.col("_sha256").alias("sha256"), _bytes(weights).alias("size")).groupBy("path").agg(F.min(F.struct("sha256", "size")).alias("s"), F.count("*").alias("times")).select("path", "s.*", "times")
    old = _manifest(spark, folder, version - 1) if state else now.select("path", "size", "sha256", F.lit(0).alias("len"), F.lit(0).alias("version")).limit(0)
    diff = manifest_diff(old, now, "times", was="version")
    diff = cut(diff if whole else diff.withColumn("change", F.when(F.col("change") == "removed", "same").otherwise(F.col("change"))))
    told = diff.groupBy("change").agg(F.count("*").alias("n"), F.max("times").alias("times"), F.sum("size").alias("bytes")).collect()  # four kinds at most
    counts = {r["change"]: r["n"] for r in told}
    if state and not counts.keys() - {"same"}:
        return {"version": version - 1, **counts}
    news = [r for r in told if r["change"] in ("added", "updated")]
    fresh = diff.where("change IN ('added', 'updated')").select(F.col("path").alias(key), F.col("sha256").alias("_sha256"))
    repeated = max((r["times"] for r in news), default=1) > 1
    # Where every row is new, the texts needn't meet their digests.
    changed = signed if counts.keys() == {"added"} and not repeated else signed.join(fresh, [key, "_sha256"], "left_semi")
    if repeated:
        changed = changed.dropDuplicates([key])
    buckets, spread = _layout(sum(r["bytes"] for r in news), sum(r["n"] for r in news))
    _write_run(_placed(_postings(changed, weights, key, packed=True), buckets, spread), folder, version, buckets)
    # The rows' lengths were written with their postings, so no text is cut into terms a second time.
    packed = spark.read.schema(f"{_packed(now.schema['path'].dataType.simpleString())}, bucket int").parquet(f"{folder}/postings/version={version}").where(f"bucket = {_LENGTHS}")
    lengths = _unpacked(packed.withColumn("version", F.lit(version)), places=False).select(F.col("row_id").alias("path"), "len")
    manifest = diff.where("change IN ('added', 'updated')").join(lengths, "path").select("path", "size", "sha256", "len", F.lit(version).alias("version"))
    manifest = manifest.unionByName(old.join(diff.where("change = 'same'").select("path"), "path", "left_semi").select("path", "size", "sha256", "len", "version"))
    dead = diff.where("change IN ('updated', 'removed')").select(F.col("path").alias("row_id"), F.col("was").alias("version"))
    if state and state["dead"]:
        dead = dead.unionByName(spark.read.parquet(f"{folder}/dead-{version - 1}"))
    runs = [*(state["runs"] if state else []), (version, buckets)]
    _commit(spark, folder, version, runs, manifest, dead, list(weights.values()))
    return {"version": version, **counts}


def compact(spark: SparkSession, folder: str) -> int:
    """Merges the runs of the index in a folder into one without dead rows, and deletes what is no
    longer read: readers must open the index anew. Returns the version."""
    state = _known(spark, folder)
    version = state["version"] + 1
    if len(state["runs"]) == 1 and not state["dead"]:
        return state["version"]
    manifest = _manifest(spark, folder, version - 1)
    size = manifest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    buckets, spread = _layout(size["bytes"], size["n"])
    living = read(spark, folder).all()
    packed = living.mapInArrow(_packer, _packed(living.schema["row_id"].dataType.simpleString()))
    _write_run(_placed(packed, buckets, spread), folder, version, buckets)
    _commit(spark, folder, version, [(version, buckets)], manifest.withColumn("version", F.lit(version)), None, list(state["weights"]))
    for run in state["runs"]:
        for part in ("postings", "terms"):
            remove(spark, f"{folder}/{part}/version={run['version']}")
    for v in range(version):
        for part in ("manifest", "dead", "state"):
            remove(spark, f"{folder}/{part}-{v}")
    return version


def repaired(rows: DataFrame, weights: dict[str, float], folder: str, key: str = "path") -> Index:
    """The index in a folder, updated first if it is missing or stale, and compacted if it has many
    runs or dead rows."""
    update(rows, weights, folder, key)
    settle(rows.sparkSession, folder)
    return read(rows.sparkSession, folder)


def settle(spark: SparkSession, folder: str) -> None:
    """Compacts the index in a folder if it has many runs or dead rows."""
    state = _state(spark, folder)
    if state and (len(state["runs"]) > MOST_RUNS or state["dead"] > MOST_DEAD * max(state["n"], 1)):
        compact(spark, folder)


def read(spark: SparkSession, folder: str) -> Index:
    """The index in a folder, as the last update or compaction left it."""
    state = _known(spark, folder)
    manifest = _manifest(spark, folder, state["version"])
    dead = None
    if state["dead"]:
        dead = spark.read.parquet(f"{folder}/dead-{state['version']}")
        dead = F.broadcast(dead) if state["dead"] <= SENT_ROWS else dead
    # Schemas are given, so that a run without postings can be read.
    run = lambda part, schema: spark.read.schema(schema).option("basePath", f"{folder}/{part}").parquet(*[f"{folder}/{part}/version={r['version']}" for r in state["runs"]])
    packed = run("postings", f"{_packed(manifest.schema['path'].dataType.simpleString())}, version int, bucket int").where(f"bucket <> {_LENGTHS}")
    size = float(state["n"]), state["total"] / max(state["n"], 1)
    return Index(_unpacked(packed), manifest.select(F.col("path").alias("row_id"), "len"), tuple(state["weights"]), run("terms", "term string, df long, version int, bucket int"), tuple((r["version"], r["buckets"]) for r in state["runs"]), size, dead, packed)


def _layout(size: int | None, rows: int) -> tuple[int, int]:
    """(folders, files of each) for so many bytes of text and rows."""
    buckets = max(BUCKETS, -(-(size or 0) // BUCKET_BYTES))
    return buckets, max(1, -(-rows // FILE_ROWS), -(-(size or 0) // (buckets * TASK_BYTES)))


def _placed(postings: DataFrame, buckets: int, spread: int) -> DataFrame:
    """Dealt to tasks by the folder and file that packed postings belong to."""
    bucket = F.coalesce((F.crc32(F.col("term").cast("binary")) % buckets).cast("int"), F.lit(_LENGTHS))
    of = lambda n: F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n)).cast("int")
    place = F.when(F.col("bucket") == _LENGTHS, of(buckets * spread)).otherwise(F.col("bucket") * spread + of(spread))
    return postings.withColumn("bucket", bucket).repartitionById(buckets * spread, place)


def _write_run(placed: DataFrame, folder: str, version: int, buckets: int) -> None:
    at = f"{folder}/postings/version={version}"
    rows = placed.select("term", "n", "ids", "numbers", "bucket").sortWithinPartitions("bucket", "term")
    rows.write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(at)
    terms = placed.sparkSession.read.schema("term string, n long, bucket int").parquet(at).where(f"bucket <> {_LENGTHS}").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    terms.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{folder}/terms/version={version}")


def _commit(spark: SparkSession, folder: str, version: int, runs: list, manifest: DataFrame, dead: DataFrame | None, weights: list[float]) -> None:
    manifest.write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/manifest-{version}")
    gone = 0
    if dead is not None:
        dead.write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/dead-{version}")
        gone = spark.read.parquet(f"{folder}/dead-{version}").count()
    size = _manifest(spark, folder, version).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    row = (version, [(r[0], r[1]) for r in runs], size["n"], size["total"], gone, weights)
    spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state-{version}")


def _manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest-{version}")


def _state(spark: SparkSession, folder: str) -> Row | None:
    """The newest complete state, None without any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-*/_SUCCESS")) or []
    last = max([int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in done], default=-1)
    return None if last < 0 else spark.read.schema(_STATE).parquet(f"{folder}/state-{last}").first()


def _known(spark: SparkSession, folder: str) -> Row:
    state = _state(spark, folder)
    if state is None:
        raise FileNotFoundError(f"no index in {folder}")
    return state


def document_frequency(index: Index) -> DataFrame:
    """(term, df)."""
    if index.vocabulary is None or index.dead is not None:
        return index.all().groupBy("term").agg(F.count("*").alias("df"))
    return index.vocabulary.groupBy("term").agg(F.sum("df").alias("df"))


def _texts(columns: Iterable[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def _digest(columns: Iterable[str]) -> Column:
    """One digest of all columns' texts, so that a change in any of them shows; a null text is empty."""
    texts = _texts(columns)
    return F.sha2(texts[0] if len(texts) == 1 else F.to_json(F.array(*texts)), 256)


def _bytes(columns: Iterable[str]) -> Column:
    total = F.lit(0)
    for text in _texts(columns):
        total = total + F.octet_length(text)
    return total


def signatures(rows: DataFrame, key: str = "path", columns: Iterable[str] = ("body",)) -> DataFrame:
    """(path, size, sha256) of each row's columns together."""
    columns = list(columns)
    return rows.select(F.col(key).alias("path"), _bytes(columns).alias("size"), _digest(columns).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame, *more: str, was: str | None = None) -> DataFrame:
    """(path, change) between two signature tables: added, removed, updated or same. ``more`` names
    columns of the new table to keep, with its size and digest; ``was`` one of the old."""
    o = old.select("path", F.struct("size", "sha256").alias("o"), *([F.col(was).alias("was")] if was else []))
    n = new.select("path", F.struct("size", "sha256").alias("n"), *more)
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "updated").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"), *([F.col("n.size").alias("size"), F.col("n.sha256").alias("sha256"), *more] if more else []), *(["was"] if was else []))


def staleness(diff: DataFrame) -> DataFrame:
    """One row: how many notes changed, are missing from the index, or are gone."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    return diff.agg(count("updated").alias("changed"), count("added").alias("missing"), count("removed").alias("removed"), count("same").alias("fresh"))
