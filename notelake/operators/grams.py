"""Substring search over an index of trigrams.

A text holds a string of three characters or more only if it holds each of its trigrams. So the
rows that hold the rarest few of a search's trigrams are found first, and only these are compared.
Postings that are stored lie in folders by a hash of the trigram, as the words' do. Those that aren't
are cut down to a batch's trigrams where the texts are, so that few leave the tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from notelake.operators.index import BUCKETS, FILE_ROWS, LOOKED_UP
from notelake.operators.lineage import SENT_ROWS, cut, held, sent, shared_folder

#: How many of a search's trigrams must all be met before texts are compared: the rarest ones.
RAREST = 4
#: Strings that a scan looks for at once.
SCANNED = 2_000


def keys(text: str | None) -> np.ndarray:
    """The distinct trigrams of a text, 21 bits a character."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


@F.pandas_udf(ArrayType(LongType()))
def grams_of(texts: pd.Series) -> pd.Series:
    return pd.Series([keys(t if isinstance(t, str) else None) for t in texts], index=texts.index)


def _each(wanted: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's trigrams; only those of ``wanted``, in order, if it is given."""

    def only(found: np.ndarray) -> np.ndarray:
        return found if wanted is None else found[wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [only(keys(t)) for t in part.column("hay").to_pylist()]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), part.column("row_id").take(pa.array(row))], ["gram", "row_id"])

    return each


@dataclass(frozen=True)
class Grams:
    """``postings`` (gram, row_id) and ``counts`` (gram, df); ``buckets`` folders if it is stored,
    else the ``rows`` (row_id, hay) they are plans over."""

    postings: DataFrame
    counts: DataFrame
    buckets: int = 0
    rows: DataFrame | None = None

    def held_by(self, grams: DataFrame) -> DataFrame:
        """The postings of a batch's trigrams (gram)."""
        return self.of(self.postings, grams) if self.rows is None else self._cut_down(grams)

    def frequencies(self, grams: DataFrame) -> DataFrame:
        """(gram, df) of a batch's trigrams."""
        if self.rows is None:
            return self.of(self.counts, grams).groupBy("gram").agg(F.sum("df").alias("df"))
        return self._cut_down(grams).groupBy("gram").agg(F.count("*").alias("df"))

    def _cut_down(self, grams: DataFrame) -> DataFrame:
        found = grams.distinct().limit(SENT_ROWS + 1).toArrow().column("gram").to_numpy()  # longs
        if len(found) > SENT_ROWS:
            return self.postings.join(grams.distinct(), "gram", "left_semi")
        return _postings(self.rows, np.sort(found)) if len(found) else self.postings.limit(0)

    def of(self, table: DataFrame, grams: DataFrame) -> DataFrame:
        """A table's rows of a batch's trigrams (gram)."""
        place = _bucket(self.buckets or 1)
        found = grams.select("gram", place.alias("bucket")).distinct().limit(LOOKED_UP + 1).collect()
        if len(found) > LOOKED_UP:
            return table.join(grams.distinct(), "gram", "left_semi")
        kept = table.where(F.col("gram").isin([r["gram"] for r in found]))
        return kept.where(F.col("bucket").isin(sorted({r["bucket"] for r in found}))) if self.buckets else kept


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def built(rows: DataFrame) -> Grams:
    """The trigrams of rows (row_id, hay), as plans over them."""
    postings = _postings(rows)
    return Grams(postings, postings.groupBy("gram").agg(F.count("*").alias("df")), rows=rows)


def _postings(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    return rows.mapInArrow(_each(wanted), f"gram long, row_id {rows.schema['row_id'].dataType.simpleString()}")


def stored(rows: DataFrame, folder: str | None = None) -> Grams:
    """The same written to a folder (one in the shared folder by default), sorted by trigram."""
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}"
    spread = max(1, -(-rows.count() // FILE_ROWS))
    placed = built(rows).postings.withColumns({"bucket": _bucket(BUCKETS), "spread": F.pmod(F.xxhash64("row_id"), F.lit(spread)).cast("int")})
    placed = placed.repartition(BUCKETS * spread, "bucket", "spread").drop("spread").sortWithinPartitions("bucket", "gram", "row_id")
    placed.write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
    counts = spark.read.schema("gram long, bucket int").parquet(f"{folder}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("df"))
    counts.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{folder}/counts")
    return read(spark, folder, rows.schema["row_id"].dataType.simpleString())


def read(spark: SparkSession, folder: str, id_type: str = "string") -> Grams:
    postings = spark.read.schema(f"gram long, row_id {id_type}, bucket int").parquet(f"{folder}/postings")
    return Grams(postings, spark.read.schema("gram long, df long, bucket int").parquet(f"{folder}/counts"), BUCKETS)


def holding(searches: DataFrame, rows: DataFrame, grams: Grams) -> DataFrame:
    """(query_id, row_id): the rows (row_id, hay) that hold all strings of a search (query_id, words).

    Searches whose strings all have fewer than three characters go over all rows, some strings at a
    time, each looked for once in every row. Searches without strings hold nowhere.
    """
    searches = held(searches.where(F.size("words") > 0))
    asked = searches.select("query_id", F.explode("words").alias("w")).select("query_id", F.explode(grams_of("w")).alias("gram")).distinct()
    asked = held(asked)
    counts = cut(grams.frequencies(asked.select("gram")))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "gram")
    rarest = held(asked.join(sent(counts), "gram", "left").withColumn("k", F.row_number().over(order)).where(F.col("k") <= RAREST).select("query_id", "gram"))
    needed = rarest.groupBy("query_id").agg(F.count("*").alias("needed"))
    met = grams.held_by(rarest.select("gram")).select("gram", "row_id").join(rarest, "gram").groupBy("query_id", "row_id").agg(F.count("*").alias("n"))
    pairs = cut(met.join(needed, "query_id").where("n = needed").select("query_id", "row_id"))
    wanted = rows.join(sent(pairs.select("row_id").distinct()), "row_id", "left_semi")
    found = pairs.join(searches, "query_id").join(wanted, "row_id").where(F.forall("words", lambda w: F.contains(F.col("hay"), w))).select("query_id", "row_id")
    return found.unionByName(_scanned(searches.join(needed, "query_id", "left_anti"), rows))


def _scanned(searches: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for searches of short strings alone, some searches at a time."""
    n = searches.select(F.explode("words").alias("w")).distinct().count()
    passes = -(-n // SCANNED)
    out = searches.join(rows.select("row_id").limit(0), F.lit(False)).select("query_id", "row_id")
    for k in range(passes):
        own = searches.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
        every = [r["w"] for r in own.select(F.explode("words").alias("w")).distinct().collect()]  # of two characters at most
        has = rows.select("row_id", F.filter(F.array(*map(F.lit, every)), lambda w: F.contains(F.col("hay"), w)).alias("has")) if every else None
        if has is not None:
            by_first = sent(own.withColumn("w", F.element_at("words", 1)))
            out = out.unionByName(has.select("row_id", "has", F.explode("has").alias("w")).join(by_first, "w").where(F.size(F.array_except("words", "has")) == 0).select("query_id", "row_id"))
    return out
