"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the unit vectors onto a few random orthogonal directions, shifts
them, and orders them along a Hilbert curve. Spark range-partitions every curve's keys; runs of
BLOCK keys make blocks, in which a vector is a byte a component. A query searches its own block and
some on either side, on every curve; the best of these key windows are merged and ranked by the
exact cosine of the original vectors.

How many curves, and how many blocks on either side, is measured: for a bounded sample of queries
the true neighbours are found by a scan, and of all choices that reach RECALL of them the one that
reads least is taken. So recall doesn't fall as a table grows, and no choice reads more than a scan
would: one curve read to its ends is one.

Equal vectors share a representative, so a vector that a third of all rows have is one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, record, session_of, small_or_plain, stored

CURVES = 24
PROJECTED = 12
BITS = 5
#: Vectors in a block.
BLOCK = 256
#: Blocks that are searched together at most.
RUN = 64
SEED = 7
#: Queries whose true neighbours are scanned for, and the share of these that the windows must hold.
SAMPLE = 128
RECALL = 0.95
#: Candidates that a run of blocks gives a query, and those that are ranked exactly, for each one wanted.
FROM_RUN, RANKED = 2, 10


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of integer points in [0, 2**bits)**d, d * bits <= 62."""
    x = points.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations and reflections, from the top bit down
        low = q - 1
        for i in range(d):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, projected: int = PROJECTED, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The keys of unit vectors on one curve."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, curve])
    axes, _ = np.linalg.qr(rng.standard_normal((dim, projected)))
    axes = axes[:, : min(projected, dim)]
    shift = rng.random(axes.shape[1])
    # A projection of a unit vector is near normal with deviation 1 / sqrt(dim): 8 of those and one unit of shift.
    scaled = (unit @ axes * np.sqrt(dim) + 4) / 8 + shift
    cells = np.clip((scaled / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of matching rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def packed(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors with a byte for each component, and the factor of each row."""
    most = np.abs(unit).max(axis=1)
    return np.round(unit / most[:, None] * 127).astype(np.int8), most / 127


def _units(batch: pa.RecordBatch) -> np.ndarray:
    x = np.array(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """The places of each query's ``most`` best rows, by score, then by id."""
    order = np.lexsort((found, -score, query))
    first = np.flatnonzero(np.append(True, np.diff(query[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < most]


def _search(block: pd.DataFrame, most: int, steps: int) -> pd.DataFrame:
    """For each query of a run of blocks the best vectors of those in its window, by the packed
    components."""
    base, asks = block[block["codes"].notna()], block[block["codes"].isna()]
    if not len(base) or not len(asks):
        return pd.DataFrame({"query": pd.Series(dtype="int64"), "found": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    q = np.stack(asks["unit"].to_numpy())
    ids = np.concatenate(base["reps"].to_list()).astype(np.int64)
    codes = np.frombuffer(b"".join(base["codes"]), np.int8).reshape(len(ids), q.shape[1]).astype(np.float32)
    sims = q.astype(np.float32) @ codes.T * np.concatenate(base["factors"].to_list()).astype(np.float32)
    where = np.repeat(base["block"].to_numpy(), base["reps"].map(len))
    sims[np.abs(where[None, :] - asks["block"].to_numpy()[:, None]) > steps] = -np.inf
    many = min(most, len(ids))
    at = np.argpartition(-sims, many - 1, axis=1)[:, :many]
    row, at = np.repeat(np.arange(len(asks)), many), at.ravel()
    inside = np.isfinite(sims[row, at])
    row, at = row[inside], at[inside]
    return pd.DataFrame({"query": asks["rep"].to_numpy()[row], "found": ids[at], "score": sims[row, at].astype(np.float64)})


def cheapest(steps: np.ndarray, blocks: int, recall: float = RECALL) -> tuple[int, int]:
    """(curves, blocks on either side) of the choice that reads least. ``steps[p, c]`` is how many
    blocks a true neighbour is away from its query on curve c."""
    best = 1, blocks
    cost = blocks
    near = np.minimum.accumulate(steps, axis=1)
    for c in range(steps.shape[1]):
        needed = int(np.sort(near[:, c])[max(0, int(np.ceil(recall * len(near))) - 1)])
        if (c + 1) * min(2 * needed + 1, blocks) < cost:
            best, cost = (c + 1, needed), (c + 1) * min(2 * needed + 1, blocks)
    return best


def nearest(vectors: DataFrame, queries_every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, block: int = BLOCK, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by
    ``queries_every``, among all other rows; nearest first by cosine, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    rows with a null id. Vectors of different lengths have no cosine: each length is searched by
    itself. Rows that repeat an id count once, with the smallest of their vectors. Fewer candidates
    than k give all; no rows give none; other columns are ignored.
    """
    spark = session_of(vectors)
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = good.where("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    good = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in good.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():  # a row for each length
        out = out.unionByName(_nearest(good.where(F.size("embedding") == row["dim"]), queries_every, k, curves, block, sample, recall))
    return out


def _nearest(good: DataFrame, queries_every: int, k: int, curves: int, block: int, sample: int, recall: float) -> DataFrame:
    """nearest() over (vec_id, embedding) with vectors of one length."""
    scratch = Scratch(good.sparkSession)
    # One representative for equal vectors, with the k + 1 smallest ids that it stands for.
    key = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = good.withColumn("n", F.row_number().over(key)).where(F.col("n") <= k + 1)
    reps = firsts.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = scratch.stored(reps.select(F.col("ids")[0].alias("rep"), "embedding", "ids"), "ann-points")
    asking = good.where(F.col("vec_id") % queries_every == 0)
    members = scratch.stored(asking.join(reps.select("rep", "embedding"), "embedding").select("rep", F.col("vec_id").alias("query_id")), "ann-queries")
    asks = members.select("rep").distinct()
    chosen = [r["rep"] for r in asks.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _units(batch)
                codes, factors = packed(unit)
                raw = pa.array([x.tobytes() for x in codes], pa.binary())
                for c in range(curves):
                    yield record(["curve", "key", "rep", "code", "factor"], [pa.array([c] * batch.num_rows, pa.int32()), curve_keys(unit, c), batch.column("rep"), raw, factors])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of curve and key; a curve's end closes a block.
        part, serial, held = TaskContext.get().partitionId(), 0, pd.DataFrame()

        def close(rows: pd.DataFrame) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            return record(["curve", "part", "serial", "reps", "factors", "codes"], [pa.array([int(rows["curve"].iloc[0])], pa.int32()), pa.array([part], pa.int32()), pa.array([serial], pa.int32()), pa.array([rows["rep"].to_list()], pa.list_(pa.int64())), pa.array([rows["factor"].to_list()], pa.list_(pa.float64())), pa.array([b"".join(rows["code"])], pa.binary())])

        for batch in batches:
            held = pd.concat([held, batch.to_pandas()])
            for curve in sorted(set(held["curve"])) if len(held) else []:
                mine = held[held["curve"] == curve]
                last = curve == held["curve"].iloc[-1]
                while len(mine) >= block or (len(mine) and not last):
                    yield close(mine.iloc[:block])
                    mine = mine.iloc[block:]
                if last:
                    held = mine
        if len(held):
            yield close(held)

    on_curves = reps.select("rep", "embedding").mapInArrow(keys, "curve int, key long, rep long, code binary, factor double")
    parts = int(good.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = on_curves.repartitionByRange(parts, "curve", "key", F.xxhash64("rep")).sortWithinPartitions("curve", "key", F.xxhash64("rep")).select("curve", "rep", "code", "factor")
    made = scratch.stored(ranged.mapInArrow(blocks, "curve int, part int, serial int, reps array<long>, factors array<double>, codes binary"), "ann-blocks")
    # Blocks are numbered along each curve by the counts of the parts, a row for each part and curve.
    counts = made.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("serial").alias("least"))
    before = counts.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n") - F.col("least")).alias("before"))
    made = made.join(small_or_plain(before), ["curve", "part"]).withColumn("block", (F.col("before") + F.col("serial")).cast("int")).drop("before", "serial", "part")
    places = made.select("curve", "block", F.explode("reps").alias("rep"))
    most = made.agg(F.max("block") + 1).first()[0]
    if not chosen:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    used, steps = _choose(reps, places, chosen, k, curves, most, recall)

    unit = F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y * y)))
    units = asks.join(reps.select("rep", unit.alias("unit")), "rep")
    # Blocks are searched in runs as wide as a window, which then lies in two of them at most; but
    # a task holds no more than RUN blocks, however wide the windows.
    wide = min(2 * steps + 1, RUN)
    run_of = lambda block_: F.floor(block_ / wide).cast("int")
    around = places.where(F.col("curve") < used).join(units, "rep").withColumn("run", F.explode(F.sequence(run_of(F.greatest(F.col("block") - steps, F.lit(0))), run_of(F.least(F.col("block") + steps, F.lit(most - 1))))))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    base = made.where(F.col("curve") < used).select("curve", run_of(F.col("block")).alias("run"), "block", none("rep", "long"), none("unit", "array<double>"), "reps", "factors", "codes")
    both = base.unionByName(around.select("curve", "run", "block", "rep", "unit", none("reps", "array<long>"), none("factors", "array<double>"), none("codes", "binary")))
    found = both.groupBy("curve", "run").applyInPandas(lambda pdf: _search(pdf, FROM_RUN * (k + 1), steps), "query long, found long, score double")
    merged = found.groupBy("query", "found").agg(F.max("score").alias("score"))
    top = merged.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))).where(F.col("n") <= RANKED * (k + 1))
    vectors = lambda name, column: reps.select(F.col("rep").alias(name), F.col("embedding").alias(column))
    pairs = top.select("query", "found").join(vectors("query", "x"), "query").join(vectors("found", "y").join(reps.select(F.col("rep").alias("found"), "ids"), "found"), "found")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) for c in "xy")
                yield record(["rep", "ids", "score"], [batch.column("query"), batch.column("ids"), cosine(x, y)])

    ranked = pairs.select("query", "ids", "x", "y").mapInArrow(exact, "rep long, ids array<long>, score double")
    spread = ranked.select("rep", "score", F.explode("ids").alias("vec_id"))
    hits = members.join(spread, "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = stored(out, "ann-found")
    scratch.drop()
    return out


def _choose(reps: DataFrame, places: DataFrame, chosen: list[int], k: int, curves: int, most: int, recall: float) -> tuple[int, int]:
    """(curves, blocks on either side) by the true neighbours of a few queries, found by a scan."""
    spark = reps.sparkSession
    rows = sorted(reps.where(F.col("rep").isin(chosen)).select("rep", "embedding").collect())  # SAMPLE rows
    ids = np.array([r["rep"] for r in rows])
    q = np.array([r["embedding"] for r in rows], np.float64)
    q /= np.sqrt((q * q).sum(axis=1))[:, None]
    sent = spark.sparkContext.broadcast((ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit_q = sent.value
        query, found, score = (np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64))
        for batch in batches:
            if batch.num_rows:
                sims = unit_q @ _units(batch).T
                own = batch.column("rep").to_numpy(zero_copy_only=False)
                query = np.concatenate([query, np.repeat(names, len(own))])
                found, score = np.concatenate([found, np.tile(own, len(names))]), np.concatenate([score, sims.ravel()])
                keep = _best(query, found, score, k + 1)
                query, found, score = query[keep], found[keep], score[keep]
        if len(query):
            yield record(["query", "found", "score"], [query, found, score])

    near = reps.select("rep", "embedding").mapInArrow(scan, "query long, found long, score double")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "found"))).where(F.col("n") <= k + 1)
    pairs = [(r["query"], r["found"]) for r in near.select("query", "found").collect() if r["query"] != r["found"]]  # SAMPLE * (k + 1) rows
    if not pairs:
        return 1, most
    wanted = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "rep long")
    at = {(r["rep"], r["curve"]): r["block"] for r in places.join(F.broadcast(wanted), "rep").collect()}
    steps = np.array([[abs(at[a, c] - at[b, c]) for c in range(curves)] for a, b in pairs])
    return cheapest(steps, most, recall)
