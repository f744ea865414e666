"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links make.

Texts become sets of 64-bit word-shingle hashes. Every set is ordered by one global order, rare
shingles first, from a table of hashed counts over all documents (fixed size; any consistent
order is right, a good one is fast). Two sets with Jaccard similarity t or more share at least L
of their first n - ceil(t n) + L shingles, for any L. Each document picks its own L: the dearer
the postings of its prefix, by those counts, the longer the prefix and the more matches a pair
must show before it is verified (for two documents, the smaller of their two L).

Only shingles that two different sets post are kept ("live"). Shingles with the same sets, such as
those of one passage that some documents share, count as one posting list, so that a pair meets
once for each list and not once for each shingle. Linking then goes in two steps, so that a group
of near copies doesn't make all its pairs: first each set is verified against a few of the sets
that its lists name as centres, and links are merged to components; then the candidate pairs
between different components are verified. A list pairs the sets outside its largest component
with all others, never that component with itself, and a pair is left to the first list that both
sets' heads show. Any link inside a component changes nothing, so no class differs from that of an
all-pairs join.

The bitmap bound: each set keeps the parity of its shingles in SKETCH_LONGS * 64 hashed cells. A
cell whose parities differ holds at least one shingle that only one of two sets has, so cells that
differ never outnumber those shingles, and a pair with too many isn't similar enough. Pairs that
pass meet a second bitmap, four cells a shingle, and then the exact sets of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, Words, components, fresh, hash_bits, hash_counts, marked, record, row_shingles, session_of, slices, small_or_plain, stored

WIDTH = 5
PERCENT = 80
#: Sizes of the two fixed tables: 2**20 counts, 2**25 bits (4 MB).
COUNT_BITS = 20
LIVE_BITS = 25
#: 64-bit words of a set's parity bitmap.
SKETCH_LONGS = 16
_WORDS = [f"s{i}" for i in range(SKETCH_LONGS)]
#: Sets that each shingle names as centres, and those that a set is verified against at first.
CENTRES = 3
LINKS = 3
#: Prefix lengthenings that a document may choose from.
DEPTHS = (1, 2, 3, 4, 6, 8)
#: Posting lists of a set that tell where it first meets another.
HEAD = 12

_SETS = f"doc_id long, text_key long, sig long, n int, depth int, tokens array<long>, {', '.join(f'{w} long' for w in _WORDS)}"


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set that is similar enough."""
    return -(-n * percent // 100)


def signature(distinct: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set of shingles; equal sets have equal ones."""
    return xxhash.xxh3_64_intdigest(distinct.tobytes()) - (1 << 63)


def parity(distinct: np.ndarray, cells: int) -> np.ndarray:
    """The parity bitmap of a set of shingles, packed in bytes; ``cells`` is a power of two."""
    # Other bits than those that counts and live shingles go by.
    cell = (distinct & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8))


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Cells in which two parity bitmaps differ; the larger is folded to the smaller's size."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def depth_of(cost: np.ndarray, n: int, percent: int, typical: float) -> int:
    """How many matches a document asks for, by the estimated cost of its candidates.

    ``cost`` has the counts of its shingles in global order. A prefix for depth L posts
    n - least_overlap + L shingles; candidates that it is likely to verify are the postings read
    beyond the typical ones, shared out over the L matches that each must have.
    """
    base = n - least_overlap(n, percent)
    if cost[min(n, base + DEPTHS[-1]) - 1] <= 2 * typical:
        return 1  # dear shingles come last, and the longest prefix has none
    best, least = 1, np.inf
    for depth in DEPTHS:
        if base + depth > n:
            break
        read = cost[: base + depth]
        total = len(read) + 4.0 * np.maximum(read - 2 * typical, 0).sum() / depth**2
        if total < least:
            best, least = depth, total
    return best


def prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """_SETS rows of (doc_id, text, text_key): each document's prefix in the order that _shingle_counts()
    gives, with its set's size and bitmap; without words all but the id and size are null."""
    bits = int(len(counts)).bit_length() - 1
    typical = max(float(np.exp2(counts / 10.0).mean()) - 1, 1.0)
    size_of = np.exp2(np.arange(256) / 10.0) - 1
    names = [x.split()[0] for x in _SETS.split(", ")]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens: list[np.ndarray] = []
                many = np.zeros(part.num_rows + 1, np.int64)
                sig, size, depth = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, np.int32)
                maps = np.zeros((part.num_rows, SKETCH_LONGS), np.int64)
                for i, found in enumerate(row_shingles(Words(part.column("text")), width)):
                    if not len(found):
                        continue
                    distinct = np.unique(found)
                    n = len(distinct)
                    own = size_of[counts[(distinct >> np.uint64(64 - bits)).astype(np.int64)]]
                    # Counts near the typical one are noise: order those by hash alone.
                    rank = np.where(own <= 2 * typical, 0, own)
                    order = np.argsort(rank, kind="stable") if rank.any() else np.arange(n)
                    level = depth_of(own[order], n, percent, typical)
                    chosen = distinct[order[: n - least_overlap(n, percent) + level]]
                    tokens.append(chosen)
                    many[i + 1], sig[i], size[i], depth[i] = len(chosen), signature(distinct), n, level
                    maps[i] = parity(distinct, SKETCH_LONGS * 64).view(np.int64)
                none = size == 0
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(many).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield record(names, [part.column("doc_id"), part.column("text_key"), pa.array(sig, mask=none), size, pa.array(depth, mask=none), lists, *[pa.array(maps[:, k].copy(), mask=none) for k in range(SKETCH_LONGS)]])

    return docs.mapInArrow(post, _SETS)


def _live(sets: DataFrame, table: np.ndarray) -> DataFrame:
    """The sets with only those tokens that are marked in ``table``, and ``first``, the place of
    the first of them in the prefix; sets without any are left out."""
    kept = "sig long, n int, depth int, first int, tokens array<long>, " + ", ".join(f"{w} long" for w in _WORDS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("tokens")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                live = marked(table, flat.view(np.uint64))
                done = np.concatenate([[0], np.cumsum(live)])[offsets]
                where = np.flatnonzero(live)
                some = done[1:] > done[:-1]
                first = where[done[:-1][some]] - offsets[:-1][some]
                ends = np.concatenate([[0], done[1:][some]])  # sets without any have no place in between
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[live]))
                yield record([x.split()[0] for x in kept.split(", ")], [*[batch.column(c).filter(pa.array(some)) for c in ("sig", "n", "depth")], first.astype(np.int32), tokens, *[batch.column(w).filter(pa.array(some)) for w in _WORDS]])

    return sets.select("sig", "n", "depth", "tokens", *_WORDS).mapInArrow(keep, kept)


def _shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in slices(batch, "text"):
            # Occurrences, not documents: cheaper, and only an order hangs on it.
            found = np.concatenate(list(row_shingles(Words(part.column("text")), width)))
            table += np.bincount((found >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(table)).astype(table.dtype)

    # To a tenth of a power of two: an order needs no more, and a byte each travels lightly.
    counts = hash_counts(docs.select("text"), fill, COUNT_BITS)
    return np.minimum(np.round(10 * np.log2(1 + counts.astype(np.float64))), 255).astype(np.uint8)


def _needed(percent: int) -> Column:
    """Shingles that two similar sets share: overlap * (100 + percent) >= percent * (n_x + n_y)."""
    return F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent)).cast("int")


def verified(pairs: DataFrame, live: DataFrame, docs: DataFrame, owners: DataFrame, width: int, percent: int, owner: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of signatures whose sets are similar enough, as a table of ``owner``.

    A pair must show its shared prefix shingles in ``live`` first, then pass the bitmaps of
    _bodies(), then the exact sets of hashes. ``owners`` has (sig, least_id).
    """
    scratch = Scratch(docs.sparkSession)
    pairs = scratch.stored(pairs.select("a", "b").distinct(), "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    own = scratch.stored(live.select("sig", "n", "depth", "tokens").join(small_or_plain(used), "sig", "left_semi"), "pair-prefixes")
    x, y = (own.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "depth", "tokens")]) for s, k in (("a", "x"), ("b", "y")))
    # Up to the end of the prefix that ends first all matches are among the shared shingles; the
    # rest of that document can add no more than its unread ones.
    unread = [F.greatest(F.ceil(F.col(f"n_{k}") * percent / 100).cast("int") - F.col(f"depth_{k}"), F.lit(0)) for k in "xy"]
    shared = F.size(F.array_intersect("tokens_x", "tokens_y"))
    fits = (shared >= F.least("depth_x", "depth_y")) & (shared >= _needed(percent) - F.greatest(*unread))
    pairs = scratch.stored(pairs.join(x, "a").join(y, "b").where(fits).select("a", "b"), "matched-pairs")
    bodies = scratch.stored(_bodies(pairs, docs, owners, width), "pair-sets")

    def joined(column: str) -> DataFrame:
        one, two = (bodies.select(F.col("sig").alias(s), F.col(column).alias(f"of_{s}")) for s in "ab")
        return pairs.join(two, "b").join(one, "a").select("a", "b", "of_a", "of_b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                n = [int.from_bytes(v[:8], "little") for v in (p, q)]
                off = differing(*[np.frombuffer(v, np.uint8, offset=8) for v in (p, q)])
                keep.append(off * (100 + percent) <= sum(n) * (100 - percent))
            mask = pa.array(keep, pa.bool_())
            yield record(["a", "b"], [batch.column("a").filter(mask), batch.column("b").filter(mask)])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                mine, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(mine) + len(other) - shared))
            mask = pa.array(keep, pa.bool_())
            yield record(["a", "b"], [batch.column("a").filter(mask), batch.column("b").filter(mask)])

    pairs = scratch.stored(joined("bitmap").mapInArrow(close, "a long, b long"), "close-pairs")
    out = owner.stored(joined("hashes").mapInArrow(check, "a long, b long"), name)
    scratch.drop()
    return out


def _bodies(pairs: DataFrame, docs: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """(sig, bitmap, hashes) of the sets in pairs, one row each: the size and parity bitmap, and the sorted hashes."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    ids = used.join(owners, "sig").select("sig", F.col("least_id").alias("doc_id"))
    texts = docs.join(small_or_plain(ids), "doc_id").select("sig", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sigs, maps, hashes = [], [], []
                for sig, found in zip(part.column("sig").to_pylist(), row_shingles(Words(part.column("text")), width), strict=True):
                    distinct = np.unique(found)
                    # An id that comes with several texts brings them all: only the set's own counts.
                    if len(distinct) and signature(distinct) == sig:
                        sigs.append(sig)
                        cells = max(SKETCH_LONGS * 64, 1 << (4 * len(distinct) - 1).bit_length())
                        maps.append(len(distinct).to_bytes(8, "little") + parity(distinct, cells).tobytes())
                        hashes.append(distinct.tobytes())
                yield record(["sig", "bitmap", "hashes"], [pa.array(sigs, pa.int64()), pa.array(maps, pa.binary()), pa.array(hashes, pa.binary())])

    return texts.mapInArrow(read, "sig long, bitmap binary, hashes binary").dropDuplicates(["sig"])


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    A-Z are lowered; words are runs of bytes other than space and tab to carriage return. A set
    has the distinct shingles of ``width`` words, or the whole sequence as one if there are fewer
    words. Documents link when 100 * intersection >= percent * union; ``component_id`` is the
    smallest id reachable by links, the document's own included.

    Null or empty texts have no shingles and link with nothing. Rows with a null id come back
    with a null component and link with nothing; rows that repeat an id each come back; equal
    texts are one class without further work; no rows give no rows; other columns are ignored.
    A text of any length is one set, held whole in one worker (about 100 bytes a word).
    """
    return _classes(docs, id_col, text_col, width, percent).drop("text_key")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """join_classes() with ``text_key``, a hash of the row's text."""
    scratch = Scratch(session_of(docs))
    early = Scratch(docs.sparkSession)  # what only the first steps read
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = keyed.withColumn("text_key", F.xxhash64("text"))
    chosen = keyed.select("doc_id", "text")
    counts = _shingle_counts(chosen, width)
    rows = early.stored(prefixes(keyed, counts, width, percent), "prefixes")
    heads = scratch.stored(rows.select("doc_id", "text_key", "sig", "n"), "heads")
    owners = scratch.stored(heads.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least_id")), "set-owners")
    # A set's other documents, so that each set posts once.
    copies = heads.join(owners, "sig").where("doc_id > least_id").select("doc_id", "sig").distinct()
    sets = rows.where("sig IS NOT NULL AND doc_id IS NOT NULL").join(small_or_plain(copies), ["doc_id", "sig"], "left_anti")
    tokens = sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    shared = early.stored(tokens.where("count > 1").select("token"), "live-shingles")
    live = scratch.stored(_live(sets, hash_bits(shared, "token", LIVE_BITS)).dropDuplicates(["sig"]), "live-sets")

    posts = early.stored(live.select("sig", F.explode("tokens").alias("token")).join(shared, "token").select("token", "sig"), "live-postings")
    # Shingles that the same sets have: one of them stands for all.
    lists = posts.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor("sig").alias("h1"), F.bit_xor(F.xxhash64("sig")).alias("h2")).where("c > 1")
    first_of = lists.groupBy("c", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    lists = early.stored(posts.join(first_of, "token", "left_semi"), "posting-lists")
    unread = F.greatest(F.ceil(F.col("n") * percent / 100).cast("int") - F.col("depth"), F.lit(0))
    placed = lists.join(live.select("sig", "n", "first", F.size("tokens").alias("posted"), unread.alias("unread"), *_WORDS), "sig")
    placed = scratch.stored(placed, "placed-sets")
    early.drop()

    links = verified(_centre_pairs(placed, percent), live, chosen, owners, width, percent, scratch, "star-links")
    part = components(links, owner=scratch)
    rest = _cross_pairs(placed.join(part.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root"), percent, scratch)
    more = verified(rest, live, chosen, owners, width, percent, scratch, "cross-links")
    every = components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), owner=scratch)

    classes = owners.join(every.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_set = classes.join(least, "root").select("sig", "component_id")
    # A set without documents that have ids keeps its rows; the empty set stands alone.
    named = heads.join(of_set, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).cast("long")
    out = stored(named.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")), "classes")
    scratch.drop()
    return out


def _off(x: list[Column], y: list[Column]) -> Column:
    """Cells in which two parity bitmaps differ."""
    return reduce(add, [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x, y, strict=True)])


def _centre_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """For each set a few likely links (a, b) to other sets.

    Each list names CENTRES of its sets, one as central and the others by hash. A set keeps those
    of its lists' centres that the bounds leave, LINKS of them by one order for all sets, so that
    large groups meet in few.
    """
    own = F.struct("sig", "n", *_WORDS)
    # The first is the set with the fewest unshared shingles: sets that link with few link with such.
    off = (F.col("first") * 1000 / F.col("n")).cast("int")
    orders = [F.struct(off if k == 0 else F.lit(0), F.xxhash64("sig", "token", F.lit(k))) for k in range(CENTRES)]
    pick = [F.min(F.struct(h.alias("h"), own.alias("c"))).alias(f"c{k}") for k, h in enumerate(orders)]
    near = placed.join(placed.groupBy("token").agg(*pick), "token")

    def likely(c: Column) -> Column:
        fits = F.least(F.col("n"), c["n"]) * 100 >= F.greatest(F.col("n"), c["n"]) * percent
        same = _off([F.col(w) for w in _WORDS], [c[w] for w in _WORDS]) * (100 + percent) <= (F.col("n") + c["n"]) * (100 - percent)
        return F.when((c["sig"] != F.col("sig")) & fits & same, c["sig"])

    found = near.select("sig", F.array_distinct(F.array_compact(F.array(*[likely(F.col(f"c{k}.c")) for k in range(CENTRES)]))).alias("to"))
    star = found.select("sig", F.explode("to").alias("centre")).distinct()
    # Only a first choice of pairs to verify: what it leaves out is a candidate later on.
    best = star.withColumn("k", F.row_number().over(Window.partitionBy("sig").orderBy(F.xxhash64("centre"), "centre"))).where(F.col("k") <= LINKS)
    return best.select(F.least("sig", "centre").alias("a"), F.greatest("sig", "centre").alias("b"))


def _cross_pairs(placed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of sets of different components ``comp`` that a list has and the bounds leave."""
    main = placed.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1")
    early = Scratch(placed.sparkSession)
    split = early.stored(placed.join(main.drop("comps"), "token"), "open-lists")
    head = split.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list("token")), 1, HEAD).alias("head"))
    open_ = scratch.stored(split.join(head, "sig"), "open-heads")
    early.drop()
    sides = ("sig", "n", "first", "posted", "unread", "comp", "main", "head", *_WORDS)
    x, y = (df.select("token", *[F.col(c).alias(f"{c}_{k}") for c in sides]) for df, k in ((open_.where("comp <> main"), "x"), (open_, "y")))
    met = F.array_min(F.array_intersect("head_x", "head_y"))
    both = x.join(y, "token").where(
        (F.col("comp_x") != F.col("comp_y"))
        & ((F.col("comp_y") == F.col("main_y")) | (F.col("sig_x") < F.col("sig_y")))
        & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
        & (F.least(F.col("n_x") - F.col("first_x"), F.col("n_y") - F.col("first_y")) >= _needed(percent))
        # As in verified(): so many shingles of the prefixes are shared.
        & (F.least("posted_x", "posted_y") >= _needed(percent) - F.greatest("unread_x", "unread_y"))
        # Shingles that only one of two similar sets has: (100 + percent) * those <= (100 - percent) * (n_x + n_y)
        & (_off(*[[F.col(f"{w}_{k}") for w in _WORDS] for k in "xy"]) * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent))
        & F.coalesce(met == F.col("token"), F.lit(True))
    )
    return both.select(F.least("sig_x", "sig_y").alias("a"), F.greatest("sig_x", "sig_y").alias("b"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns kept, without those whose class has a smaller id.

    Documents without words and rows without an id all stay. A row goes by its own text: of rows
    that share an id, those stay whose text's class has no smaller one; rows that repeat both stay
    or go together. No rows give no rows.
    """
    classes = _classes(docs, id_col, text_col, WIDTH, PERCENT)
    doc, key = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = stored(classes.where("component_id < doc_id").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "near-copies")
    same = (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key))
    return docs.join(small_or_plain(gone), same, "left_anti")
