"""LM scoring with Brown class-based bigrams.

The most frequent words are put into classes by exchange clustering: words move, one at a time, to
the class that raises the likelihood of the class bigrams most. Every other word that occurs LEAST
times or more then joins the class that the classes of its own neighbours fit best; the number of
classes follows how many words have one, and the class bigrams are counted anew over all of them.
Rarer words make a class of their own, and so does the end of a text, which also stands before a
text's first word. A text's probability is the product over its tokens of a class transition,
smoothed with the class's own frequency, and a word's emission from its class. In the class of
rarer words a discount (from the numbers of words seen once and twice) leaves the mass of words
never seen.

Counts go over all training texts. The table of words that travels is bounded: at most TABLE_WORDS
words of at most TABLE_BYTES bytes. Every other word meets its count and its class in a shuffled
join, so all counts, classes and transitions are the same at any size of the table. That join is
made once: texts are dealt to groups, each group meets the words outside the table that its texts
hold, and the texts are written as classes, from which transitions are counted and scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Words, hash_counts, record, session_of, slices, stored
from notelake.llm.labelled import fold

#: States of the exchange's word bigram table, a power of two: words, the class of others, the end.
FREQUENT = 1024
#: Classes at least; twice the cube root of the number of words with a class, if that is more.
CLASSES = 48
#: Occurrences from which a word has a class of its own neighbours' choice.
LEAST = 5
SWEEPS = 6
TABLE_WORDS = 200_000
TABLE_BYTES = 40
#: Bytes of text that a group of texts has, about.
GROUP_BYTES = 8 << 20
_BASE = 0.1
_SMOOTH = 5.0

#: Neighbours of a word that a task holds before it sends them on.
_HELD_PAIRS = 4_000_000
_CODED = "doc_id long, learned boolean, n_tokens long, n_known long, base double, emitted double, states binary"


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange_clusters(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each of the first n - 2 states of a bigram table; the last two keep their own.

    Starts from words dealt out by rank. In each sweep every word goes to the class with the
    highest likelihood of class bigrams, until none moves.
    """
    s = len(pairs)
    words = s - 2
    classes = max(1, min(classes, words))
    of = np.concatenate([np.arange(words) % classes, [classes, classes + 1]]).astype(np.int64)
    c = classes + 2
    pairs = pairs.astype(np.float64)
    member = np.zeros((s, c))
    member[np.arange(s), of] = 1
    right, left = pairs @ member, (pairs.T @ member)  # what follows, and comes before, each word by class
    table = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own, self_ = of[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            if not r.any() and not l.any():
                continue
            r[own] -= self_
            l[own] -= self_
            table[own] -= r
            table[:, own] -= l
            table[own, own] -= self_
            # With w in class t: row t gains r, column t gains l, and (t, t) gains w after w as well.
            rows = _xlogx(table[:classes] + r) - _xlogx(table[:classes])
            cols = _xlogx(table[:, :classes] + l[:, None]) - _xlogx(table[:, :classes])
            gain = rows.sum(axis=1) + cols.sum(axis=0)
            t = np.arange(classes)
            both = table[t, t]
            gain += _xlogx(both + r[t] + l[t] + self_) - _xlogx(both + r[t]) - _xlogx(both + l[t]) + _xlogx(both)
            out, into = table[:classes].sum(axis=1), table[:, :classes].sum(axis=0)
            gain -= _xlogx(out + r.sum() + self_ + l[t]) - _xlogx(out) + _xlogx(into + l.sum() + self_ + r[t]) - _xlogx(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            table[best] += r
            table[:, best] += l
            table[best, best] += self_
            if best != own:
                of[w] = best
                moved += 1
                right[:, own] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, own] -= pairs[w]
                left[:, best] += pairs[w]
        if not moved:
            break
    return of


@dataclass
class BrownModel:
    """Everything that scoring needs but the counts and classes of words outside the table."""

    table: pa.Array  # words with their counts at hand, the frequent ones first
    least: int | None  # the table has all words that occur so often and have TABLE_BYTES bytes at most
    counts: np.ndarray
    state: np.ndarray  # the class of each word of the table; the last entry is that of rarer words
    in_class: np.ndarray  # tokens of each class's words
    tokens: int
    types: int
    ends: int
    other_tokens: float
    other_types: float
    discount: float
    transition: np.ndarray | None = None  # log10 by (class before, class)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + _BASE) / (self.tokens + _BASE * (self.types + 1)))

    def emission(self, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of words with these counts and classes; a count of 0 is that of a word never seen."""
        rest = self.other_tokens or 1.0
        unseen = max(self.discount * self.other_types / rest, 1e-12) if self.other_tokens else 1.0
        rarer = np.where(count > 0, np.maximum(count - self.discount, 0) / rest, unseen)
        return np.log10(np.where(of == self.state[-1], rarer, count / np.maximum(self.in_class[of], 1)))

    def outside(self) -> Column:
        """Whether a (word, c) isn't in the table."""
        return F.lit(True) if self.least is None else ~((F.octet_length("word") <= TABLE_BYTES) & (F.col("c") >= self.least))


def _finder(table: pa.Array) -> Callable[[Words], np.ndarray]:
    """Where each distinct word is in the table; its length for words outside."""
    n = len(table)
    at = dict(zip(table.to_numpy(zero_copy_only=False), range(n), strict=True))
    return lambda words: np.fromiter(map(at.get, words.distinct.to_numpy(zero_copy_only=False), repeat(n)), np.int64, len(words.distinct))


def _laid(words: Words, own: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the values of all tokens with the ends put in, where each word is, where each row begins)."""
    n = len(words.first) - 1
    begin = words.first[:-1] + np.arange(n)
    place = np.arange(len(words.codes)) + np.repeat(np.arange(n), np.diff(words.first))
    out = np.full(len(words.codes) + n, end, np.int64)
    out[place] = own[words.codes] if len(words.codes) else 0
    return out, place, begin


def _shifted(x: np.ndarray, first: int) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


def _listed(keys: np.ndarray, times: np.ndarray, slots: int, distinct: pa.Array) -> pa.RecordBatch:
    """(word, near, c) from ascending keys, word times ``slots`` plus slot: a row for each word."""
    word = keys // slots
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))[: len(keys)]
    near = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)), pa.int32()), pa.array(keys % slots << 40 | times))
    return record(["word", "near", "c"], [distinct.take(pa.array(word[heads])).cast(pa.string()), near, pa.nulls(len(heads), pa.int64())])


def _assign(neighbours: DataFrame, joint: np.ndarray, classes: int) -> DataFrame:
    """(word, c, class): for each word of (word, near, c) the class whose bigrams fit its neighbours
    best. A word's rows follow each other: the first has its c, if it is to have a class, and the
    others' ``near`` list neighbours, slot above 40 bits of their number: classes before the word,
    then, behind these, classes after it."""
    smooth = joint + _SMOOTH * np.outer(joint.sum(axis=1) + 1, joint.sum(axis=0) + 1) / (joint.sum() + 1) ** 2
    before = np.log(smooth / smooth.sum(axis=1, keepdims=True) / smooth.sum(axis=0, keepdims=True))[:, :classes]
    after = np.log(smooth / smooth.sum(axis=1, keepdims=True))[:classes].T
    fit = np.concatenate([before, after])
    slots = len(fit)

    def chosen(words: pa.Array, c: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        own = counts.any(axis=1)
        return record(["word", "c", "class"], [words.filter(pa.array(own)), c[own], np.argmax(np.round(counts[own] @ fit, 6), axis=1).astype(np.int32)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_c, last_counts = None, 0, np.zeros(slots)  # the word that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            of, words = coded.indices.to_numpy(), coded.dictionary
            c = np.zeros(len(words), np.int64)
            np.maximum.at(c, of, pc.fill_null(batch.column("c"), 0).to_numpy())
            goes_on = words[0].as_py() == last
            if goes_on:
                c[0] = max(c[0], last_c)
            elif last_c:
                yield chosen(pa.array([last]), np.array([last_c]), last_counts[None])
            kept = np.flatnonzero(c)
            at = np.full(len(words), -1)
            at[kept] = np.arange(len(kept))
            near = batch.column("near")
            flat = near.flatten().to_numpy()
            row = at[of[pc.list_parent_indices(near).to_numpy()]]
            flat, row = flat[row >= 0], row[row >= 0]
            counts = np.bincount(row * slots + (flat >> 40), flat & (1 << 40) - 1, len(kept) * slots).reshape(-1, slots)
            if goes_on and last_c:
                counts[0] += last_counts
            last, last_c = words[-1].as_py(), int(c[-1])
            if last_c:
                last_counts = counts[-1].copy()
                kept, counts = kept[:-1], counts[:-1]
            if len(kept):
                yield chosen(words.take(pa.array(kept)), c[kept], counts)
        if last_c:
            yield chosen(pa.array([last]), np.array([last_c]), last_counts[None])

    return neighbours.mapInArrow(assign, "word string, c long, class int")


def learn(train: DataFrame, exchanged: int | None = None) -> tuple[BrownModel, DataFrame, DataFrame]:
    """The model of the texts of (text), and the tables (word, c) of all words' counts and
    (word, c, class) of the classes that words other than the most frequent have.

    ``exchanged``, a power of two, is how many states the exchange has (FREQUENT if not given):
    that many words less two."""
    model, vocabulary, classes = _classed(train, exchanged)
    coded = _coded(train.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("learned"), "text"), model, vocabulary, classes)
    model.transition = _transition(coded, len(model.in_class))
    return model, vocabulary, classes


def _classed(train: DataFrame, exchanged: int | None) -> tuple[BrownModel, DataFrame, DataFrame]:
    """What learn() gives, but for the transitions."""
    exchanged = FREQUENT if exchanged is None else exchanged
    if exchanged < 32 or exchanged & (exchanged - 1):
        raise ValueError("exchanged must be a power of two, 32 or more")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                many = np.bincount(words.codes, minlength=len(words.distinct))
                yield record(["word", "c"], [words.distinct, many.astype(np.int64)])

    vocabulary = stored(train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.pow(2.0, F.floor(F.log2("c"))).cast("long")).alias("least")
    fits = F.octet_length("word") <= TABLE_BYTES
    steps = vocabulary.groupBy(step).agg(F.count("*").alias("types"), F.sum("c").alias("tokens"), F.sum(fits.cast("long")).alias("fit")).orderBy(F.desc("least")).collect()
    ends = train.count()
    tokens = sum(r["tokens"] for r in steps) + ends
    types = sum(r["types"] for r in steps) + (ends > 0)
    held, least = 0, None
    for r in steps:
        held += r["fit"]
        if held > TABLE_WORDS:
            break
        least = r["least"]
    if least is None:
        words, counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)
    else:
        found = vocabulary.where(fits & (F.col("c") >= least)).toArrow()  # TABLE_WORDS rows at most
        found = found.take(pc.sort_indices(found, [("c", "descending"), ("word", "ascending")]))
        words, counts = found["word"].combine_chunks().cast(pa.large_string()), found["c"].to_numpy().astype(np.int64)
    frequent = min(len(words), exchanged - 2)
    states = frequent + 2
    top, top_state = words[:frequent], np.append(np.arange(frequent), frequent)

    def pairs(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            at = pc.index_in(w.distinct, value_set=top) if frequent else pa.nulls(len(w.distinct), pa.int32())
            own, _, _ = _laid(w, top_state[pc.fill_null(at, frequent).to_numpy(zero_copy_only=False)], frequent + 1)
            table += np.bincount(_shifted(own, frequent + 1) * exchanged + own, minlength=exchanged * exchanged).astype(table.dtype)

    wide = hash_counts(train.select("text"), pairs, (exchanged * exchanged).bit_length() - 1).reshape(exchanged, exchanged)
    bigrams = wide[:states, :states].astype(np.float64)
    often = sum(r["types"] for r in steps if r["least"] >= LEAST)
    of = exchange_clusters(bigrams, max(CLASSES, 2 * round(often ** (1 / 3))))
    n_classes = int(of.max()) + 1
    other, end = n_classes - 2, n_classes - 1
    member = np.zeros((states, n_classes))
    member[np.arange(states), of] = 1

    # Further words: the classes next to them, of the frequent words.
    top_class = of[top_state]
    rare = np.append(counts < LEAST, False)
    rare[:frequent] = True
    slots = 2 * n_classes

    def next_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(words)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # keys and numbers of words of the table
        many = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                at = find(w)
                own, place, _ = _laid(w, top_class[np.minimum(at, frequent)], end)
                pick = ~rare[at][w.codes]
                code, where = w.codes[pick].astype(np.int64), place[pick]
                slot = np.concatenate([_shifted(own, end)[where], n_classes + own[where + 1]])
                known = np.tile(at[code] < len(words), 2)
                parts.append(np.unique(np.tile(at[code], 2)[known] * slots + slot[known], return_counts=True))
                many += len(parts[-1][0])
                if not known.all():
                    yield _listed(*np.unique(np.tile(code, 2)[~known] * slots + slot[~known], return_counts=True), slots, w.distinct)
            if many > _HELD_PAIRS:
                parts = [summed()]
                many = len(parts[0][0])
                if many > _HELD_PAIRS // 2:
                    yield _listed(*parts.pop(), slots, words)
                    many = 0
        if many:
            yield _listed(*summed(), slots, words)

    near = train.select("text").mapInArrow(next_to, "word string, near array<bigint>, c long")
    named = vocabulary.where(F.col("c") >= LEAST).select("word", F.expr("cast(array() as array<bigint>)").alias("near"), "c")
    together = near.unionByName(named).repartition("word").sortWithinPartitions("word", F.desc_nulls_last("c"))
    classes = stored(_assign(together, member.T @ bigrams @ member, n_classes - 2), "word-classes")
    state = np.full(len(words) + 1, other, np.int64)
    state[:frequent] = of[:frequent]
    if len(words) > frequent:
        given = classes.where(fits & (F.col("c") >= least)).toArrow()  # TABLE_WORDS rows at most
        at = pc.index_in(given["word"].combine_chunks().cast(pa.large_string()), value_set=words).to_numpy(zero_copy_only=False)
        state[at.astype(np.int64)] = given["class"].to_numpy()

    in_class = np.bincount(of[:frequent], weights=counts[:frequent].astype(np.float64), minlength=n_classes)
    joined = 0
    for r in classes.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        in_class[r["class"]] += r["c"]
        joined += r["n"]
    other_tokens = float(tokens - ends - in_class.sum())
    other_types = float(types - (ends > 0) - frequent - joined)
    seen = {r["least"]: r["types"] for r in steps}
    once, twice = seen.get(1, 0), seen.get(2, 0)
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    return BrownModel(words, least, counts, state, in_class, int(tokens), int(types), int(ends), other_tokens, other_types, discount), vocabulary, classes


def _coded(docs: DataFrame, model: BrownModel, vocabulary: DataFrame, classes: DataFrame) -> DataFrame:
    """_CODED of each of (doc_id, learned, text), written once: the sums of its words' base scores and
    emissions, and the classes of its tokens as little-endian 16-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grouped = docs.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // GROUP_BYTES)))))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table
        find = _finder(table)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                pick = (find(w) == len(table))[w.codes]
                if pick.any():
                    group = np.repeat(part.column("group").to_numpy(), np.diff(w.first))[pick]
                    pair = np.unique(group * len(w.distinct) + w.codes[pick])
                    yield record(["group", "word"], [pair // len(w.distinct), w.distinct.take(pa.array(pair % len(w.distinct))).cast(pa.string())])

    known = vocabulary.where(model.outside()).join(classes.where(model.outside()).select("word", "class"), "word", "left")
    met = grouped.select("group", "text").mapInArrow(outside, "group long, word string").join(known, "word")
    names = [x.split()[0] for x in _CODED.split(", ")]

    def code(texts: pa.Table, met: pa.Table) -> pa.Table:
        m = sent.value
        n_table, other = len(m.table), int(m.state[-1])
        find = _finder(m.table)
        own = dict(zip(met.column("word").to_numpy(), range(met.num_rows), strict=True))
        count = np.concatenate([m.counts, met.column("c").to_numpy(), [0]])
        of = np.concatenate([m.state[:-1], pc.fill_null(met.column("class"), other).to_numpy(), [other]]).astype(np.int64)
        base, emission = m.base(count), m.emission(count, of)
        base_end = float(m.base(np.array([m.ends]))[0])
        out = []
        for batch in texts.to_batches():
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                at = find(w)
                new = np.flatnonzero(at == n_table)
                at[new] += np.fromiter(map(own.get, w.distinct.take(pa.array(new)).to_numpy(zero_copy_only=False), repeat(met.num_rows)), np.int64, len(new))
                states, _, begin = _laid(w, of[at], other + 1)
                sums = lambda x, w=w, at=at: np.diff(np.concatenate([[0], np.cumsum(x[at][w.codes])])[w.first])
                places = pa.py_buffer(np.append(begin, len(states)).astype(np.int32) * 2)
                coded = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, places, pa.py_buffer(states.astype("<u2"))])
                n_known = sums((count > 0).astype(np.int64)) + (m.ends > 0)
                out.append(record(names, [part.column("doc_id"), part.column("learned"), np.diff(w.first) + 1, n_known, sums(base) + base_end, sums(emission), coded]))
        return pa.Table.from_batches(out) if out else pa.table({n: pa.nulls(0, t) for n, t in zip(names, _KINDS, strict=True)})

    return stored(grouped.groupBy("group").cogroup(met.groupBy("group")).applyInArrow(code, _CODED), "coded-texts")


_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())


def _states(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the classes of all rows' tokens on end, where each row begins)."""
    column = column.cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[places[0] : places[-1]].view("<u2")
    return flat.astype(np.int64), (places[:-1] - places[0]) // 2


def _transition(coded: DataFrame, n_classes: int) -> np.ndarray:
    """log10 by (class before, class) over _CODED texts; every text ends with the last class."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        states, _ = _states(batch.column("states"))
        table += np.bincount(_shifted(states, n_classes - 1) * n_classes + states, minlength=len(table)).astype(table.dtype)

    bits = max(10, int(n_classes * n_classes - 1).bit_length())
    joint = hash_counts(coded.where("learned").select("states"), fill, bits)[: n_classes * n_classes].reshape(n_classes, n_classes).astype(np.float64)
    single = joint.sum(axis=0) + 0.5
    return np.log10((joint + _SMOOTH * single / single.sum()) / (joint.sum(axis=1, keepdims=True) + _SMOOTH))


def score_texts(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, exchanged: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the documents outside fold ``held`` of ``folds`` (or where ``train`` holds). A-Z
    are lowered; tokens are words and one end. ``base_score`` is the unigram score with 0.1 added,
    ``score`` the model's log10 probability; all words never seen count as one type in both.
    ``exchanged`` is how many states the exchange has (see learn()); more cost the driver
    8 bytes times their square, and its time grows with them.
    Null texts count as empty: the end alone. A null id is never held out and is learned from;
    rows that repeat an id are scored each; without texts to learn from all counts are 0; no
    documents give no rows; other columns are ignored. A text of any length is counted and scored
    whole, in one worker (about 100 bytes a word of it).
    """
    session_of(docs)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out_of = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    learned = ~out_of if train is None else F.coalesce(train, F.lit(False))
    chosen = chosen.withColumn("learned", learned)
    model, vocabulary, classes = _classed(chosen.where("learned").select("text"), exchanged)
    coded = _coded(chosen, model, vocabulary, classes)
    transition = model.transition = _transition(coded, len(model.in_class))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        for batch in batches:
            if batch.num_rows:
                states, begin = _states(batch.column("states"))
                steps = np.add.reduceat(transition[_shifted(states, len(transition) - 1), states], begin)
                yield record(names, [*[batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "base")], batch.column("emitted").to_numpy() + steps])

    scored = coded.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
