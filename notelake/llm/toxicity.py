"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nystroem landmarks.

The kernel of two letter strings counts the three-letter subsequences they share, each weighted by
DECAY to the power of the stretch it spans (at most SPAN letters), and is normalised. Gaps and
inserted letters lower it a little; case, and signs or spaces between letters, not at all.

Learning: the examples are sentences of labelled texts. A sentence meets a landmark by its window
(a word, or a stretch of a long run of letters), so that the rest of the sentence doesn't dilute an
insult. The label belongs to the text: of a toxic text at least one sentence is toxic, of a clean
one none. So a text's examples are the sentence that the machine before finds worst and all others
that it finds toxic, in each of ROUNDS machines; those of clean texts stay examples, and those of
toxic ones also enter with a letter inserted. Of these machines the one that fits the labels of its own texts best is kept. The
first machine, which chooses the first examples and the landmarks, parts
windows whose neighbours are toxic beyond chance from common clean ones.

As the kernel is an inner product over subsequences, the machine folds into one weight per
subsequence, which gives the same decision values without visiting landmarks again. A text's value
is that of its worst window; a logistic curve turns it into a score.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Words, record, session_of, slices
from notelake.llm.labelled import Logistic, fold, sample
from notelake.llm.tokens import forget

DECAY = 0.6
SPAN = 7
LANDMARKS = 128
#: Commonest clean windows that the first machine may learn from, how many of those nearest to
#: toxic ones it does, and one in how many of the rest. They choose landmarks and first examples alone.
COMMON, NEAREST, ONE_IN = 20_000, 2000, 25
#: Choices of every text's examples.
ROUNDS = 5
SHORTEST, LONGEST = 3, 24
#: Words whose values a worker keeps; about 150 bytes each.
REMEMBERED = 100_000
#: Words that are valued in one go; at most 12 kB each.
WORDS_AT_ONCE = 5000
THRESHOLD = 0.5
#: Letters: a-z are 1 to 26, others share five more numbers; 0 pads.
_LETTERS = 32


def letter_codes(words: list[str], size: int) -> np.ndarray:
    """A row of letter numbers for each word of ``size`` letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 5)


def _triples(size: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i + 1)) for i in range(size) for j in range(i + 1, size) for k in range(j + 1, min(size, i + SPAN))]


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights): for each row of letters its three-letter subsequences; weights are the same for all rows."""
    places = _triples(codes.shape[1])
    i, j, k = (np.array([p[n] for p in places]) for n in range(3))
    return (codes[:, i] * _LETTERS + codes[:, j]) * _LETTERS + codes[:, k], np.array([p[3] for p in places])


def norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The length of each row's feature map, in which equal subsequences add up."""
    order = np.argsort(ids.astype(np.uint16), axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, axis=1)
    new = np.ones(ids.shape, bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    total = np.add.reduceat(weights[order].ravel(), np.flatnonzero(new))
    distinct = new.sum(axis=1)
    return np.sqrt(np.add.reduceat(total * total, np.cumsum(distinct) - distinct))


def features(word: str) -> dict[int, float]:
    """The kernel's explicit feature map of one word, normalised."""
    ids, weights = subsequences(letter_codes([word], len(word)))
    out: dict[int, float] = defaultdict(float)
    for a, w in zip(ids[0].tolist(), weights.tolist(), strict=True):
        out[a] += w
    norm = np.sqrt(sum(v * v for v in out.values())) or 1.0
    return {a: v / norm for a, v in out.items()}


def kernel(a: list[dict[int, float]], b: list[dict[int, float]]) -> np.ndarray:
    """The normalised kernel between two lists of feature maps."""
    dense = np.zeros((len(b), _LETTERS**3), np.float32)
    for row, own in enumerate(b):
        dense[row, list(own)] = list(own.values())
    out = np.zeros((len(a), len(b)))
    for row, own in enumerate(a):
        if own:
            out[row] = dense[:, list(own)] @ np.array(list(own.values()), np.float32)
    return out


def spread(maps: list[dict[int, float]], many: int) -> list[dict[int, float]]:
    """Landmarks that cover a list of feature maps: each next one is the least similar to those before."""
    out, near = [], np.full(len(maps), -1.0)
    for _ in range(min(many, len(maps))):
        k = int(np.argmin(near))
        if near[k] > 0.999:
            break
        out.append(maps[k])
        near = np.maximum(near, kernel(maps, [maps[k]])[:, 0])
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Hinge loss and ridge, by dual coordinate descent; y is -1 or 1. Returns (w, bias)."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, alpha, top = np.zeros(x1.shape[1]), np.zeros(len(x1)), c * weight
    square = (x1 * x1).sum(axis=1)
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x1)):
            gradient = y[i] * (w @ x1[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x1[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w[:-1], float(w[-1])


def letters_of(words: pa.Array) -> pa.Array:
    """Words with only their letters left, lowered."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}]+", ""))


def _sentence_words(text: str) -> Iterator[list[str]]:
    """The letters of each sentence's words, as scoring sees them."""
    for sentence in re.split(r"[.!?\n]+\s+|\n+", text):
        bare = (x if x.isalpha() else "".join(filter(str.isalpha, x)) for x in sentence.split())
        yield [w.lower() for w in bare if w]


def _windows(run: str) -> Iterator[str]:
    """A long run of letters in overlapping windows: any word of up to half of one lies whole in some."""
    for a in range(0, max(1, len(run) - LONGEST // 2), LONGEST // 2):
        yield run[a : a + LONGEST]


class Sentences:
    """The sentences of (text, label) pairs as flat arrays of window numbers."""

    def __init__(self, rows: list[tuple[str, int]]):
        codes: dict[str, int] = {}
        window, context, first, owner, label = array("I"), array("I"), array("I"), array("I"), array("b")
        self.labels = np.array([y for _, y in rows], np.int64)
        for row, (text, y) in enumerate(rows):
            for words in _sentence_words(text):
                start = len(window)
                for k, w in enumerate(words):
                    if len(w) < SHORTEST:
                        continue
                    around = crc32(f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}".encode())
                    for part in (w,) if len(w) <= LONGEST else _windows(w):
                        if len(part) >= SHORTEST:
                            window.append(codes.setdefault(part, len(codes)))
                            context.append(around)
                if len(window) > start:
                    first.append(start)
                    owner.append(row)
                    label.append(y)
        self.terms = list(codes)
        self.window, self.first, self.owner = (np.frombuffer(x, np.uint32).astype(np.int64) for x in (window, first, owner))
        side = np.repeat(np.frombuffer(label, np.int8), np.diff(np.append(self.first, len(window))))
        self.contexts = [self._distinct(self.window[side == y], np.frombuffer(context, np.uint32)[side == y]) for y in (0, 1)]

    def _distinct(self, window: np.ndarray, context: np.ndarray) -> np.ndarray:
        """How many different contexts each window has."""
        pairs = np.unique(window.astype(np.uint64) << np.uint64(32) | context)
        return np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(self.terms))

    def seeds(self) -> tuple[list[int], list[int]]:
        """Windows whose share of toxic contexts is beyond chance, and those of clean sentences, commonest first."""
        clean, toxic = self.contexts
        if not clean.sum() or not toxic.sum():
            return [], []
        n = np.maximum(clean + toxic, 1)
        base, share = toxic.sum() / (clean.sum() + toxic.sum()), toxic / n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = n * (np.where(toxic > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
        odd = (share > max(base, 0.6)) & (gain > np.log(len(self.terms)) + 3)
        order = sorted(range(len(self.terms)), key=self.terms.__getitem__)
        return sorted((k for k in order if odd[k]), key=lambda k: -toxic[k]), sorted((k for k in order if clean[k] and not odd[k]), key=lambda k: -clean[k])

    def loss(self, value: np.ndarray) -> float:
        """How badly the texts' calibrated worst values fit their labels (mean log loss)."""
        best = np.full(len(self.labels), value.min())
        np.maximum.at(best, self.owner, np.maximum.reduceat(value[self.window], self.first))
        p = np.clip(Logistic(best, self.labels.astype(np.float64))(best), 1e-9, 1 - 1e-9)
        return float(-np.where(self.labels == 1, np.log(p), np.log(1 - p)).mean())

    def worst(self, value: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
        """The windows of the sentences whose value is above 0 and of each text's worst sentence:
        {window: sentences} of toxic and of clean texts; ties go to what stands first."""
        of_window, ends = value[self.window], np.append(self.first, len(self.window))
        best = np.maximum.reduceat(of_window, self.first)
        order = np.lexsort((self.first, -best, self.owner))
        out: tuple[dict[int, int], dict[int, int]] = ({}, {})
        chosen = best > 0
        chosen[order[np.concatenate([[True], np.diff(self.owner[order]) > 0])]] = True
        for s in np.flatnonzero(chosen).tolist():
            k = int(self.window[self.first[s] + np.argmax(of_window[self.first[s] : ends[s + 1]])])
            side = out[1 - int(self.labels[self.owner[s]])]
            side[k] = side.get(k, 0) + 1
        return out


class ToxicityModel:
    """Learned from (text, label) pairs."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.weights: np.ndarray | None = None
        self.bias = 0.0
        self.prior = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        self.calibrate: Logistic | None = None
        rows = sorted(set(rows))
        sentences = Sentences(rows)
        odd, calm = sentences.seeds()
        if not odd or not calm:
            return
        terms, half = sentences.terms, LANDMARKS // 2
        toxic_marks = spread([features(terms[k]) for k in odd], half)
        # Feature maps are large: a thousand windows' at a time.
        calm = calm[:COMMON]
        near = np.concatenate([kernel([features(terms[k]) for k in calm[a : a + 1000]], toxic_marks).max(axis=1) for a in range(0, len(calm), 1000)])
        order = np.argsort(-near, kind="stable").tolist()
        first = [calm[k] for k in [*order[:NEAREST], *order[NEAREST::ONE_IN]]]
        marks = toxic_marks + spread([features(terms[k]) for k in first], half)
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        self._train(terms, {k: int(sentences.contexts[1][k]) for k in odd}, {k: int(sentences.contexts[0][k]) for k in first}, marks, root)
        clean: dict[int, int] = {}
        kept = []
        value = self.words(terms)
        for _ in range(ROUNDS):
            toxic, now = sentences.worst(value)
            clean = {**dict.fromkeys(clean, 1), **now}
            self._train(terms, toxic, clean, marks, root)
            value = self.words(terms)
            kept.append((sentences.loss(value), self.weights, self.bias))
        _, self.weights, self.bias = min(kept, key=lambda x: x[0])
        labels = np.array([y for _, y in rows], np.float64)
        texts = record(["text"], [pa.array([t for t, _ in rows], pa.string())])
        self.calibrate = Logistic(np.concatenate([self.texts(part.column("text")) for part in slices(texts, "text")]), labels)

    def _fold(self, marks: list[dict[int, float]], alpha: list[float]) -> None:
        """One weight per subsequence, from landmarks and their coefficients."""
        self.weights = np.zeros(_LETTERS**3)
        for own, a in zip(marks, alpha, strict=True):
            for u, v in own.items():
                self.weights[u] += a * v

    def _train(self, terms: list[str], toxic: dict[int, int], clean: dict[int, int], marks: list[dict[int, float]], root: np.ndarray) -> None:
        """One machine from the examples: a window for each sentence, with the number of these."""
        words, y, share = [], [], []
        for sign, side in ((1.0, toxic), (-1.0, clean)):
            for w, n in sorted((terms[k], n) for k, n in side.items()):
                forms = [w]
                if sign > 0 and len(w) < LONGEST:
                    forms += [w[:p] + "abcdefghijklmnopqrstuvwxyz"[crc32(f"{w}{p}".encode()) % 26] + w[p:] for p in range(1, len(w))]
                words += forms
                y += [sign] * len(forms)
                share += [n / len(forms)] * len(forms)
        signs, weight = np.array(y), np.array(share)
        for sign in (1.0, -1.0):  # either side weighs the same altogether
            weight[signs == sign] *= len(words) / 2 / weight[signs == sign].sum()
        x = np.concatenate([kernel([features(w) for w in words[a : a + 1000]], marks) for a in range(0, len(words), 1000)]) @ root
        w, self.bias = linear_svm(x, signs, weight)
        self._fold(marks, (root @ w).tolist())

    def words(self, words: list[str]) -> np.ndarray:
        """Decision values of words of SHORTEST to LONGEST letters; those without a shared gain get the bias."""
        out = np.full(len(words), self.bias)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            for part in np.array_split(at, -(-len(at) // WORDS_AT_ONCE)):
                ids, weights = subsequences(letter_codes([words[k] for k in part], n))
                gain = self.weights[ids] @ weights
                up = np.flatnonzero(gain > 0)
                if len(up):
                    out[part[up]] += gain[up] / norms(ids[up], weights)
        return out

    def _remembered(self, words: list[str]) -> np.ndarray:
        """The same as words(), with the values of up to REMEMBERED words kept in the process."""
        if not hasattr(self, "_known"):
            self._known: dict[str, float] = {}
        known = self._known
        out = np.array([known.get(w, np.nan) for w in words])
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            fresh = [words[k] for k in new]
            out[new] = self.words(fresh)
            for w, v in zip(fresh[: max(0, REMEMBERED - len(known))], out[new].tolist(), strict=False):
                known[w] = v
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def texts(self, column: pa.Array) -> np.ndarray:
        """The worst word's decision value of each text; the bias for texts without words."""
        words = Words(column)
        n = len(words.first) - 1
        bare = letters_of(words.distinct).dictionary_encode()
        terms = bare.dictionary.to_pylist()
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        value = np.full(len(terms), self.bias)
        fit = np.flatnonzero((sizes >= SHORTEST) & (sizes <= LONGEST))
        if len(fit):
            value[fit] = self._remembered([terms[k] for k in fit])
        for k in np.flatnonzero(sizes > LONGEST).tolist():  # a long run of letters: overlapping windows
            parts = [p for p in sorted(set(_windows(terms[k]))) if len(p) >= SHORTEST]
            value[k] = max([self.bias, *[self.words(parts[a : a + 5000]).max() for a in range(0, len(parts), 5000)]])
        of_word = bare.indices.to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        out = np.full(n, self.bias)
        full = np.flatnonzero(np.diff(words.first) > 0)
        if len(full):
            out[full] = np.maximum.reduceat(value[of_word], words.first[full])
            self._spelled(words, terms, sizes, of_word, out)
        return out

    def _spelled(self, words: Words, terms: list[str], sizes: np.ndarray, of_word: np.ndarray, out: np.ndarray) -> None:
        """Words spelled out: four or more single letters on end are read as one word."""
        row_of = np.repeat(np.arange(len(out)), np.diff(words.first))
        at = np.flatnonzero(sizes[of_word] == 1)
        if not len(at):
            return
        # A run ends where the next single letter isn't the next word or stands in another text.
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row_of[at]) > 0)])
        starts = np.flatnonzero(new)
        for k, n in zip(starts.tolist(), np.diff(np.append(starts, len(at))).tolist(), strict=True):
            if n >= 4:
                row = int(row_of[at[k]])
                run = "".join(terms[of_word[i]] for i in at[k : k + n].tolist())
                parts = [p for p in _windows(run) if len(p) >= SHORTEST]
                if parts:
                    out[row] = max(out[row], *self.words(parts).tolist())

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.calibrate is None:
            return np.full(len(column), self.prior)
        return self.calibrate(self.texts(column))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Learns from a bounded sample (labelled.SAMPLE_ROWS of each class, SAMPLE_CHARS characters) of the
    labels outside fold ``held`` of ``folds``; all words of all texts are scored. Null texts count as empty and get
    the score of a text without words; a null id is never held out; rows that repeat an id are
    scored each; without anything to learn every score is the share of toxic rows (0.5 without
    any); no documents give no rows; other columns are ignored. A text of any length is scored whole,
    in one worker (about 60 bytes a byte of it).
    """
    spark = session_of(docs)
    model = ToxicityModel(sample(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held))
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield record(["doc_id", "score"], [part.column("doc_id"), own.scores(part.column("text"))])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = chosen.mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns kept, whose text scores below the threshold. Each row is judged by its
    own text, so rows that share an id may part. Without both labels to learn from all rows stay."""
    spark = session_of(docs)
    model = ToxicityModel(sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0))
    sent = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield part if own.calibrate is None else part.filter(pa.array(own.scores(part.column("text")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
