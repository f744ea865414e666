"""Token counts by rank-synchronous merging of byte pairs in arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. The bytes of many pre-tokens stand in one
ragged array of symbols; in each round every pre-token applies its own lowest-ranked pair, wherever
it occurs in it, all pre-tokens at once. What has no pair left is done, and its symbols are counted.

That equals merging one pair after another, as a pair can only hold a symbol that a lower-ranked
merge made; a vocabulary for which that doesn't hold is refused. Only ids' number is computed, so
no text of ids is ever made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import _SPACE, record, session_of, sign_starts, slices, strings, text_bytes

#: White space as the vocabulary's pattern sees it, and the pattern (fixed values).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

#: White space outside ASCII, next to which a text can't be cut where white space begins.
_OTHER_WHITE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Pieces of text kept with their counts between batches, and their longest.
CACHE_PIECES, CACHE_CHARS = 500_000, 40

#: Pre-tokens of more bytes are merged one by one, rank by rank, so that the others' rounds are few.
LONG = 128

_NONE = np.int32(2**31 - 1)


class BytePairs:
    """A byte-level vocabulary's merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, pre = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not told["normalizer"]
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level pair vocabularies without a normaliser are supported")
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain strings")
        self.added = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank_of = np.full(max(vocab.values()) + 1, -1, np.int64)
        rank_of[self.made] = np.arange(len(pairs))
        ranks = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (rank_of[left] >= ranks).any() or (rank_of[right] >= ranks).any():
            raise ValueError("a merge must come after those that make its parts")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order].astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; _NONE for those that never merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence of bytes ``data[offsets[k]:offsets[k + 1]]``."""
        size = np.diff(offsets)
        out = size.copy()
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self._count_long(data[offsets[k] : offsets[k + 1]])
        own = np.flatnonzero((size > 1) & (size <= LONG))
        taken = np.repeat((size > 1) & (size <= LONG), size)
        ids, size = self.byte_ids[data[taken]], size[own]
        if not len(own):
            return out
        rank = np.full(len(ids), _NONE)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = _NONE  # a sequence's last symbol has no pair
        while True:
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            live = least != _NONE
            if not live.all():
                out[own[~live]] = size[~live]
                kept = np.repeat(live, size)
                ids, rank, own, size, least = ids[kept], rank[kept], own[live], size[live], least[live]
            if not len(own):
                return out
            at = every_other(np.flatnonzero(rank == np.repeat(least, size)))
            ids[at] = self.made[rank[at]]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            size = size - np.bincount(np.searchsorted(np.cumsum(size), at, side="right"), minlength=len(size))
            ids, rank = ids[kept], rank[kept]
            at -= np.arange(len(at))  # each merge before has taken one symbol away
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[near] = self.rank(ids[near], ids[np.minimum(near + 1, len(ids) - 1)])
            rank[np.cumsum(size) - 1] = _NONE

    def _count_long(self, data: np.ndarray) -> int:
        """The same for one long sequence. Symbols are linked and wait by rank, so that a round
        touches only what it merges."""
        n = len(data)
        ids = np.append(self.byte_ids[data], np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(at: np.ndarray) -> None:
            rank[at] = self.rank(ids[at], ids[after[at]])
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            edges = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, edges) if len(at) else []:
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        wait(np.arange(n))
        left = n
        while order:
            r = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            at = every_other(at, after)
            gone = after[at]
            ids[at], rank[gone] = self.made[r], _NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            near = before[at]
            wait(np.unique(np.concatenate([at, near[near >= 0]])))
        return left


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: its own where that is
    printable, the others from code point 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def every_other(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Places without those whose symbol a merge just before takes: of places on end the first, the
    third and so on. ``after`` names the place that follows each."""
    if len(at) < 2:
        return at
    begins = np.append(True, at[1:] != (at[:-1] + 1 if after is None else after[at[:-1]]))
    first = np.flatnonzero(begins)
    return at[(np.arange(len(at)) - first[np.cumsum(begins) - 1]) % 2 == 0]


class Counter:
    """Counts of whole columns; each distinct piece of text is counted once."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        self.pairs, self.most = BytePairs(path), pieces
        self.pattern = regex.compile(PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, self.pairs.added)) or r"(?!)")
        self.cache: dict[str, int] = {}

    def texts(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text. An added token's string counts as that token."""
        between = [self.added.split(t) for t in texts]
        own = self._plain(list(chain.from_iterable(between)))
        ends = np.cumsum([0, *map(len, between)])
        total = np.append(0, np.cumsum(own))
        return total[ends[1:]] - total[ends[:-1]] + np.diff(ends) - 1

    def _plain(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text without added tokens: its pre-tokens, each distinct one merged once."""
        parts = list(map(self.pattern.findall, texts))
        flat = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
        each = self.pairs.count(*text_bytes(flat.dictionary))[flat.indices.to_numpy(zero_copy_only=False)]
        total = np.append(0, np.cumsum(each))
        ends = np.cumsum([0, *map(len, parts)])
        return total[ends[1:]] - total[ends[:-1]]

    def column(self, column: pa.Array) -> np.ndarray:
        """The tokens of each row; null counts as empty.

        The pattern never joins what stands before white space, or before a sign after a letter,
        with what follows; so texts are cut there, and pieces that repeat are counted once. Texts
        with other white space or an added token's string are counted whole.
        """
        column = pc.fill_null(column, "")
        whole = pc.match_substring_regex(column, _OTHER_WHITE)
        for token in self.pairs.added:
            whole = pc.or_(whole, pc.match_substring(column, token))
        whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        data, offsets = text_bytes(column)
        cut = _SPACE[data]
        cut[1:] &= ~_SPACE[data[:-1]]
        cut |= sign_starts(data)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        places = np.append(np.flatnonzero(cut), len(data))
        encoded = strings(data, places).dictionary_encode()
        first = np.searchsorted(places[:-1], offsets)
        each = self._pieces(encoded.dictionary.to_pylist())[encoded.indices.to_numpy(zero_copy_only=False)]
        total = np.append(0, np.cumsum(each))
        out = total[first[1:]] - total[first[:-1]]
        if len(whole):
            out[whole] = self.texts(column.take(pa.array(whole)).to_pylist())
        return out

    def _pieces(self, distinct: list[str]) -> np.ndarray:
        known = [self.cache.get(x, -1) for x in distinct]
        out = np.array(known, np.int64)
        missing = np.flatnonzero(out < 0)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            own = [distinct[k] for k in part.tolist()]
            out[part] = self._plain(own)
            for text, n in zip(own, out[part].tolist(), strict=True):
                if len(self.cache) >= self.most:
                    break
                if len(text) <= CACHE_CHARS:
                    self.cache[text] = n
        return out


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process; that of another vocabulary makes room."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row: its text's UTF-8 bytes and tokens, without begin and
    end tokens, truncation or padding.

    A null text counts as empty, with no bytes and no tokens; a text of any length is counted whole.
    Rows that repeat an id count one by one, a null id stays null. Only the id and the text are
    read, so other columns' names don't matter. Nothing is shuffled. The vocabulary file must be at
    the same path on every machine.
    """
    session_of(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield record(["doc_id", "n_bytes", "n_tokens"], [part.column("doc_id"), size, counter(vocabulary_path).column(part.column("text"))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
