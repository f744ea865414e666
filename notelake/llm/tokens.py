"""Whole-column encoding with the tokenizers library, each distinct piece of text encoded once.

Both vocabularies here split a text before they merge, and never join what stands before a run
of white space with what stands after it. A text is therefore cut where white space begins, the
distinct pieces are encoded, and the ids are put back in order: the same ids as for the whole
text. They also part letters from a sign such as a full stop after them, so a cut is made there
too: a word is one piece whatever sign follows it. Texts with white space outside ASCII, where that cut could differ, are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from notelake.llm.common import _SPACE, Words, sign_starts, strings, text_bytes

#: White space outside ASCII, and separators that some patterns count as such (fixed values).
_OTHER_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

#: Pieces kept with their ids between batches; about 200 bytes each.
CACHE_PIECES = 600_000

#: What parts words that are encoded together.
_MARK = "~"

_loaded: dict[tuple[str, bool, int], ColumnEncoder] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ColumnEncoder:
    """Ids of string columns. Special tokens' strings inside a text are ordinary text."""

    def __init__(self, path: str, folds: bool = False, pieces: int = CACHE_PIECES):
        """``pieces``: how many pieces to keep with their ids. ``folds``: the vocabulary lowers its input and drops white space, so that words alone,
        with A-Z lowered, have the same ids."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.folds, self.pieces = folds, pieces
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of many words at once: a mark of one id stands between words, and no word holds it."""
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(mark) != 1 or any(_MARK in w for w in words):
            return self._ids(words)
        joined = [f" {_MARK} ".join([*words[at : at + 1000], ""]) for at in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        at = np.flatnonzero(ids == mark[0])
        raw = ids.tobytes()
        starts = [0, *((at[:-1] + 1) * 4).tolist()]
        return [raw[a:b] for a, b in zip(starts, (at * 4).tolist(), strict=True)]

    def _pieces(self, distinct: list[str]) -> list[bytes]:
        cache = self.cache
        out = [cache.get(x) for x in distinct]
        missing = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            own = [distinct[k] for k in part]
            for k, ids in zip(part, self._word_ids(own) if self.folds else self._ids(own), strict=True):
                out[k] = ids
                if len(cache) < self.pieces and len(distinct[k]) <= 40:
                    cache[distinct[k]] = ids
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of row i, ``end_id`` last, are ``ids[offsets[i]:offsets[i + 1]]``."""
        codes, distinct, first = self._cut(column)
        n = len(first) - 1
        pieces = self._pieces(distinct.to_pylist())
        pieces.append(array("I", [end_id]).tobytes())
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        start = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(size, out=start[1:])
        pool = pa.LargeListArray.from_arrays(pa.array(start), pa.array(np.frombuffer(b"".join(pieces), np.uint32)))
        # The end id is a piece of its own that follows each row's pieces.
        row = np.repeat(np.arange(n), np.diff(first))
        order = np.full(len(codes) + n, len(pieces) - 1, np.int32)
        order[np.arange(len(codes)) + row] = codes
        taken = pool.take(pa.array(order))
        ids = taken.values.to_numpy(zero_copy_only=False)
        ends = first[1:] + np.arange(1, n + 1)
        offsets = np.concatenate([[0], taken.offsets.to_numpy()[ends]])
        whole = {i: np.frombuffer(self._ids([column[i].as_py()])[0], np.uint32) for i in self._odd(column)}
        if whole:
            end = np.array([end_id], np.uint32)
            parts = [np.concatenate([whole[i], end]) if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(n)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(codes, distinct, first): the pieces of row i are ``distinct[codes[first[i]:first[i + 1]]]``."""
        if self.folds:
            words = Words(column, signs=True)
            return words.codes, words.distinct, words.first
        data, offsets = text_bytes(column)
        space = _SPACE[data]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= sign_starts(data)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        places = np.append(np.flatnonzero(cut), len(data))
        encoded = strings(data, places).dictionary_encode()
        return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, np.searchsorted(places[:-1], offsets)

    def _odd(self, column: pa.Array) -> list[int]:
        found = pc.fill_null(pc.match_substring_regex(column, _OTHER_SPACE), False)
        return np.flatnonzero(found.to_numpy(zero_copy_only=False)).tolist()


def encoder(path: str, folds: bool = False, pieces: int = CACHE_PIECES) -> ColumnEncoder:
    """One encoder for each worker process: that of another vocabulary or size makes room."""
    key = path, folds, pieces
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ColumnEncoder(path, folds, pieces)
    return _loaded[key]


def forget() -> None:
    """Drops the process's encoder, so that an idle worker doesn't hold its pieces."""
    _loaded.clear()


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
