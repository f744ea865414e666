"""Packing: vector bin packing of token pieces into sequences of a fixed length.

Each example has three sizes: tokens, segments and loss-bearing tokens. A sequence is filled by
the dot-product heuristic: of the examples that still fit all three limits, the one whose size
vector has the largest inner product with what the sequence has left, each dimension weighted by
how scarce it is among the waiting examples. What is left over at the end is filled by cutting an
example, and a sequence that stays short is cut into sequences whose lengths are powers of two,
which need no padding.

Every task packs the rows it reads, so nothing is shuffled; a task's last sequences are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import record, session_of, slices
from notelake.llm.tokens import crc, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Packer:
    """Fills sequences from a pool of waiting pieces.

    A piece is (example, start, length, loss). A piece's loss-bearing tokens are its last
    ``loss`` ones (in instruction data the answer follows the prompt). ``take()`` gives the finished
    sequences, each a list of pieces in order.
    """

    def __init__(self, limits: Limits, pool: int = 256):
        self.limits, self.pool = limits, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.waiting: list[tuple[int, int, int, int]] = []
        self.size = np.zeros((0, 3))
        self.done: list[list[tuple[int, int, int, int]]] = []

    def add(self, pieces: list[tuple[int, int, int, int]]) -> None:
        self.done += [[p] for p in pieces if p[2] == self.limits.tokens]  # nothing else fits with these
        pieces = [p for p in pieces if p[2] != self.limits.tokens]
        self.waiting += pieces
        self.size = np.concatenate([self.size, np.array([(p[2], 1, p[3]) for p in pieces], np.float64).reshape(-1, 3)])
        while len(self.waiting) >= self.pool:
            self._fill()

    def finish(self) -> None:
        while self.waiting:
            self._fill()

    def take(self) -> list[list[tuple[int, int, int, int]]]:
        out, self.done = self.done, []
        return out

    def _fill(self) -> None:
        """Makes one sequence of waiting pieces."""
        share = self.size.mean(axis=0) / self.most
        weighted = self.size / self.most * (share / max(share.sum(), 1e-12))
        left, free, chosen = self.most.copy(), np.ones(len(self.size), bool), []
        while True:
            fits = free & (self.size <= left).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, weighted @ (left / self.most), -1.0)))
            chosen.append(self.waiting[k])
            free[k] = False
            left -= self.size[k]
        rest, size = [p for p, stays in zip(self.waiting, free.tolist(), strict=True) if stays], self.size[free]
        if left[0] > 0 and left[1] > 0 and rest:  # cut one to fill what is left
            for k, (example, start, length, loss) in enumerate(rest):
                room = min(int(left[0]), length)
                # The head bears what the tail, the last part, does not.
                head_loss = max(0, loss - (length - room))
                if head_loss <= left[2]:
                    chosen.append((example, start, room, head_loss))
                    left -= (room, 1, head_loss)
                    if room < length:
                        rest[k] = (example, start + room, length - room, loss - head_loss)
                        size[k] = length - room, 1, loss - head_loss
                    else:
                        del rest[k]
                        size = np.delete(size, k, axis=0)
                    break
        self.waiting, self.size = rest, size
        total = sum(p[2] for p in chosen)
        if total == self.limits.tokens:
            self.done.append(chosen)
        else:
            self.done += powers_of_two(chosen)


def powers_of_two(pieces: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """The pieces dealt to sequences whose lengths are the powers of two in their total."""
    total = sum(p[2] for p in pieces)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, queue = [], list(reversed(pieces))
    for room in sizes:
        own = []
        while room:
            example, start, length, loss = queue.pop()
            used = min(room, length)
            tail = length - used
            head_loss = max(0, loss - tail)
            own.append((example, start, used, head_loss))
            if tail:
                queue.append((example, start + used, tail, loss - head_loss))
            room -= used
        out.append(own)
    return out


def cut(example: int, n: int, loss: int, limits: Limits) -> Iterator[tuple[int, int, int, int]]:
    """An example of n tokens in pieces that each fit a sequence by themselves."""
    step = min(limits.tokens, limits.loss) if loss else limits.tokens
    for start in range(0, n, step):
        length = min(step, n - start)
        yield example, start, length, min(length, max(0, start + length - (n - loss)))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    limits: Limits | None = None,
    prompt_tokens_col: str | None = None,
    with_ids: bool = False,
    slice_mb: int = 8,
    pieces_kept: int = 600_000,
) -> DataFrame:
    """Pieces of all documents, each with its place in a packed sequence.

    Returns SCHEMA, and the column ``ids`` (array of int) if ``with_ids``. ``start`` counts the
    document's ids before the piece, ``offset`` those before it in its sequence. ``sequence_id``
    is the task's number above the task's own count. Every id lies in exactly one piece.

    With ``prompt_tokens_col`` the first so many ids of a document bear no loss; without it, all
    do. Null texts count as empty (the end id alone); null ids stay null; repeated rows are packed
    each; no rows give no pieces; other columns are ignored. A text of any length is cut.
    ``slice_mb`` and ``pieces_kept`` trade a worker's memory for speed.
    """
    session_of(docs, 2 * slice_mb)
    limits = limits or Limits()
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(prompt_tokens_col).cast("long") if prompt_tokens_col else F.lit(0).cast("long")).alias("prompt")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path, pieces=pieces_kept), Packer(limits)
        sequence = TaskContext.get().partitionId() << 36
        held: dict[int, tuple[int | None, np.ndarray, int]] = {}  # examples with pieces that wait
        serial = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            for pieces in packer.take():
                offset = 0
                for example, start, length, loss in pieces:
                    doc, ids, left = held[example]
                    part = ids[start : start + length]
                    rows.append((doc, start, length, crc(part), len(ids), loss, sequence, offset, part))
                    offset += length
                    if left == length:
                        del held[example]
                    else:
                        held[example] = doc, ids, left - length
                sequence += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                arrays = [pa.array(c, pa.int64()) for c in cols[:8]]
                if with_ids:
                    at = np.zeros(len(rows) + 1, np.int32)
                    np.cumsum([len(x) for x in cols[8]], out=at[1:])
                    arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cols[8]).astype(np.int32))))
                    names.append("ids")
                yield record(names, arrays)

        for batch in batches:
            for part in slices(batch, "text", slice_mb << 20):
                ids, offsets = enc.encode(part.column("text"), end_id)
                prompts = part.column("prompt").fill_null(0).to_pylist()
                pieces: list[tuple[int, int, int, int]] = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = ids[offsets[i] : offsets[i + 1]]
                    held[serial] = doc, own, len(own)
                    pieces += cut(serial, len(own), max(0, len(own) - max(0, prompts[i])), limits)
                    serial += 1
                for at in range(0, len(pieces), packer.pool):
                    packer.add(pieces[at : at + packer.pool])
                # A slice's ids are held no longer than pieces of it wait: copy those few.
                yield from packed()
                for k, (doc, own, left) in held.items():
                    if own.base is not None:
                        held[k] = doc, own.copy(), left
        packer.finish()
        yield from packed()

    return chosen.mapInArrow(pack, SCHEMA + (", ids array<int>" if with_ids else ""))
