"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with either dictionary in blocks of BLOCK bytes, each by itself, so that a
long text's own history doesn't drown the dictionaries. The difference of the two compressed
sizes over the raw size, with the better of the two ratios, becomes a calibrated score.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import record, session_of, slices, text_bytes
from notelake.llm.labelled import Logistic, fold, sample

BLOCK = 2048
DICTIONARY = 96 << 10
LEVEL = 3
THRESHOLD = 0.7


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves, shortest last, where they are too few to train on."""
    blocks = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    random.Random(5).shuffle(blocks)
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[-DICTIONARY:] or b"\n" * 8


class QualityModel:
    """Learned from (text, label) pairs; one fifth of them calibrate and aren't in a dictionary."""

    def __init__(self, rows: list[tuple[str, int]]):
        pool = [(t.encode(), y) for t, y in rows]
        random.Random(3).shuffle(pool)
        self.good = _dictionary([t for k, (t, y) in enumerate(pool) if y and k % 5])
        self.bad = _dictionary([t for k, (t, y) in enumerate(pool) if not y and k % 5])
        held = [x for k, x in enumerate(pool) if k % 5 == 0] or pool
        y = np.array([label for _, label in held], np.float64)
        self.prior = (float(sum(label for _, label in pool)) + 1) / (len(pool) + 2)
        self.calibrate = Logistic(np.array([self.features(t) for t, _ in held]).reshape(-1, 2), y) if len(set(y.tolist())) == 2 else None

    def _tools(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            made = []
            for raw in (self.good, self.bad):
                own = zstandard.ZstdCompressionDict(raw)
                own.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=own, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._made = made[0], made[1]
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, text: bytes) -> tuple[float, float]:
        """(normalised size difference, better ratio); zeros for an empty text."""
        if not text:
            return 0.0, 0.0
        good, bad = self._tools()
        a = b = 0
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - a) / len(text), min(a, b) / len(text)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.calibrate(features) if self.calibrate else np.full(len(features), self.prior)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, size_difference) of every document.

    Learns from a bounded sample (labelled.SAMPLE_ROWS of each class) of the labels outside fold
    ``held`` of ``folds``. Null texts count as empty and get a score like others; a null id is
    never held out; rows that repeat an id are scored each; without both labels every score is
    the share of good rows (0.5 without any); no documents give no rows; other columns are ignored. A text of any length is
    compressed whole, block by block.
    """
    spark = session_of(docs)
    model = QualityModel(sample(docs, labels, "quality", fold(F.col("doc_id"), folds) != held))
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                raw = data.tobytes()
                found = np.array([own.features(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]).reshape(-1, 2)
                yield record(["doc_id", "score", "size_difference"], [part.column("doc_id"), own.scores(found), found[:, 0].copy()])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = chosen.mapInArrow(score, "doc_id long, score double, size_difference double")
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "size_difference")
