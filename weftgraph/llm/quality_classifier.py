"""Operator 1: text quality from compressed sizes under two zstandard dictionaries.

One dictionary is built from good labelled texts, one from bad ones. A text is cut
into blocks, every block is compressed under both, and the normalised difference of
the summed sizes is mapped to a probability by logistic calibration on labelled
texts that neither dictionary has seen. The calibration also knows the text's length
and how far it compresses at all: a difference means less in a short text, and text
that repeats itself shrinks to nothing under either dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, carried_kind, slices, texts

BLOCK = 2048
LEVEL = 3
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration: p = sigmoid(features of the sizes . weights)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def probability(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(sizes) @ np.array(self.weights), -30, 30)))


def features(sizes: np.ndarray) -> np.ndarray:
    """Calibration inputs of rows (raw bytes, bytes under good, bytes under bad)."""
    raw, good, bad = sizes.T
    difference = np.where(raw > 0, (bad - good) / np.maximum(bad + good, 1), 0.0)
    shrunk = np.where(raw > 0, np.log(np.maximum(good, 1) / np.maximum(raw, 1)), 0.0)
    length = np.log1p(raw)
    return np.stack([np.ones_like(length), 10 * difference, difference * length, shrunk, shrunk**2, length / 10], axis=1)


class Sizer:
    """Compressed sizes of texts under the two dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for raw in (good, bad):
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
            else:
                d = None
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def sizes(self, text: str) -> tuple[int, int, int]:
        """Bytes of the text, and of its compressed blocks under the good and the bad dictionary."""
        raw = text.encode("utf-8", "replace")
        good = bad = 0
        for i in range(0, len(raw), BLOCK):
            block = raw[i : i + BLOCK]
            good += len(self.compressors[0].compress(block))
            bad += len(self.compressors[1].compress(block))
        return len(raw), good, bad

    def all_sizes(self, several: list[str]) -> np.ndarray:
        return np.array([self.sizes(t) for t in several], dtype=float).reshape(-1, 3)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    blocks = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their plain content serves as the dictionary
        return b"".join(blocks)[-size:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by damped Newton steps with a small ridge."""
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 1500, max_chars: int = 8_000_000, dictionary_bytes: int = 112_640) -> Model:
    """Fits a model on a bounded sample of labelled rows.

    labels: (doc_id, quality), already without held-out rows. Of each class the
    max_rows ids with the least hash are taken, and of their texts as many as come
    to max_chars; both bounds hold at every input size, so what reaches the driver
    has a fixed bound. Every other row of the sample builds the dictionaries, the
    rest calibrates, weighted to the classes' shares among all labels.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(max_rows).collect()]
    if not chosen:
        return Model(b"", b"", (0.0,) * 6)
    ids = spark.createDataFrame(chosen, known.schema).dropDuplicates(["doc_id"])
    running = Window.partitionBy("quality").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")  # at most 2 * max_rows ids
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(running), F.lit(0)))
        .where((F.col("before") + F.length("text") <= max_chars) | (F.col("before") == 0) & (F.length("text") <= 4 * max_chars))
        .select("quality", "text")
        .collect()
    )
    by_class = {q: [r["text"] for r in rows if r["quality"] == q and r["text"]] for q in (0, 1)}
    raw = {q: [t.encode("utf-8", "replace") for t in by_class[q][::2]] for q in (0, 1)}
    good, bad = _dictionary(raw[1], dictionary_bytes), _dictionary(raw[0], dictionary_bytes)
    sizer = Sizer(good, bad)
    rest = {q: sizer.all_sizes(by_class[q][1::2]) for q in (0, 1)}
    if not (len(rest[0]) and len(rest[1])):
        p = (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)
        return Model(good, bad, (math.log(p / (1 - p)), *(0.0,) * 5))
    x, y = features(np.concatenate([rest[0], rest[1]])), np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y == 1, share[1] / len(rest[1]), share[0] / len(rest[0]))
    return Model(good, bad, _calibrate(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """Scores every row of docs by its whole text: (doc_id, score, predicted).

    With columns to carry there are also text and a struct of these columns, named row.

    score is the calibrated probability of quality 1; predicted is 1 from threshold
    on. Null and empty texts have sizes 0, so they get the calibration's value there. One row out for each row in, repeated rows included; only doc_id and
    text are read, so further columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            p = np.round(model.probability(sizer.all_sizes(texts(batch.column(1)))), 6)
            more = list(range(1, batch.num_columns)) if carry else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(batch.column(k) for k in more)],
                names=["doc_id", "score", "predicted", *(batch.schema.names[k] for k in more)],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", *carried(docs, carry))
    return read.mapInArrow(run, f"doc_id {kind}, score double, predicted int" + (", text string" if carry else "") + carried_kind(read))
