"""Quality score by compression: does a text compress better with a dictionary of good or of bad text?

zstandard dictionaries are built from a bounded sample of labelled good and bad texts (at most ``per_label`` documents of
each label, those with the lowest hash of their id; of them half build the dictionaries and half calibrate). A text is
compressed in pieces of ``PIECE`` bytes (every piece of the whole text; so short that a piece finds little to repeat in
itself and the dictionary decides) with either dictionary; the difference of the two
total sizes over their sum is the raw score, and a logistic curve fitted on the calibration half turns it into the
probability of label 1.

The bound is one on rows: whole texts of any length are learned from and scored. Defined results: null and empty texts
have no difference and get the curve's value at 0; without labels of both kinds the score is the share of label 1 among
those learned from (0.5 without any); rows with a null label, id or text are never learned from; a document with several
labels counts once for each, one with several texts is learned from by the least of them, and equal labels count once;
repeated rows are each scored; an empty table gives an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LABEL, PIECE, DICTIONARY, LEVEL = 600, 128, 48 << 10, 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    at_zero: float

    def score(self, raw: np.ndarray) -> np.ndarray:
        """``raw``: the difference of each text."""
        return 1 / (1 + np.exp(-np.clip(raw * self.slope + self.at_zero, -30, 30)))


class Measure:
    """Normalised difference of the compressed sizes of whole texts."""

    def __init__(self, good: bytes, bad: bytes):
        def compressor(data: bytes) -> zstandard.ZstdCompressor:
            kept = zstandard.ZstdCompressionDict(data)
            kept.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.by = (compressor(good), compressor(bad)) if good and bad else None

    def __call__(self, text: str | None) -> float:
        if not text or not self.by:
            return 0.0
        data = text.encode()
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.by)
        return (bad - good) / (bad + good)


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of the texts; raw text where there is too little to train one."""
    pieces = [data[i : i + PIECE] for t in texts if (data := t.encode()) for i in range(0, len(data), PIECE)]
    total = sum(map(len, pieces))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY, total // 6)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:].rjust(8, b" ")


def calibrated(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a weak prior."""
    x, w, prior = np.stack([raw, np.ones(len(raw))], axis=1), np.zeros(2), np.array([1e-4, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        step = np.linalg.solve(h, x.T @ (label - p) - prior * w)
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def sampled(documents: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(quality, h, text): for each label the documents of the lowest hashes of their ids, ``2 * per_label`` at most.

    A threshold on the hash, by the estimated number of documents of a label, lets through twice as many on the average:
    so labels are cut where they are read, and only what is left is put in order, however many there are.
    """
    known = labels.select("doc_id", "quality", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    sizes = {r.quality: max(1, r.n) for r in known.groupBy("quality").agg(F.approx_count_distinct("h").alias("n")).collect()}
    low, span = -(1 << 63), 1 << 64
    limit = reduce(lambda c, q: c.when(F.col("quality") == q, F.lit(min((1 << 63) - 1, low + span * 4 * per_label // sizes[q]))), sizes, F.when(F.lit(False), F.lit(low)))
    place = F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))  # of about 4 * per_label ids
    ids = known.where(F.col("h") <= limit).distinct().withColumn("place", place).where(F.col("place") <= 2 * per_label).drop("place")
    texts = documents.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(ids), "doc_id")  # the bound is per_label's
    return texts.groupBy("quality", "h", "doc_id").agg(F.min("text").alias("text")).select("quality", "h", "text")


def fit(documents: DataFrame, labels: DataFrame, learn: Column, per_label: int = PER_LABEL) -> Model:
    """A model from the rows of ``labels`` (doc_id, quality) for which ``learn`` holds and their texts."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(learn).select("doc_id", "quality")
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(b"", b"", 0.0, 0.0)
    share = sizes.get(1, 0) / sum(sizes.values())
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(sizes) < 2:
        return Model(b"", b"", 0.0, prior)
    rows = sorted(sampled(documents, known, per_label).collect(), key=lambda r: (r.h, r.text))
    texts = {q: [r.text for r in rows if r.quality == q][:per_label] for q in (0, 1)}
    good, bad = dictionary(texts[1][::2]), dictionary(texts[0][::2])
    measure, rest = Measure(good, bad), [(t, q) for q in (0, 1) for t in texts[q][1::2]]
    raw, label = np.array([measure(t) for t, _ in rest]), np.array([float(q) for _, q in rest])
    if not good or not bad or len({*label}) < 2:
        return Model(b"", b"", 0.0, prior)
    slope, at_zero = calibrated(raw, label)
    drawn = label.mean()  # the sample is balanced; the corpus is not
    return Model(good, bad, slope, float(at_zero + prior - np.log(drawn / (1 - drawn))))


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        measure = Measure(model.good, model.bad)
        for batch in batches:
            raw = np.array([measure(t.as_py()) for t in batch.column(2)], float)
            score = model.score(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(raw)], names=["doc_id", "held_out", "score", "predicted", "size_difference"])

    return run


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted and the raw size_difference of each row of ``documents`` (doc_id, text)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_scorer(sent), f"doc_id {kind}, held_out boolean, score double, predicted int, size_difference double")
