"""Language identification: the family first, then the language within it, by one-versus-one linear SVMs.

Features are hashed byte n-grams (1 to 3 bytes) of the lower-cased text with everything but letters turned into blanks,
as shares of the text. Linear models over shares need no histogram to predict: a text's margin is the mean of its
n-grams' weights, so whole texts of any length are scored by gathers and sums in one pass.

The fit learns every labelled language, from at most ``per_language`` documents of each and about ``in_all`` together
(never under ``LEAST`` of a language), those with the lowest hash of id and text (repeated rows count once); the bounds
are parameters, they hold before anything is collected, and the sample's feature vectors (24 KB each) are all that
reaches the driver. Languages outside ``FAMILIES`` are families of their own. A linear SVM (squared hinge, L2) is fitted for each pair of families and for each pair of
languages within a family; the most votes win, then the larger sum of margins. The score is the least probability of
the winner against a rival, at either level, by logistic scaling of the margins.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything when there is
nothing to learn from; with one language learned, that one has score 1. Of equal votes and sums the language that comes
first by name wins. Null or repeated ids and rows are kept as rows; an empty table gives an empty result; a text is read
whole, whatever its length; columns beyond the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import blocks, lowered

ORDERS, DIM = (1, 2, 3), 2048
PER_LANGUAGE, IN_ALL, LEAST = 400, 8000, 20
#: Language families by ISO 639-1 code.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "sk": "slavic", "bg": "slavic", "hr": "slavic",
    "hi": "indic", "bn": "indic", "mr": "indic", "fi": "uralic", "hu": "uralic", "et": "uralic",
}

_LETTERS = lowered()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def _slots(buf: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-gram that starts at each byte."""
    code = np.zeros(max(0, len(buf) - order + 1), np.uint32)
    for j in range(order):
        code = code * np.uint32(257) + buf[j : j + len(code)]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(32 - DIM.bit_length() + 1)).astype(np.int32)


def _per_text(values: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the values, and their number, over the n-grams that lie in each text."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    a = np.minimum(offsets[:-1], len(values))
    b = np.clip(offsets[1:] - order + 1, a, len(values))
    return sums[b] - sums[a], b - a


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = []
        for lo, hi, buf, offsets in blocks(batch.column(2)):
            for i in range(hi - lo):
                own = _LETTERS[buf[offsets[i] : offsets[i + 1]]]
                parts = [np.bincount(_slots(own, k), minlength=DIM) / max(1, len(own) - k + 1) for k in ORDERS]
                vectors.append(np.concatenate(parts).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["h", "lang", "vector"])


@dataclass
class Model:
    languages: list[str]
    #: (level, winner if positive, winner if negative)
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray  # pairs x (orders * DIM)
    bias: np.ndarray
    scale: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from margins (pairs x texts)."""
        n = margins.shape[1]
        at = {p: i for i, p in enumerate(self.pairs)}

        def vote(level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes, total, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.ones((len(names), n))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                k = at[level, a, b]
                m = margins[k]
                votes[i] += m >= 0
                votes[j] += m < 0
                total[i] += m
                total[j] -= m
                p = 1 / (1 + np.exp(-np.clip(self.scale[k] * m, -30, 30)))
                least[i], least[j] = np.minimum(least[i], p), np.minimum(least[j], 1 - p)
            best = np.lexsort((np.arange(len(names))[:, None].repeat(n, 1), -total, -votes), axis=0)[0]
            return best, least[best, np.arange(n)]

        families = sorted({family(x) for x in self.languages})
        f, score = vote("", families)
        lang = np.empty(n, object)
        for i, name in enumerate(families):
            own = sorted(x for x in self.languages if family(x) == name)
            here = f == i
            best, p = vote(name, own)
            lang[here] = np.array(own, object)[best[here]]
            score[here] = np.minimum(score[here], p[here])
        return lang.tolist(), score


def family(lang: str) -> str:
    return FAMILIES.get(lang, f"only {lang}")


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM with balanced classes, by accelerated gradient steps; ``y`` is +1 or -1."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)  # one type, so that no product converts the matrix again
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    top, v = 0.0, np.ones(x1.shape[1], x1.dtype)
    for _ in range(15):  # the largest curvature
        v = x1.T @ (weight * (x1 @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (1 + 2 * top * 1.1)
    w = np.zeros(x1.shape[1])
    u = w.copy()
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (x1 @ u))
        new = u - step * (u - 2 * (x1.T @ (weight * y * gap)))
        u, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def sampled(train: DataFrame, per_language: int, in_all: int = IN_ALL) -> DataFrame:
    """(h, lang, text): of each language the ``per_language`` rows with the lowest hash of id and text, or all it has."""
    own = train.where("lang is not null and text is not null").select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "lang", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    lowest = own.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_language)
    share = F.greatest(F.lit(LEAST), F.floor(F.lit(in_all) / F.count("*").over(Window.partitionBy())))
    last = lowest.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("h"))  # at most per_language hashes a language
    last = last.select("lang", F.element_at("h", F.least(F.size("h"), share.cast("int"))).alias("last"))
    return own.join(F.broadcast(last), "lang").where("h <= last").groupBy("h", "lang").agg(F.min("text").alias("text"))


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model | None:
    """A model from ``train`` (doc_id, text, lang); None if it has no labelled text."""
    rows = sampled(train, per_language, in_all).mapInArrow(_features, "h long, lang string, vector binary").collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.vector)):
        kept.setdefault(r.lang, []).append(np.frombuffer(r.vector, np.float32))
    languages = sorted(kept)
    x = np.array([v for k in languages for v in kept[k]], np.float32)
    lang = np.array([k for k in languages for _ in kept[k]], object)
    if not len(x):
        return None
    spread = x.std(axis=0) + 1e-4
    x /= spread
    families = sorted({family(k) for k in languages})
    pairs = [("", a, b) for a, b in combinations(families, 2)]
    pairs += [(f, a, b) for f in families for a, b in combinations(sorted(k for k in languages if family(k) == f), 2)]
    names = {"": np.array([family(k) for k in lang], object)}
    weights, bias, scale = [], [], []
    for level, a, b in pairs:
        of = names.get(level, lang)
        at = np.flatnonzero((of == a) | (of == b))
        y = np.where(of[at] == a, 1.0, -1.0)
        w, c = linear_svm(x[at], y)
        m = x[at] @ w + c
        grid = np.array([0.5, 1, 2, 4, 8])
        loss = [np.logaddexp(0, -g * y * m).mean() + 0.002 * g for g in grid]
        weights.append(w / spread), bias.append(c), scale.append(grid[int(np.argmin(loss))])
    return Model(languages, pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1]), np.array(bias), np.array(scale))


def _predictor(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for lo, hi, buf, offsets in blocks(batch.column(2)):
                letters = pa.compute.match_substring_regex(batch.column(2).slice(lo, hi - lo).fill_null(""), r"\p{L}").to_pylist()
                if model is None:
                    langs += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                own, margins = _LETTERS[buf], np.repeat(model.bias[:, None], hi - lo, axis=1)
                for j, k in enumerate(ORDERS):
                    slots = _slots(own, k)
                    for i in range(len(model.pairs)):
                        sums, n = _per_text(model.weights[i, j * DIM : (j + 1) * DIM][slots], offsets, k)
                        margins[i] += sums / np.maximum(1, n)
                lang, score = model.decide(margins)
                langs += [a if ok else "und" for a, ok in zip(lang, letters, strict=True)]
                scores += [float(p) if ok else 0.0 for p, ok in zip(score, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(documents: DataFrame, model: Model | None, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``documents`` (doc_id, text)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_predictor(sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
