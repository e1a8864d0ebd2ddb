"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes a vector of statistics of its characters, words and lines. A linear utility is learnt from preference pairs,
a good document preferred to a poor one, by logistic loss on the difference of their features. The quantile of utilities
that leaves the share of poor documents below becomes the threshold; a score shifts the utility so that the threshold lies
at a given score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.runtime import arrow_batches

#: Labelled rows that a model is fitted on, at most; those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
PAIRS = 200_000
SLICE_ROWS = 256
#: Texts that a Python worker gets at once while a model is learnt.
TEXTS_AT_ONCE = 1_000

_CLASSES = np.zeros((256, 7))  # bytes by letter case, digit, space, line end, sign, other
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() and _b < 128 else 3 if _c in " \t" else 4 if _c in "\r\n" else 5 if _b < 128 else 6] = 1
#: Signs of ASCII that each get a feature.
_SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def features(text: str | None) -> np.ndarray:
    """The features of a whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    histogram = np.bincount(raw, minlength=256) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    different = len(set(words))
    ends = [w[-1] for w in words]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    same_next = sum(map(str.__eq__, words, words[1:]))
    upper = sum(map(str.isupper, words))
    alphabetic = sum(map(str.isalpha, words))
    sign_end = sum(not (c.isalnum() or c in ".,;:") for c in ends)
    stops = sum(c in ".?!" for c in ends)
    lines = [line for line in text.split("\n") if line]
    distinct_lines = len(set(lines)) / max(1, len(lines))
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    own = [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        different / n,
        different / n * np.log1p(len(words)),
        min(1.0, trigrams),
        distinct_lines,
        same_next / n,
        upper / n,
        alphabetic / n,
        sign_end / n,
        stops / n,
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        float(lengths.max()) / 100,
        float(len(words) < 20),
        float(len(words) < 60),
    ]
    return np.concatenate((own, histogram @ _CLASSES, np.sqrt(histogram[_SIGNS]))).astype(np.float32)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row's labels are never learnt from: the CRC-32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class BradleyTerry:
    """A linear utility of standardised features, and the utility at which a document is good enough."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    threshold_score: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.threshold_score / (1 - self.threshold_score))
        return 1 / (1 + np.exp(-np.clip(self.utility(x) - self.threshold + shift, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, threshold_score: float = 0.3, pairs: int = PAIRS, seed: int = 5, l2: float = 1e-3, steps: int = 300) -> BradleyTerry:
    """Fit utilities to random (good, poor) pairs of rows; without rows of both kinds, every text scores 0.5."""
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    width = x.shape[1] if x.ndim == 2 else len(features(""))
    if not len(better) or not len(worse):
        level = float(np.log(threshold_score / (1 - threshold_score)))
        return BradleyTerry(np.zeros(width), np.ones(width), np.zeros(width), level, threshold_score)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8).astype(np.float64)
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    batch = min(pairs, 4096)
    for step in range(1, steps + 1):
        difference = z[rng.choice(better, batch)] - z[rng.choice(worse, batch)]
        miss = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
        gradient = -(difference * miss[:, None]).mean(axis=0) + l2 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = BradleyTerry(centre, scale, w, 0.0, threshold_score)
    threshold = float(np.quantile(model.utility(x), len(worse) / len(x)))
    return BradleyTerry(centre, scale, w, threshold, threshold_score)


def _vectors(rows: DataFrame) -> DataFrame:
    """(id, good, x): features of (id, good, text) as 32-bit floats."""
    schema = T.StructType([rows.schema["id"], T.StructField("good", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                x = [features(text).tobytes() for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("good"), pa.array(x, pa.binary())], names=schema.names)

    return rows.select("id", "good", "text").mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold_score: float = 0.3, rows: int = TRAIN_ROWS) -> BradleyTerry:
    """A model from labelled documents outside the held-out fold.

    At most ``rows`` labelled ids are used, those with the smallest hashes, and one text of each: of several, that with the least vector. Null labels and
    ids are passed over; of several labels of one id the mean decides, and a mean of exactly one half is passed over. Only
    texts enter the features. No usable label gives a model that scores every text 0.5.
    """
    ident = F.col(id_col)
    known = labels.where(F.col(label_col).isNotNull() & ident.isNotNull() & ~is_held_out(ident)).groupBy(ident.alias("__id")).agg(F.avg(label_col).alias("__mean"))
    sample = known.where("__mean <> 0.5").orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # at most ``rows`` rows of two numbers
    joined = docs.select(ident.alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__id")
    vectors = _vectors(joined.select(F.col("__id").alias("id"), (F.col("__mean") > 0.5).alias("good"), "text"))
    with arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        # at most ``rows`` vectors come to the driver
        found = vectors.groupBy("id").agg(F.first("good").alias("good"), F.min("x").alias("x")).toArrow()
    good = np.array(found["good"].to_pylist(), dtype=bool)
    width = len(features(""))
    x = np.frombuffer(b"".join(found["x"].to_pylist()), dtype=np.float32).reshape(-1, width)
    order = sorted(range(len(x)), key=lambda k: (zlib.crc32(x[k].tobytes()), bool(good[k])))  # not the order of tasks
    return fit(x[order], good[order], threshold_score)


def _score(model: BradleyTerry, text: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        # a slice of texts at a time becomes Python strings
        parts = [np.empty(0)]
        for at in range(0, len(texts), SLICE_ROWS):
            parts.append(model.score(np.stack([features(t) for t in texts.slice(at, SLICE_ROWS).to_pylist()])))
        return pa.array(np.concatenate(parts), pa.float64())

    return score(text.cast("string"))


def score_quality(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score reaches the model's threshold, else 0).

    Null texts score as empty ones. All rows and columns are kept; columns named score or predicted are replaced. No rows
    give no rows.
    """
    scored = docs.withColumn("score", _score(model, F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= model.threshold_score).cast("int"))


def keep_good(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the model's threshold, with their own columns, whatever the names."""
    return docs.where(_score(model, F.col(text_col)) >= model.threshold_score)
