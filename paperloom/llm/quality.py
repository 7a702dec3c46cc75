"""Quality classifier: Bradley-Terry scores learned from preference pairs, with a threshold by score quantile.

Each pair takes a document labelled 1 and one labelled 0; the chance that the first is preferred is the logistic function of
the difference of their scores, which are linear in features of the text.  The loss sees feature differences only, so a
score's zero has no meaning until the threshold is set: at a quantile of the scores of all labelled training documents,
also where the weights are learned from a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices, small_batches, stage

#: Labelled documents to learn from at most: those with the smallest hashes of doc_id.
MOST_LABELLED = 20_000
#: Preference pairs for each document labelled 0 or 1, whichever are more.
PAIRS = 8
STEPS = 400
L2 = 1e-3
#: The score of a document at the threshold; ``predicted`` is 1 from here on.
CUT = 0.3
_CLASS = np.zeros(256, np.int64)
for _c in range(128):
    _t = chr(_c)
    _CLASS[_c] = 1 if _t.islower() else 2 if _t.isupper() else 3 if _t.isdigit() else 4 if _t in " \t" else 5 if _t == "\n" else 6 if _t in ".,;:?-'\"()" else 7 if _t == "!" else 8 if _t == "|" else 9 if _t.isprintable() else 10
_CLASS[128:] = 11
FEATURES = 24
#: Quantiles of the scores that may become the threshold, and their accuracy as a share of rank where they are of all labelled documents.
LEVELS = 401
RANK_ERROR = 2e-4


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, word lengths, repetition and length of a whole text; zeros for one without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    out = np.zeros(FEATURES)
    if not words:
        return out
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=12) / len(raw)
    out[:11] = np.sqrt(share[1:])
    n, distinct = len(words), set(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[11] = np.log1p(n) / 10
    out[12] = len(distinct) / n
    out[13] = np.log(len(distinct)) / np.log(n) if n > 1 else 1
    out[14] = sizes.mean() / 10
    out[15] = sizes.std() / 10
    out[16] = (sizes > 20).mean()
    out[17] = len(set(lines)) / len(lines)
    out[18] = np.log1p(len(raw) / len(lines)) / 10
    out[19] = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    out[20] = sum(w[-1:] in b".,;:?" for w in words) / n
    out[21] = sum(w[-1:] in b"!#$%&*|" for w in words) / n
    out[22] = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, n - 1)
    out[23] = 1.0 if n < 20 else 0.0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expanded((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in the Bradley-Terry score; CUT at the threshold."""
        z = np.clip(self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-z))


def expanded(z: np.ndarray) -> np.ndarray:
    """The features and their squares, bounded, so that extremes on either side can count against a document."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6], axis=1)


def threshold(levels: np.ndarray, kept: np.ndarray, dropped: np.ndarray, next_below: Callable[[float], float]) -> float:
    """Of the quantiles of the scores, that with the best balance of both labels kept right."""
    right = kept + dropped
    best = np.flatnonzero(right >= right.max() - 1e-9)
    return (levels[best[-1]] + next_below(levels[best[0]])) / 2 if len(best) == 1 else levels[best[len(best) // 2]]


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model | None:
    """A model from features and labels 0 or 1; none if a label is missing, as there are no pairs then."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expanded((x - mean) / scale)
    rng = np.random.default_rng(seed)
    n = PAIRS * max(len(good), len(bad))
    i, j = rng.permutation(np.resize(good, n)), rng.permutation(np.resize(bad, n))
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, STEPS + 1):
        at = rng.integers(0, n, 4096)
        d = z[i[at]] - z[j[at]]
        g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(axis=0) + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = z @ w
    levels = np.quantile(raw, np.linspace(0, 1, LEVELS))
    top, low = np.sort(raw[good]), np.sort(raw[bad])
    cut = threshold(levels, 1 - np.searchsorted(top, levels, "left") / len(top), np.searchsorted(low, levels, "left") / len(low), lambda x: raw[raw < x].max(initial=x - 1))
    return Model(mean, scale, w, float(cut), float(2 / (raw.std() + 1e-9)))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the training documents; crc32(doc_id) mod 5 = 0 is held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return rows.groupBy("doc_id").agg(F.max("quality").alias("label"))


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """Learns weights from the ``most`` labelled documents with the smallest hashes; the threshold is that of these alone."""
    chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers, whatever the size of the corpus.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    made = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>")
    # Of rows that share a doc_id one counts, so at most ``most`` rows reach the driver.
    found = made.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    return learn(np.array(found["x"].tolist()), found["label"].to_numpy()) if len(found) else None


def placed(model: Model, raws: DataFrame, labels: DataFrame) -> Model:
    """``model`` with the threshold of all labelled training rows of ``raws`` (doc_id, raw; a written table)."""
    rows = raws.join(labelled(labels), "doc_id").select("label", "raw")
    levels = np.array(rows.approxQuantile("raw", np.linspace(0, 1, LEVELS).tolist(), RANK_ERROR))
    if not len(levels):
        return model
    bounds = sorted(set(levels.tolist()))

    def at_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("raw"), pa.array(np.searchsorted(bounds, batch.column("raw").to_numpy(), "right"))], names=["label", "raw", "at"])

    by_level = rows.select(F.col("label").cast("int").alias("label"), "raw").mapInArrow(at_level, "label int, raw double, at long").groupBy("label", "at").agg(F.count(F.lit(1)).alias("n"), F.max("raw").alias("top"))
    found = by_level.collect()  # at most two rows for each level
    under = {label: np.cumsum(np.bincount([r["at"] for r in found if r["label"] == label], [r["n"] for r in found if r["label"] == label], len(bounds) + 1)) for label in (0, 1)}
    if not under[0][-1] or not under[1][-1]:
        return model
    # Scores under a level are those at lower levels.
    at = np.searchsorted(bounds, levels)
    kept, dropped = 1 - under[1][at] / under[1][-1], under[0][at] / under[0][-1]
    cut = threshold(levels, kept, dropped, lambda x: max((r["top"] for r in found if r["top"] < x), default=x - 1))
    return replace(model, cut=float(cut))


def with_raw(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``name``, the score before the threshold is placed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = shared.value.raw(np.array([features(t) for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def sampled(labels: DataFrame, most: int) -> bool:
    """Whether there are more labelled training documents than the weights are learned from."""
    return labelled(labels).limit(most + 1).count() > most


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    Null and empty texts are scored by features of zero.  Without documents of both labels there is nothing to learn: all
    scores are 1.  A document with several labels takes the highest.  Repeated rows are scored each; a null
    doc_id is not held out.  An empty table gives no rows.  Only doc_id, text and labels.quality are used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = trained(docs, labels, most)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    if model and sampled(labels, most):
        raws = stage(with_raw(ids, model, "raw").select("doc_id", "raw"), "quality-scores")
        model = placed(model, raws, labels)
        z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(model.slope) * (F.col("raw") - F.lit(model.cut)) + F.lit(float(np.log(CUT / (1 - CUT))))))
        above, score = F.col("raw") >= F.lit(model.cut), 1 / (1 + F.exp(-z))
        # Rounding must not take a score at the threshold under CUT.
        return raws.select("doc_id", held.alias("held_out"), F.when(above, F.greatest(score, F.lit(CUT))).otherwise(score).alias("score"), above.cast("int").alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()])
            score = model.score(x) if model else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return ids.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``docs`` without those scored under the threshold, scored in one pass over the texts.

    Where labelled documents are more than ``most``, the texts are written with their scores until the threshold is placed.
    Null and empty texts are scored by features of zero; repeated rows are scored each; null ids learn nothing.  Without
    labels of both kinds all documents stay.  Other columns pass through, whatever their names.
    """
    small_batches(docs.sparkSession)
    model = trained(docs, labels, most)
    if model and sampled(labels, most):
        name = "_" * max(map(len, docs.columns)) + "raw"  # longer than any other
        whole = stage(with_raw(docs, model, name), "quality-scored")
        model = placed(model, whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("raw")), labels)
        return whole.where(F.col(name) >= F.lit(model.cut)).drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            if model:
                keep = model.score(np.array([features(t) for t in batch.column("text").to_pylist()])) >= CUT
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
