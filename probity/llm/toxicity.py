"""Toxicity by class-conditional Kneser-Ney character models with shared back-off.

One model for toxic and one for ordinary labelled texts; both back off to a shared model of all rows,
labelled or not, so an expression that a class has hardly seen gets nearly the same probability from
both. The evidence is the log-likelihood ratio a character. A text's ratio is normalised by its length,
and so is that of its most toxic expressions (a word and its neighbour), since a few words make a long
text toxic. A logistic calibration of these ratios, fitted on a bounded sample, gives the score.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm import kn
from probity.llm.common import fold, fresh, sized, slices, stage

ORDER, BITS, PRIME = 5, 12, 4093
TOXIC, ORDINARY, REST, SHARED = "toxic", "ordinary", "rest", "*"
#: Least discount of a class count: what a class holds once or twice is hardly evidence.
DISCOUNT = 1.0
#: Share of the labelled training rows, by hash, that the class counts leave out, so that the calibration
#: sees texts as new to the models as any other; and how many of those it uses at most, in expectation.
CALIBRATION_SHARE = 0.15
CALIBRATION_ROWS = 20_000
#: A word's ratio counts as an excess beyond this many nats.
MARGIN = 3.0
FEATURES = 6


class Toxicity(NamedTuple):
    model: kn.Model | None
    weights: np.ndarray  # bias first
    center: np.ndarray
    scale: np.ndarray


def ratios(texts: list[str | None], scorer: kn.Scorer | None) -> np.ndarray:
    """By text: ratio a character, highest ratio of a word, of two words, mean excess a word, log words,
    mean excess over half the margin."""
    out = np.zeros((len(texts), FEATURES))
    if scorer is None:
        return out
    c, owner, target = kn.codes(texts, ORDER, PRIME)
    if not target.any():
        return out
    key = kn.pack(c, ORDER, BITS)[target]
    c, owner = c[target], owner[target]
    lp = scorer.logp(key)
    d = (lp[:, 0] - lp[:, 1]).astype(np.float64)
    # a word is its letters and the 0 behind it
    start = np.flatnonzero(np.concatenate([[True], (c[:-1] == 0) | (owner[1:] != owner[:-1])]))
    w = np.add.reduceat(d, start)
    of = owner[start]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    rows = of[first]
    words = np.diff(np.append(first, len(of)))
    pair = w.copy()
    pair[1:] += np.where(of[1:] == of[:-1], w[:-1], 0)
    out[rows, 0] = np.add.reduceat(w, first) / np.bincount(owner, minlength=len(texts))[rows]
    out[rows, 1] = np.maximum.reduceat(w, first)
    out[rows, 2] = np.maximum.reduceat(pair, first)
    out[rows, 3] = np.add.reduceat(np.maximum(w - MARGIN, 0), first) / words * 100
    out[rows, 4] = np.log1p(words)
    out[rows, 5] = np.add.reduceat(np.maximum(w - MARGIN / 2, 0), first) / words * 100
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Toxicity:
    """Counts from every row; labels only from rows whose crc32(key) mod 5 is not 0."""
    known = labels.where(labels[label].isNotNull() & labels[key].isNotNull() & (fold(labels[key], 5) != 0)).groupBy(labels[key].alias("k")).agg(F.max(labels[label]).alias("y"))
    known = stage(known.withColumn("u", F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / (1 << 20)))
    counted = F.col("u") >= CALIBRATION_SHARE
    rows = docs.where(docs[text].isNotNull()).select(docs[key].alias("d"), docs[text].cast("string").alias("text"))
    rows = rows.join(sized(known, 32), rows["d"] == known["k"], "left").select("d", "text", F.when(counted & (F.col("y") == 1), TOXIC).when(counted & (F.col("y") == 0), ORDINARY).otherwise(REST).alias("cls"))
    counts = stage(kn.count_grams(rows, ORDER, BITS, PRIME))
    seen = {r[0] for r in counts.select("cls").distinct().collect()}
    if not {TOXIC, ORDINARY} <= seen:
        return Toxicity(None, np.array([-3.0, *[0.0] * FEATURES]), np.zeros(FEATURES), np.ones(FEATURES))
    both = counts.where(F.col("cls") != REST).unionByName(counts.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(SHARED).alias("cls"), "key", "n"))
    model = kn.fit(both, [TOXIC, ORDINARY], ORDER, BITS, PRIME, SHARED, DISCOUNT)
    part = known.where(F.col("u") < min(CALIBRATION_SHARE, CALIBRATION_ROWS / max(1, known.count())))
    sample = docs.select(docs[key].alias("d"), docs[text].cast("string").alias("text")).join(sized(part, 32), F.col("d") == F.col("k")).select("text", "y")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kn.Scorer(held.value)
        for b in batches:
            for p in slices(b, "text"):
                x = ratios(p.column(0).to_pylist(), scorer)
                yield pa.RecordBatch.from_arrays([p.column(1).cast(pa.int32()), *(pa.array(x[:, j]) for j in range(FEATURES))], names=["y", *(f"f{j}" for j in range(FEATURES))])

    got = sample.mapInArrow(features, "y int, " + ", ".join(f"f{j} double" for j in range(FEATURES))).toPandas().to_numpy(dtype=np.float64)
    y, x = got[:, 0] == 1, got[:, 1:]
    return Toxicity(model, *logistic(x, y))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns: weights, centers, scales."""
    if not len(x):
        return np.zeros(x.shape[1] + 1), np.zeros(x.shape[1]), np.ones(x.shape[1])
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - center) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) * np.diag([0.0, *[1.0] * x.shape[1]]) + 1e-6 * np.eye(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w, center, scale


def score(docs: DataFrame, tox: Toxicity, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: more toxic) behind its own columns.

    A null or empty text, or one without letters, scores as a text without any evidence. Rows are
    independent: repeated rows and other columns stay; a column named score is replaced.
    """
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(tox)
    inner = fresh(docs, "kn_text")
    src = docs.withColumn(inner, docs[text].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        scorer = kn.Scorer(t.model) if t.model else None
        for batch in batches:
            for part in slices(batch, inner):
                i = part.schema.get_field_index(inner)
                x = (ratios(part.column(i).to_pylist(), scorer) - t.center) / t.scale
                s = 1 / (1 + np.exp(-np.clip(t.weights[0] + x @ t.weights[1:], -30, 30)))
                keep = [k for k in range(part.num_columns) if k != i]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s)], names=[*(part.schema.names[k] for k in keep), "score"])

    return src.mapInArrow(run, docs.schema.add("score", "double"))
