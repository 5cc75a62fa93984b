"""Quality by positive-unlabelled learning.

A small network over surface statistics of a text minimises the non-negative unbiased PU risk
    prior * R+(g) + max(0, R-(unlabelled) - prior * R-(positives))
from trusted positives, unlabelled web text and the estimated class prior. Negative labels are used for
the prior alone.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from probity.llm.common import drop_stage, fold, fresh, sized, slices, stage, utf8

#: Classes of bytes: 0 other ASCII punctuation, 1 white space, 2 lower, 3 upper, 4 digit, 5 .,;:'-, 6 !?, 7 non-ASCII.
CLASSES = 8
SURFACE = 16
FEATURES = SURFACE + CLASSES * CLASSES
#: Rows of each kind that the network is fitted on at most, in expectation: positives, and unlabelled rows.
POSITIVES, UNLABELLED = 20_000, 30_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 40, 512, 4e-3, 7
#: Share of the epochs that use the logistic loss.
BOUNDED_FROM = 0.5


def byte_classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[[ord(c) for c in ".,;:'-"]] = 5
    out[[ord(c) for c in "!?"]] = 6
    out[128:] = 7
    return out


def surface(col: pa.Array) -> np.ndarray:
    """FEATURES numbers of each text: shares of pairs of byte classes, lengths, repetition, compression."""
    data, off = utf8(col)
    n = len(off) - 1
    cls = byte_classes()[data].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros((n, FEATURES))
    if len(cls) > 1:
        same = row[1:] == row[:-1]
        pairs = np.bincount((row[:-1] * 64 + cls[:-1] * 8 + cls[1:])[same], minlength=n * 64).reshape(n, 64)
        out[:, SURFACE:] = np.sqrt(pairs / np.maximum(1, pairs.sum(1))[:, None])
    raw = data.tobytes()
    for i in range(n):
        text = raw[off[i] : off[i + 1]]
        words = text.split()
        if not words:
            continue
        count = Counter(words)
        top = count.most_common(3)
        lines = [x for x in text.split(b"\n") if x.strip()]
        size = len(text)
        k = len(words)
        out[i, :SURFACE] = (
            np.log1p(size), np.log1p(k), sum(map(len, words)) / k / 10, len(count) / k, len(count) / k**0.8, top[0][1] / k, sum(c for _, c in top) / k,
            max(map(len, count)) / 50, len(zlib.compress(text[: 1 << 16] if size <= 1 << 16 else text, 1)) / (size + 20), len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))),
            sum(c for w, c in count.items() if len(w) <= 3) / k, sum(c for w, c in count.items() if w[-1:] in b".,!?") / k, len(set(map(bytes.lower, count))) / len(count), sum(w[:1] == b"*" or not w.isalnum() for w in count) / len(count), sum(c == 1 for c in count.values()) / k,
        )
    return out


class Network(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.center) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, center: np.ndarray, scale: np.ndarray) -> Network:
    """Adam steps on the non-negative PU risk; where a batch's negative part falls below zero, the step
    ascends that part alone. The logistic loss comes first; the last rounds use the sigmoid loss, which is
    bounded, so that sure positives add little noise to the negative part."""
    rng = np.random.default_rng(SEED)
    p, u = (np.clip((x - center) / scale, -6, 6) for x in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    if not len(p) or not len(u):
        return Network(center, scale, theta[0], theta[1], theta[2] * 0, float(np.log(prior / (1 - prior))))
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rounds = max(1, max(len(p), len(u)) // BATCH)
    for epoch in range(EPOCHS):
        rate = RATE * (0.5 if epoch > EPOCHS * 0.6 else 1) * (0.3 if epoch > EPOCHS * 0.85 else 1)
        for _ in range(rounds):
            a, b = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
            x = np.vstack([a, b])
            h = np.tanh(x @ theta[0] + theta[1])
            z = h @ theta[2] + theta[3][0]
            za, zb = z[: len(a)], z[len(a) :]
            pa_, pb = sig(za), sig(zb)
            if epoch < EPOCHS * BOUNDED_FROM:
                negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
                ga, gb, gp = -prior * pa_ / len(a), pb / len(b), -prior * (1 - pa_) / len(a)
            else:
                negative = pb.mean() - prior * pa_.mean()
                ga, gb, gp = -prior * pa_ * (1 - pa_) / len(a), pb * (1 - pb) / len(b), -prior * pa_ * (1 - pa_) / len(a)
            if negative >= 0:
                g = np.concatenate([ga + gp, gb])
            else:
                g = -np.concatenate([ga, gb])
            gh = np.outer(g, theta[2]) * (1 - h * h)
            grads = [x.T @ gh + 1e-4 * theta[0], gh.sum(0), h.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
            step += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(center, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def features(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs without its text column, with the array of features instead."""
    inner = fresh(docs, "pu_text")
    src = docs.withColumn(inner, docs[text].cast("string")).drop(text)
    schema = src.drop(inner).schema.add(out, ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner):
                i = part.schema.get_field_index(inner)
                x = surface(part.column(i)).astype(np.float32)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
                keep = [k for k in range(part.num_columns) if k != i]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), values], names=[*(part.schema.names[k] for k in keep), out])

    return src.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """docs without its text, with score (0 to 1) behind the other columns.

    The prior is the share of positives among the labelled rows whose crc32(key) mod 5 is not 0; positives
    are those with label 1; unlabelled rows are those of all docs in the same folds. The network is fitted
    on a sample by hash (POSITIVES, UNLABELLED); centers and scales of the features come from all rows.
    Null and empty texts have all-zero features and get a score like any other. Repeated rows, null keys
    and other columns stay; a column named score is replaced. Without positives every score is the prior
    (0.5 if there are no labels).
    """
    spark = docs.sparkSession
    x = fresh(docs, "pu_x")
    docs = docs.drop("score")
    feats = stage(features(docs, text, x))
    known = labels.where(labels[label].isNotNull() & labels[key].isNotNull() & (fold(labels[key], 5) != 0)).groupBy(labels[key].alias("pu_k")).agg(F.max(labels[label]).alias("pu_y"))
    known = stage(known)
    n_known, n_good = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("pu_y") == 1, 1)), F.lit(0))).first()
    prior = min(0.97, max(0.03, n_good / n_known)) if n_known else 0.5
    stats = feats.select(F.posexplode(x)).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col"), F.count("*")).collect()
    center, scale = np.zeros(FEATURES), np.ones(FEATURES)
    for pos, mean, sd, _ in stats:
        center[pos], scale[pos] = mean, max(sd, 1e-4)
    total = max((r[3] for r in stats), default=0)
    good = known.where(F.col("pu_y") == 1)
    positive = _sample(feats.join(sized(good, 32), feats[key] == good["pu_k"], "left_semi"), key, x, POSITIVES / max(1, n_good), "p")
    unlabelled = _sample(feats.where(fold(F.col(key), 5) != 0), key, x, UNLABELLED / max(1, total), "u")
    net = fit_nnpu(positive, unlabelled, prior, center, scale)
    drop_stage(known)
    held = spark.sparkContext.broadcast(net)
    schema = feats.drop(x).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(x)
            values = np.asarray(b.column(i).flatten(), dtype=np.float64).reshape(b.num_rows, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(held.value.logit(values), -30, 30)))
            keep = [k for k in range(b.num_columns) if k != i]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s)], names=[*(b.schema.names[k] for k in keep), "score"])

    return feats.mapInArrow(run, schema)


def _sample(rows: DataFrame, key: str, x: str, share: float, salt: str) -> np.ndarray:
    if share < 1:
        at: Column = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 20))
        rows = rows.where(at < int(share * (1 << 20)))
    got = rows.select(x).toArrow().column(0).combine_chunks()
    return np.asarray(got.flatten(), dtype=np.float64).reshape(-1, FEATURES)
