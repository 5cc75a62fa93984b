"""Embedding whitening by exact integer covariances.

Entries become integers x = floor(256 c). With n distinct vectors and their sums S, y = n x - S is the centred
vector times n, an integer. Its digits of LIMB bits (limbs) are float64 matrices; over at most ROWS rows every
product of two limbs' columns sums up below 2^53, so BLAS gives exact integers. Recombined as big integers and
added over all tasks they are the sum of y y^T, without a rounding: n^3 times the covariance. One rounded
division gives the covariance, whose eigenvectors whiten the rows.

What goes to the driver are d x d numbers, whatever the number of rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import drop_stage, fresh, stage

SCALE = 256
#: 2 * LIMB bits of a product and log2(ROWS) more of a sum are the 53 of a float64.
LIMB, ROWS = 20, 1 << 13
#: Bits of the digits in which tasks hand on big integers; sums of 2^31 of them fit into 64 bits.
DIGIT = 32
COMPONENTS = 4
#: Components whose eigenvalue is below this part of the largest one, times the dimension, are rounding.
LEAST = 1e-14


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centred(x: np.ndarray, n: int, sums: list[int], bound: int) -> np.ndarray:
    """n x - S, as int64 where the bound allows it, else as Python's integers."""
    if bound < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def limbs(y: np.ndarray, count: int) -> np.ndarray:
    """The limbs of y side by side, the lowest first: non-negative ones but for the last, which has the sign."""
    out = []
    for _ in range(count - 1):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return np.hstack([*out, y.astype(np.float64)])


def gram(y: np.ndarray, count: int) -> np.ndarray:
    """y^T y of at most ROWS rows, as Python's integers; count limbs hold y and its sign."""
    dim = y.shape[1]
    parts = limbs(y, count)
    blocks = (parts.T @ parts).astype(np.int64).reshape(count, dim, count, dim)
    total = np.zeros((dim, dim), dtype=object)
    for shift in range(2 * count - 1):
        same = sum(blocks[i, :, shift - i] for i in range(max(0, shift - count + 1), min(count, shift + 1)))
        total += same.astype(object) << (LIMB * shift)
    return total


def digits(big: np.ndarray, count: int) -> np.ndarray:
    """Rows of count int64 digits for integers; the last one has the sign."""
    big, out = big.ravel(), np.empty((big.size, count), dtype=np.int64)
    for k in range(count - 1):
        out[:, k] = big & ((1 << DIGIT) - 1)
        big = big >> DIGIT
    out[:, -1] = big
    return out


def whole(rows: np.ndarray) -> list[int]:
    return [sum(int(d) << (DIGIT * k) for k, d in enumerate(row)) for row in rows]


def _parts(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for i, d in rows:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([d.ravel()], pa.list_(pa.int64()))], names=["i", "digits"])


def added(parts: DataFrame, count: int) -> dict[int, list[int]]:
    """The sums over all tasks of (i, digits), by i; a task holds one sum for each i that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), b.column(1)):
                values = d.values.to_numpy()
                sums[i] = sums[i] + values if i in sums else values
        yield from _parts(iter(sums.items()))

    rows = parts.repartition("i").mapInArrow(run, "i int, digits array<long>").collect()
    return {r["i"]: whole(np.array(r["digits"], dtype=np.int64).reshape(-1, count)) for r in rows}


def quantised(vectors: DataFrame, vec: str, out: str) -> DataFrame:
    """vectors with out: the integer entries; rows without a vector, or with null or non-finite entries, go.

    Products beyond 64 bits become the nearest 64-bit number."""
    good = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(vec, lambda c: F.floor(SCALE * c.cast("double")) + F.lit(0).cast("long"))
    return vectors.where(F.col(vec).isNotNull() & good).withColumn(out, x)


def sums_of(fit: DataFrame, dim: int, top: int, n: int) -> list[int]:
    """The sum of each dimension."""
    count = (n * (top + 1)).bit_length() // DIGIT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, dtype=object)
        for b in batches:
            x = matrix(b.column(0), dim)
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                total += ((part >> DIGIT).sum(0).astype(object) << DIGIT) + (part & ((1 << DIGIT) - 1)).sum(0).astype(object)
        yield from _parts(iter([(0, digits(total, count))]))

    return added(fit.select("x").mapInArrow(run, "i int, digits array<long>"), count)[0]


def scatter(fit: DataFrame, dim: int, n: int, sums: list[int], bound: int) -> list[list[int]]:
    """The exact sum of y y^T over the fit list."""
    count = bound.bit_length() // LIMB + 1
    wide = (n * bound * bound).bit_length() // DIGIT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for b in batches:
            x = matrix(b.column(0), dim)
            for at in range(0, len(x), ROWS):
                total += gram(centred(x[at : at + ROWS], n, sums, bound), count)
        yield from _parts((i, digits(total[i, i:], wide)) for i in range(dim))

    rows = added(fit.select("x").mapInArrow(run, "i int, digits array<long>"), wide)
    return [[rows[min(i, j)][abs(i - j)] for j in range(dim)] for i in range(dim)]


def whiten(vectors: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vectors without vec, a row for each remaining row and component: component, n, deviation, whitened,
    explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries take no part, nor do vectors of another length
    than the commonest (of equally common ones the longest); empty vectors have no component. The fit list holds
    each distinct x once: n vectors, sums S. Components are unit eigenvectors of its covariance by falling
    eigenvalue e; those without variance are left out, so n = 1 gives no row. deviation: the exact sum of
    (n x - S)^2 as decimal(38,0), null where it is longer. whitened: x - S/n on the component, over sqrt(e).
    explained: e over the trace. identity_error: the largest entry of the covariance of whitened over the fit
    list, less the identity. Repeated rows and null keys each get their rows; an empty table gives none; columns
    of vectors named like a result are replaced."""
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    x, at = fresh(vectors, "_x"), fresh(vectors, "_w")
    keep = [c for c in vectors.columns if c != vec and c.lower() not in names]
    kinds = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    empty = vectors.sparkSession.createDataFrame([], kinds)
    rows = quantised(vectors, vec, x).select(*keep, x)
    common = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 0
    rows = stage(rows.where(F.size(x) == dim))
    fit = stage(rows.select(F.col(x).alias("x")).distinct())
    n, low, high = fit.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not dim or n < 2:
        return rows.limit(0).select(*keep).join(empty, how="cross")
    top = max(abs(low), abs(high))
    bound = 2 * n * top + 1
    sums = sums_of(fit, dim, top, n)
    exact = scatter(fit, dim, n, sums, bound)
    cov = np.array([[v / n**3 for v in row] for row in exact])
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    order = order[values[order] > LEAST * dim * max(values.max(), 0)]
    count = len(order)
    axes = vectors_[:, order] / np.sqrt(values[order])
    explained = [float(v) / (sum(exact[i][i] for i in range(dim)) / n**3) for v in values[order]]
    small = dim * bound * bound < 1 << 63

    @F.arrow_udf("struct<deviation:decimal(38,0),whitened:array<double>>")
    def project(col: pa.Array) -> pa.Array:
        y = centred(matrix(col, dim), n, sums, bound)
        # more than 64 bits: sum as Python's integers
        square = (y * y).sum(1) if small else [int((v * v).sum()) for v in y.astype(object)]
        dev = pa.array([Decimal(int(v)) if int(v) < 10**38 else None for v in square], pa.decimal128(38, 0))
        z = (y.astype(np.float64) / n) @ axes
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * count), pa.array(z.ravel()))
        return pa.StructArray.from_arrays([dev, lists], names=["deviation", "whitened"])

    z = [F.col("z")[i] for i in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    found = fit.select(project("x")["whitened"].alias("z")).agg(*[F.covar_pop(z[i], z[j]) for i, j in pairs]).first() if count else []
    error = max((abs(v - (i == j)) for v, (i, j) in zip(found, pairs)), default=0.0)
    drop_stage(fit)
    share = F.array(*map(F.lit, explained)) if count else F.array().cast("array<double>")
    out = rows.withColumn(at, project(x)).select(*keep, F.lit(n).cast("long").alias("n"), F.col(at)["deviation"].alias("deviation"), F.posexplode(F.col(at)["whitened"]).alias("_i", "whitened"))
    return out.select(*keep, (F.col("_i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", share[F.col("_i")].alias("explained"), F.lit(float(error)).alias("identity_error"))
