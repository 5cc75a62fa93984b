"""Character Kneser-Ney models: counts by Spark, sorted hash arrays, vectorised scoring.

A text becomes a sequence of codes: letters of the lower-cased text (code point mod a prime, plus 1),
and one 0 for each run of other characters. `order` codes pack into one 64-bit key. Counts of keys are
summed by Spark over all rows of all partitions; each lower order counts the distinct left extensions
of its grams (Kneser-Ney continuation counts), again by Spark. What goes to the driver is bounded:
keys fold into 2**SLOT_BITS slots for each class and order, whatever the corpus holds.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import mix, slices, stage

SLOT_BITS = 20
#: Keys that a task holds before it hands on its sums.
HELD = 1 << 21


@lru_cache(maxsize=4)
def code_table(prime: int) -> np.ndarray:
    """The code of every code point: 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint16)
    letters = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), dtype=np.int64)
    out[letters] = letters % prime + 1
    return out


def codes(texts: list[str | None], order: int, prime: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, index of the text, whether a position is a target) of the texts one after another.

    Each text is led by order-1 zeros, which are no targets, so no gram spans two texts."""
    low = [(t or "").lower() for t in texts]
    lead = order - 1
    raw = np.frombuffer(("".join(low)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    c = code_table(prime)[raw]
    row = np.repeat(np.arange(len(low)), size)
    keep = c > 0
    keep[1:] |= (c[:-1] > 0) & (row[1:] == row[:-1])
    c, row = c[keep], row[keep]
    n = np.bincount(row, minlength=len(low))
    out = np.zeros(len(c) + lead * len(low), dtype=np.uint64)
    at = np.arange(len(c)) + lead * (row + 1)
    out[at] = c
    owner = np.repeat(np.arange(len(low)), n + lead)
    target = np.zeros(len(out), dtype=bool)
    target[at] = True
    return out, owner, target


def pack(c: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The key of the gram that ends at each position."""
    key = c.copy()
    for k in range(1, order):
        key[k:] |= c[:-k] << np.uint64(bits * k)
    return key


def slot(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def count_grams(rows: DataFrame, order: int, bits: int, prime: int) -> DataFrame:
    """rows(cls string, text string) to (cls, key, n): how often each class's texts hold each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            n = np.concatenate([m for _, m in parts])
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def flush():
            for cls, parts in held.items():
                keys, n = merged(parts)
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([cls] * len(k), pa.string()), pa.array(k), pa.array(n[at : at + (1 << 16)])], names=["cls", "key", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                cls = part.column(0).to_pylist()
                c, owner, target = codes(part.column(1).to_pylist(), order, prime)
                key = pack(c, order, bits)
                names = sorted(set(cls))
                of = np.array([names.index(x) for x in cls], dtype=np.int64)[owner]
                for i, name in enumerate(names):
                    k = np.sort(key[target & (of == i)] if len(names) > 1 else key[target])
                    if not len(k):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    n = np.diff(np.append(first, len(k)))
                    held.setdefault(name, []).append((k[first], n))
                    size += len(first)
                if size > HELD:
                    held_now = {name: [merged(parts)] for name, parts in held.items()}
                    held.clear()
                    held.update(held_now)
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD // 2:
                        yield from flush()
                        size = 0
        yield from flush()

    out = rows.select("cls", "text").mapInArrow(run, "cls string, key long, n long")
    return out.groupBy("cls", "key").agg(F.sum("n").alias("n"))


class Level(NamedTuple):
    """One order: sorted slots, their log probabilities by class, and log back-off weights by class of
    the slots as contexts of the next order."""

    slots: np.ndarray
    logp: np.ndarray
    loglam: np.ndarray


class Model(NamedTuple):
    classes: list[str]
    order: int
    bits: int
    prime: int
    levels: list[Level]  # orders 1 to `order`
    floor: float  # log probability of a code that no class has seen
    mean: np.ndarray  # by class: mean and variance of -log p over the training grams
    var: np.ndarray


def fit(counts: DataFrame, classes: list[str], order: int, bits: int, prime: int, shared: str | None = None, least: float = 0.1) -> Model:
    """Interpolated Kneser-Ney models of `classes` from counts (cls, key, n).

    With `shared`, a class of counts over all rows, the classes back off to its interpolated model of the
    same order instead of their own lower orders, and their discount is `least` at least."""
    grams = stage(counts)
    by_order: list[list[np.ndarray]] = []
    level = grams
    for n in range(order, 0, -1):
        low = (1 << bits * (n - 1)) - 1
        fine = level.select("cls", F.col("key"), "n")

        def fold(batches, n=n, low=low):
            for b in batches:
                key = b.column(1).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slot(key)), pa.array(slot(key >> np.uint64(bits))), pa.array(slot(key & np.uint64(low))), b.column(2)], names=["cls", "slot", "ctx", "bo", "n"])

        folded = fine.mapInArrow(fold, "cls string, slot int, ctx int, bo int, n long").groupBy("cls", "slot").agg(F.min("ctx").alias("ctx"), F.min("bo").alias("bo"), F.sum("n").alias("n"))
        got = folded.toArrow()
        got = got.combine_chunks()
        cls = got.column("cls").to_numpy(zero_copy_only=False)
        by_order.insert(0, [cls, *(got.column(c).to_numpy() for c in ("slot", "ctx", "bo", "n"))])
        level = level.groupBy("cls", F.col("key").bitwiseAND(F.lit(low)).alias("key")).agg(F.count("*").alias("n"))
    return build(by_order, classes, order, bits, prime, shared, least)


def build(by_order: list[list[np.ndarray]], classes: list[str], order: int, bits: int, prime: int, shared: str | None, least: float) -> Model:
    names = [*classes, shared] if shared else list(classes)
    width = len(names)
    vocabulary = max(2, len(np.unique(by_order[0][1])) + 1)
    floor = -np.log(vocabulary)
    levels: list[Level] = []
    own: list[Level] = []  # with the shared class as last column
    mean, var = np.zeros(width), np.zeros(width)
    root = slot(np.zeros(1, np.uint64))
    for n in range(1, order + 1):
        cls, slots, ctx, bo, count = by_order[n - 1]
        u, first, at = np.unique(slots, return_index=True, return_inverse=True)
        ctx_of, bo_of = ctx[first], bo[first]
        c = np.zeros((len(u), width))
        for j, name in enumerate(names):
            of = cls == name
            c[at[of], j] = count[of]
        ctx_u, ctx_at = np.unique(ctx_of, return_inverse=True)
        total, taken = np.zeros((len(ctx_u), width)), np.zeros((len(ctx_u), width))
        one, two = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(one / np.maximum(1, one + 2 * two), 0.1, 0.95)
        if shared:
            discount[:-1] = np.maximum(discount[:-1], least)
        np.add.at(total, ctx_at, c)
        np.add.at(taken, ctx_at, np.minimum(c, discount))
        lam = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
        if n == 1:
            lower = np.full((len(u), width), 1 / vocabulary)
        else:
            prev = own[-1]
            pos = np.minimum(np.searchsorted(prev.slots, bo_of), len(prev.slots) - 1)
            lower = np.where((prev.slots[pos] == bo_of)[:, None], np.exp(prev.logp[pos]), 1 / vocabulary)
        p = np.maximum(c - discount, 0) / np.maximum(total, 1)[ctx_at] + lam[ctx_at] * lower
        if shared:
            # all classes give the shared model the weight that the rarest class leaves it, so a gram that
            # no class holds is as likely in one as in another
            back = p[:, -1:]
            weight = lam[:, [int(np.argmin(c[:, :-1].sum(0)))]]
            kept = np.maximum(c - discount, 0)
            mass = np.zeros((len(ctx_u), width))
            np.add.at(mass, ctx_at, kept)
            share = kept / np.maximum(mass, 1e-9)[ctx_at]
            lam = np.where(mass > 0, weight, 1.0)
            lam[:, -1] = np.where(total[:, -1] > 0, taken[:, -1] / np.maximum(total[:, -1], 1), 1.0)
            p = np.hstack([((1 - lam[ctx_at]) * share + lam[ctx_at] * back)[:, :-1], back])
        # the weights of contexts of this order sit with the level below, under the context's slot
        below = own[-1].slots if own else root
        loglam = np.zeros((len(below), width))
        pos = np.minimum(np.searchsorted(below, ctx_u), len(below) - 1)
        hit = below[pos] == ctx_u
        loglam[pos[hit]] = np.log(lam[hit])
        if own:
            own[-1] = own[-1]._replace(loglam=loglam)
        else:
            levels0 = loglam[0]
        own.append(Level(u, np.log(np.maximum(p, 1e-30)), np.zeros((len(u), width))))
        if n == order:
            weight = c / np.maximum(1, c.sum(0))
            nll = -own[-1].logp
            mean = (weight * nll).sum(0)
            var = (weight * (nll - mean) ** 2).sum(0)
    for lv in own:
        levels.append(Level(lv.slots, lv.logp.astype(np.float32), lv.loglam.astype(np.float32)))
    floor_row = floor + (levels0 if by_order[0][1].size else 0)
    return Model(list(names), order, bits, prime, levels, float(np.mean(floor_row)), mean, var)


class Scorer:
    """Log probabilities of grams by class. The sorted slots get a direct index for constant-time look-up."""

    def __init__(self, model: Model):
        self.m = model
        self.index = []
        for lv in model.levels:
            at = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
            at[lv.slots] = np.arange(len(lv.slots), dtype=np.int32)
            self.index.append(at)

    def logp(self, key: np.ndarray, n: int | None = None) -> np.ndarray:
        m = self.m
        n = n or m.order
        if n == 0:
            return np.full((len(key), len(m.classes)), m.floor, dtype=np.float32)
        at = self.index[n - 1][slot(key)]
        hit = at >= 0
        if hit.all():
            return m.levels[n - 1].logp[at]
        out = np.empty((len(key), len(m.classes)), dtype=np.float32)
        out[hit] = m.levels[n - 1].logp[at[hit]]
        miss = key[~hit]
        rest = self.logp(miss & np.uint64((1 << m.bits * (n - 1)) - 1), n - 1)
        if n > 1:
            ctx = self.index[n - 2][slot(miss >> np.uint64(m.bits))]
            rest = rest + np.where((ctx >= 0)[:, None], m.levels[n - 2].loglam[ctx], np.float32(0))
        out[~hit] = rest
        return out
