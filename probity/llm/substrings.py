"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte that a LENGTH-byte string covers which also starts in a document with a smaller id is removed.

1. Documents are packed into rows of about PACK bytes. Polynomial hashes of all GRAM-byte strings are
   taken, and the least one in each LENGTH-byte window is an anchor; a window selects the same anchor in
   every document. Packs send their distinct anchor hashes to ranges, and learn which others hold, too.
2. For an anchor that other documents hold, the suffixes are compared: each pack sends the anchor's
   distinct contexts (LENGTH - GRAM bytes before, LENGTH behind its start) with their least document. In a
   range, the suffixes from the anchor on are sorted by mergesort; two are compared by binary search on
   prefix polynomial hashes for their common extension, whose bytes are then verified. The suffixes that
   start one byte further left follow from that order, sorted stably by the byte that they gain, and so on
   for all starts of a window. Equal windows are neighbours in these orders, however many there are.
3. Packs learn the shared strings and their least documents, and remove what they cover.

A task holds one range at a time: rows come sorted by range, and ranges are dealt by a second hash, since the
anchors, as minima, lie near 0. What a task finds is gathered over its ranges, HELD strings at a time, so a pack
gets rows by what was found for it, not one from each range. Contexts of an anchor that more than HOT packs
hold are merged in parts of about HOT packs before the range sees them, so no range holds a context twice for
each pack. Equal hashes count only where the bytes agree.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from probity.llm.common import drop_stage, mix, slices, stage, utf8

LENGTH, GRAM = 50, 20
LEAD = LENGTH - GRAM
WIDE = LEAD + LENGTH
PACK = 1 << 20
#: Bytes of a pack that are hashed at a time.
BLOCK = 1 << 16
#: Text bytes that a range answers for, about; and ranges at least.
RANGE_BYTES, RANGES = 8 << 20, 64
#: Found strings that a task gathers before it hands them on to their packs.
HELD = 1 << 18
#: Packs whose contexts of one anchor meet at once.
HOT = 128
#: Contexts that a range compares at once, about.
TOGETHER = 1 << 13
#: Lowest bits of a shared anchor: how often its packs are halved into parts.
PARTS = np.uint64(31)
BASE = 0x9E3779B97F4A7C15 | 1
SEED = 99
U = np.uint64
FAR = np.iinfo(np.int64).max


def byte_values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of the k-byte strings at each position, by doubling."""
    level, width, out, done = byte_values()[data], 1, None, 0
    while True:
        if k & width:
            if out is None:
                out = level
            else:
                n = len(data) - done - width + 1
                out = out[:n] * U(pow(BASE, width, 1 << 64)) + level[done : done + n]
            done += width
        if done == k:
            return out
        n = len(level) - width
        if n <= 0:
            return np.zeros(0, U)
        level = level[:n] * U(pow(BASE, width, 1 << 64)) + level[width : width + n]
        width *= 2


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    s = 1
    while s * 2 <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


class Pack:
    """The concatenated documents of a pack and their anchors."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.pos = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U)
        self.doc = np.zeros(0, np.int64)
        self.valid = np.zeros(0, bool)
        if len(data) < LENGTH:
            return
        windows = len(data) - LENGTH + 1
        self.valid = np.ones(windows, bool)
        for lo, end in zip(self.off, self.off[1:]):
            self.valid[max(lo, end - LENGTH + 1) : end] = False
        found = [self._block(at, min(at + BLOCK, len(data))) for at in range(0, len(data), BLOCK)]
        self.pos, self.hash = (np.concatenate(c) for c in zip(*found))
        self.doc = np.searchsorted(self.off, self.pos, side="right") - 1

    def _block(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchors at [lo, hi), and their hashes. A block at a time keeps the arrays small."""
        first = max(0, lo - LEAD)
        h = mix(gram_hashes(self.data[first : hi + LENGTH], GRAM))
        if len(h) <= LEAD:
            return np.zeros(0, np.int64), np.zeros(0, U)
        least = sliding(h, LEAD + 1, np.minimum)
        least = np.where(self.valid[first : first + len(least)], least, U(0))
        pad = np.zeros(LEAD, U)
        pos = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), LEAD + 1, np.maximum) == h) & (h > 0))
        pos = pos[(pos + first >= lo) & (pos + first < hi)]
        return pos + first, h[pos] & ~PARTS

    def anchors(self) -> np.ndarray:
        """The distinct anchor hashes, sorted; the lowest bit tells that two ids of this pack hold it."""
        by = np.argsort(self.hash, kind="stable")
        h, d = self.hash[by], self.ids[self.doc[by]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(first):
            return h
        lo, hi = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
        return h[first] | (lo != hi).astype(U)

    def entries(self, shared: np.ndarray) -> Entries:
        """The contexts of the anchors in `shared`, equal ones of this pack as one entry."""
        shared = np.sort(shared)
        at = np.minimum(np.searchsorted(shared, self.hash), max(0, len(shared) - 1))
        # the lowest bits of `shared` sort behind the bare hash
        found = np.flatnonzero((shared[at] & ~PARTS) == self.hash) if len(shared) else np.zeros(0, np.int64)
        p, d = self.pos[found], self.doc[found]
        lo, hi = np.maximum(p - LEAD, self.off[d]), np.minimum(p + LENGTH, self.off[d + 1])
        key = mix(span_hashes(self.data, lo, hi) ^ ((hi - lo).astype(U) << U(32)) ^ (p - lo).astype(U))
        first, entry = distinct_spans(key, self.data, lo, hi, p)
        least = np.full(len(first), FAR)
        np.minimum.at(least, entry, self.ids[d])
        return Entries(lo, entry, lo[first], (hi - lo)[first], (p - lo)[first], shared[at[found[first]]], least)


class Entries(NamedTuple):
    """Starts of the occurrences of contexts, and their entry; by entry: content start, length, anchor offset,
    anchor (with its parts in the lowest bits), least id."""

    begin: np.ndarray
    entry: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    anchor: np.ndarray
    least: np.ndarray


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        a = np.full(n, b, U)
        a[:1] = 1
        np.multiply.accumulate(a, out=a)
        out.append(a)
    return out[0], out[1]


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[lo:hi], from prefix hashes."""
    n = max(1, 1 << (len(data) - 1).bit_length()) if len(data) else 1
    power, inverse = powers(n)
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(byte_values()[data] * power[: len(data)], out=prefix[1:])
    return (prefix[hi] - prefix[lo]) * inverse[np.minimum(lo, n - 1)]


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, class): classes of equal keys, numbered by their first rows."""
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    by = np.argsort(first, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return first[by], rank[at.ravel()]


def distinct_spans(key: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, class) of the strings data[lo:hi] around p: by their keys, verified on the bytes; by the bytes
    alone where two strings have one key."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, at = numbered(key)
    other = np.flatnonzero(first[at] != np.arange(len(at)))
    for s in range(0, len(other), 1 << 13):
        x = other[s : s + (1 << 13)]
        y = first[at[x]]
        if ((hi - lo)[x] != (hi - lo)[y]).any() or ((p - lo)[x] != (p - lo)[y]).any() or (rows_of(data, lo[x], hi[x]) != rows_of(data, lo[y], hi[y])).any():
            full = np.hstack([rows_of(data, lo, hi), (hi - lo)[:, None].astype(np.uint8), (p - lo)[:, None].astype(np.uint8)])
            return numbered(np.ascontiguousarray(full).view(f"V{WIDE + 2}").ravel())
    return first, at


def rows_of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The bytes data[lo:hi], WIDE columns each, 0 behind the end. By column: an index of all cells would take
    eight times the bytes."""
    out = np.zeros((len(lo), WIDE), np.uint8)
    for k in range(WIDE):
        at = lo + k
        out[:, k] = np.where(at < hi, data[np.minimum(at, len(data) - 1)], np.uint8(0))
    return out


def lcp(h: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings x and y, at most n: binary search on their prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), n.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = h[x, mid] == h[y, mid]
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, 2, ... bytes of each row. 32 bits do, since the bytes are compared, too."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint32)
    value, h = byte_values(), np.zeros(len(rows), U)
    for k in range(rows.shape[1]):
        h = h * U(BASE) + value[rows[:, k]]
        out[:, k + 1] = h >> U(32)
    return out


def verified(rows: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The common prefixes m of strings x and y, cut where bytes differ in spite of equal hashes."""
    out = m.copy()
    for s in range(0, len(x), TOGETHER):
        part = slice(s, s + TOGETHER)
        differ = (rows[x[part]] != rows[y[part]]) & (np.arange(rows.shape[1]) < m[part, None])
        out[part] = np.where(differ.any(1), differ.argmax(1), m[part])
    return out


def suffix_sort(group: np.ndarray, rows: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of the strings within their groups (contiguous), by bottom-up mergesort.

    Runs of width w of each group are merged pairwise: an element's place is its own rank plus its rank in
    the sibling run, found by binary search. Two strings are compared at the end of their common prefix."""
    n = len(group)
    order = np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(first, n))
    begin, total = np.repeat(first, count), np.repeat(count, count)
    rank = np.arange(n) - begin
    width = 1
    while width < (count.max() if n else 0):
        run = rank // width
        left = run % 2 == 0
        sib_lo = np.where(left, (run + 1) * width, (run - 1) * width)
        sib_hi = np.minimum(sib_lo + width, total)
        lo, hi = np.minimum(sib_lo, total), np.maximum(sib_hi, np.minimum(sib_lo, total))
        base = lo.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            x, y = order[open_], order[begin[open_] + mid]
            m = verified(rows, x, y, lcp(h, x, y, np.minimum(size[x], size[y])))
            end_x, end_y = m >= size[x], m >= size[y]
            bx = np.where(end_x, -1, rows[x, np.minimum(m, rows.shape[1] - 1)].astype(np.int64))
            by = np.where(end_y, -1, rows[y, np.minimum(m, rows.shape[1] - 1)].astype(np.int64))
            before = (by < bx) | ((by == bx) & ~left[open_])  # equal strings: the left run's come first
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        place = np.where(left, rank - run * width + run * width, rank - width) + (lo - base)
        new = np.empty_like(order)
        new[begin + place] = order
        order = new
        width *= 2
    return order


def shared_strings(anchor: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, lead: np.ndarray, least: np.ndarray):
    """(entry, lo, hi, id): bytes [lo, hi) of the entry's context occur in document id, which is smaller than
    the entry's own least one; strings of LENGTH bytes in that document cover them. Entries are contexts of
    several packs, those of an anchor together; equal ones are one string."""
    z = np.zeros(0, np.int64)
    if not len(anchor):
        return z, z, z, z
    end = start + size
    first, same = distinct_spans(mix(row_hashes(data, start, end) ^ (size.astype(U) << U(32)) ^ lead.astype(U)), data, start, end, start + lead)
    low = np.full(len(first), FAR)
    np.minimum.at(low, same, least)
    entry = np.flatnonzero(low[same] < least)
    out = [(entry, np.zeros(len(entry), np.int64), size[entry], low[same[entry]])]
    by = np.argsort(anchor[first], kind="stable")
    a = anchor[first[by]]
    group = np.cumsum(np.concatenate([[0], a[1:] != a[:-1]]))
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(many):
        u = by[many]  # distinct contexts, those of an anchor together
        x, lo, hi, doc = windows_of(group[many], rows_of(data, start[first[u]], end[first[u]]), size[first[u]], lead[first[u]], low[u])
        # to all entries of these contexts
        x = u[x]
        members = np.argsort(same, kind="stable")
        begin = np.searchsorted(same[members], np.arange(len(first) + 1))
        k = begin[x + 1] - begin[x]
        rep = np.repeat(np.arange(len(x)), k)
        m = members[np.repeat(begin[x] - np.concatenate([[0], np.cumsum(k)])[:-1], k) + np.arange(len(rep))]
        use = doc[rep] < least[m]
        out.append((m[use], lo[rep[use]], hi[rep[use]], doc[rep[use]]))
    entry, lo, hi, doc = (np.concatenate(c) for c in zip(*out))
    return entry, lo, hi, doc


def row_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[lo:hi], which are WIDE bytes long at most."""
    value, out = byte_values(), np.zeros(len(lo), U)
    for k in range(WIDE):
        at = lo + k
        out = np.where(at < hi, out * U(BASE) + value[data[np.minimum(at, len(data) - 1)]], out)
    return out


def windows_of(group: np.ndarray, text: np.ndarray, size: np.ndarray, lead: np.ndarray, low: np.ndarray):
    """(row, lo, hi, id): columns [lo, hi) of the row's context that smaller ids hold, from the windows that
    contexts of a group share. Windows of one id that follow each other are one string."""
    each = np.arange(len(text))
    right_n, left_n = size - lead, lead
    right, left = np.empty((len(text), LENGTH), np.uint8), np.empty((len(text), LEAD), np.uint8)
    for k in range(LENGTH):
        right[:, k] = text[each, np.minimum(lead + k, WIDE - 1)]
    for k in range(LEAD):
        left[:, k] = text[each, np.maximum(lead - 1 - k, 0)]
    del text
    hr, hl = prefix_hashes(right), prefix_hashes(left)
    order = suffix_sort(group, right, hr, right_n)
    rows, starts, ids = [], [], []
    for o in range(LEAD + 1):  # windows that start o bytes before the anchor
        if o:
            order = order[left_n[order] >= o]
            order = order[np.argsort((group[order] << 8) | left[order, o - 1], kind="stable")]
        w = order[right_n[order] >= LENGTH - o]
        if len(w) < 2:
            continue
        x, y = w[:-1], w[1:]
        equal = (group[x] == group[y]) & (hr[x, LENGTH - o] == hr[y, LENGTH - o]) & (hl[x, o] == hl[y, o])
        at = np.flatnonzero(equal)
        if not len(at):
            continue
        x, y = x[at], y[at]
        for s in range(0, len(at), TOGETHER):
            p, q = x[s : s + TOGETHER], y[s : s + TOGETHER]
            equal[at[s : s + TOGETHER]] = (right[p, : LENGTH - o] == right[q, : LENGTH - o]).all(1) & (left[p, :o] == left[q, :o]).all(1)
        run = np.concatenate([[0], np.cumsum(~equal)])
        best = np.minimum.reduceat(low[w], np.flatnonzero(np.concatenate([[True], ~equal])))[run]
        use = np.flatnonzero(best < low[w])
        rows.append(w[use])
        starts.append(lead[w[use]] - o)
        ids.append(best[use])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    row, lo, doc = (np.concatenate(c) for c in (rows, starts, ids))
    by = np.lexsort((lo, doc, row))
    row, lo, doc = row[by], lo[by], doc[by]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + 1)])[: len(row)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    return row[first], lo[first], lo[last] + LENGTH, doc[first]


def pack_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id long, text, row) to rows (pack, ids, lens, rows, data); packs are fixed once written."""
    schema = StructType().add("pack", LongType()).add("ids", ArrayType(LongType())).add("lens", ArrayType(IntegerType())).add("rows", ArrayType(docs.schema["row"].dataType)).add("data", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, most=PACK):
                data, off = utf8(part.column(1))
                number += 1
                one = lambda col: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), col)
                yield pa.RecordBatch.from_arrays([pa.array([number]), one(part.column(0)), one(pa.array(np.diff(off).astype(np.int32))), one(part.column(2)), pa.array([pressed(data.tobytes())], pa.binary())], names=["pack", "ids", "lens", "rows", "data"])

    return docs.select("doc_id", "text", "row").mapInArrow(run, schema)


def pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + bytes(pa.Codec("zstd", 3).compress(raw, asbytes=True))


def unpressed(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


#: Rows without an id come after all others: nothing is removed for them, and nothing from them.
NO_ID = -(1 << 63)


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, bytes) of a pack's documents."""
    get = lambda c: batch.column(batch.schema.names.index(c))[i]
    ids = get("ids").values.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, get("lens").values.to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(unpressed(get("data").as_py()), np.uint8)


def _packs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Pack]]:
    """(row, number, pack) of each row; documents without an id take no part."""
    for i, number in enumerate(batch.column(batch.schema.names.index("pack")).to_pylist()):
        ids, lens, data = _unpacked(batch, i)
        known = ids != NO_ID
        yield i, number, Pack(ids[known], lens[known], data if known.all() else data[np.repeat(known, lens)])


def _split(key: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, indices) by the top bits of the anchors' hashes; a part's bits don't count."""
    if not len(key):
        return
    at = (mix(key & ~PARTS) >> U(64 - bits)).astype(np.int64)
    by = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[by])) + 1
    for part in np.split(by, cuts):
        yield int(at[part[0]]), part


BLOB = "kind int, range long, part int, pack long, blob binary"
#: kinds of rows: what a range compares; where entries occur in a pack; which entries a part has merged
ASK, OWN, MERGED = 0, 1, 2


class Rows:
    """Rows (kind, range, part, pack, blob) for an Arrow batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind: int, range_: int, part: int, pack: int, blob: bytes) -> None:
        self.rows.append((kind, range_, part, pack, blob))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * 5
        self.rows = []
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "range", "part", "pack", "blob"])


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[tuple[int, bytes]]]]:
    """((kind, range, part), [(pack, blob)]) of rows that come sorted by these three."""
    now, held = None, []
    for b in batches:
        blob = b.column(4)
        for i, (*key, pack) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
            if key != now and held:
                yield tuple(now), held
                held = []
            now = key
            held.append((pack, blob[i].as_py()))
    if held:
        yield tuple(now), held


def to_ranges(rows: DataFrame) -> DataFrame:
    return rows.repartition("kind", "range", "part").sortWithinPartitions("kind", "range", "part")


def write_contexts(least: np.ndarray, entry: np.ndarray, size: np.ndarray, lead: np.ndarray, data: np.ndarray) -> bytes:
    head = b"".join(x.tobytes() for x in (least.astype("<i8"), np.diff(entry, prepend=0).astype("<u4"), size.astype("u1"), lead.astype("u1")))
    return pressed(len(least).to_bytes(4, "little") + head + data.tobytes())


class Contexts(NamedTuple):
    """Contexts of several packs: index of the pack, entry there, least id, length, anchor offset, start in data, bytes."""

    of: np.ndarray
    entry: np.ndarray
    least: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    start: np.ndarray
    data: np.ndarray

    @classmethod
    def read(cls, blobs: list[tuple[int, bytes]]) -> Contexts:
        parts = []
        for _, blob in blobs:
            raw = unpressed(blob)
            n = int.from_bytes(raw[:4], "little")
            at, cols = 4, []
            for kind in ("<i8", "<u4", "u1", "u1"):
                cols.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            cols[1] = np.cumsum(cols[1], dtype=np.int64)
            parts.append([*cols, np.frombuffer(raw, np.uint8, -1, at)])
        of = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        least, entry, size, lead, data = (np.concatenate(c) for c in zip(*parts))
        size, lead = size.astype(np.int64), lead.astype(np.int64)
        return cls(of, entry, least, size, lead, np.concatenate([[0], np.cumsum(size)])[:-1], data)

    def anchors(self) -> np.ndarray:
        out, value = np.zeros(len(self.start), U), byte_values()
        for k in range(GRAM):
            out = out * U(BASE) + value[self.data[self.start + self.lead + k]]
        return out

    def bytes_of(self, rows: np.ndarray) -> np.ndarray:
        n = self.size[rows]
        return self.data[np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]


_FOUND = np.dtype([("entry", "<u4"), ("lo", "u1"), ("hi", "u1"), ("least", "<i8")])
_PLACE = np.dtype([("begin", "<u4"), ("entry", "<u4")])
_ENTRY = np.dtype([("size", "u1"), ("doc", "<u4")])
_MERGED = np.dtype([("entry", "<u4"), ("to", "<u4")])


def _by_pack(of: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of each pack's rows."""
    order = np.argsort(of, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else [])


def merged_id(range_: int, part: int) -> int:
    """The number of a part that stands for its packs: below all packs' numbers."""
    return -(range_ << 31 | part) - 1


def compare(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the strings that smaller ids hold, by pack, from rows sorted by range; about `most` strings
    (HELD) are gathered over the ranges first."""
    most, held, n = most or HELD, [], 0
    for (kind, _, _), blobs in by_range(batches):
        if kind == OWN:
            rows = Rows()
            for number, blob in blobs:
                rows.add(OWN, 0, 0, number, blob)
            yield rows.batch()
            continue
        c, numbers = Contexts.read(blobs), np.array([number for number, _ in blobs], np.int64)
        anchor = c.anchors()
        by = np.argsort(anchor, kind="stable")
        a = anchor[by]
        cut = np.append(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a))
        lo = 0
        while lo < len(by):  # whole groups, about TOGETHER contexts at a time
            hi = int(cut[min(np.searchsorted(cut, lo + TOGETHER), len(cut) - 1)])
            part = by[lo:hi]
            lo = hi
            entry, x, y, doc = shared_strings(anchor[part], c.data, c.start[part], c.size[part], c.lead[part], c.least[part])
            found = np.zeros(len(entry), _FOUND)
            found["entry"], found["lo"], found["hi"], found["least"] = c.entry[part][entry], x, y, doc
            held.append((numbers[c.of[part][entry]], found))
            n += len(entry)
            if n >= most:
                yield told(held)
                held, n = [], 0
    if held:
        yield told(held)


def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each pack, from (packs, found strings)."""
    number, found = (np.concatenate(c) for c in zip(*held))
    rows = Rows()
    for k in _by_pack(number):
        rows.add(ASK, 0, 0, int(number[k[0]]), found[k].tobytes())
    return rows.batch()


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """docs with the text's remaining bytes, and n_bytes, n_removed, spans behind its columns.

    Texts are UTF-8 bytes (null: empty); matches never cross documents. Strings are judged on the input.
    The text column becomes binary, since a cut can fall inside a character; spans are the maximal removed
    runs (start, end) in bytes. With `whole`, the text loses the rest of a character that was cut, too. Rows that repeat a key hold no smaller key than each other, so only smaller
    keys take bytes from them; a row with a null key keeps its text and takes nothing from others. Other
    columns stay; those named like a result are replaced.
    """
    names = ["n_bytes", "n_removed", "spans", text]
    keep = [c for c in docs.columns if c not in names]
    src = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    packs = stage(pack_documents(src))
    total = packs.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(RANGES - 1, total // RANGE_BYTES).bit_length()
    hot = HOT

    def send_anchors(batches):
        for b in batches:
            for _, number, pack in _packs(b):
                rows, h = Rows(), pack.anchors()
                for r, part in _split(h, bits):
                    rows.add(ASK, r, 0, number, h[part].tobytes())
                yield rows.batch()

    def find_shared(batches):
        for _, blobs in by_range(batches):
            h = np.concatenate([np.frombuffer(b, U) for _, b in blobs])
            by = np.argsort(h, kind="stable")
            s = h[by] & ~PARTS
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(np.append(first, len(s)))
            own = np.maximum.reduceat(h[by] & U(1), first)
            halved = np.minimum(31, np.ceil(np.log2(np.maximum(1, n / hot)))).astype(np.int8)
            state = np.empty(len(h), np.int8)
            state[by] = np.repeat(np.where((n > 1) | (own == 1), halved, -1), n)
            rows, at = Rows(), 0
            for number, blob in blobs:
                end = at + len(blob) // 8
                k = np.flatnonzero(state[at:end] >= 0) + at
                at = end
                if len(k):
                    rows.add(ASK, 0, int(state[k].max()), number, ((h[k] & ~PARTS) | state[k].astype(U)).tobytes())
            yield rows.batch()

    sent = packs.select("pack", "ids", "lens", "data").mapInArrow(send_anchors, BLOB)
    shared = to_ranges(sent).mapInArrow(find_shared, BLOB).groupBy("pack").agg(F.collect_list("blob").alias("shared"), F.max("part").alias("halved"))
    shared = stage(shared)
    source = packs.join(shared, "pack").select("pack", "ids", "lens", "data", "shared", "halved")

    def send_contexts(of_hot):
        def run(batches):
            for b in batches:
                got = b.column(b.schema.names.index("shared"))
                for i, number, pack in _packs(b):
                    e = pack.entries(np.concatenate([np.frombuffer(x.as_buffer(), U) for x in got[i]]))
                    rows, halved = Rows(), (e.anchor & PARTS).astype(np.int64)
                    spread = int(mix(np.array([number]).astype(U))[0])
                    ask = np.flatnonzero((halved > 0) == of_hot)
                    if not of_hot:
                        place, entries = np.zeros(len(e.begin), _PLACE), np.zeros(len(e.size), _ENTRY)
                        place["begin"], place["entry"], entries["size"] = np.diff(e.begin, prepend=0).astype("<u4"), e.entry, e.size
                        by = np.argsort(pack.ids, kind="stable")
                        entries["doc"] = by[np.searchsorted(pack.ids[by], e.least)]
                        rows.add(OWN, spread & 0xFFFF, 0, number, pressed(len(place).to_bytes(8, "little") + place.tobytes() + entries.tobytes()))
                    for r, part in _split(e.anchor[ask], bits):
                        part = ask[part]
                        for k in np.unique(halved[part]).tolist():
                            some = part[halved[part] == k]
                            n = e.size[some]
                            at = np.repeat(e.start[some] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
                            rows.add(ASK, r, (k << 26 | spread & (1 << min(k, 26)) - 1) if k else 0, number, write_contexts(e.least[some], some, n, e.lead[some], pack.data[at]))
                    yield rows.batch()

        return run

    def merge(batches):
        for (_, r, part), blobs in by_range(batches):
            c = Contexts.read(blobs)
            first, same = distinct_spans(mix(row_hashes(c.data, c.start, c.start + c.size) ^ (c.size.astype(U) << U(32)) ^ c.lead.astype(U)), c.data, c.start, c.start + c.size, c.start + c.lead)
            low = np.full(len(first), FAR)
            np.minimum.at(low, same, c.least)
            rows, own = Rows(), merged_id(r, part)
            rows.add(ASK, r, 0, own, write_contexts(low, np.arange(len(first)), c.size[first], c.lead[first], c.bytes_of(first)))
            for k in _by_pack(c.of):
                to = np.zeros(len(k), _MERGED)
                to["entry"], to["to"] = c.entry[k], same[k]
                # what the part itself knows of its packs' contexts
                f = np.zeros(len(k), _FOUND)
                f["entry"], f["hi"], f["least"] = c.entry[k], c.size[k], low[same[k]]
                rows.add(MERGED, own, 0, blobs[c.of[k[0]]][0], to.tobytes())
                f = f[f["least"] < c.least[k]]
                if len(f):
                    rows.add(OWN, own, 1, blobs[c.of[k[0]]][0], f.tobytes())
            yield rows.batch()

    asked, scratch = source.mapInArrow(send_contexts(False), BLOB), []
    parts = None
    if not shared.where("halved > 0").isEmpty():
        parts = stage(to_ranges(source.where("halved > 0").mapInArrow(send_contexts(True), BLOB)).mapInArrow(merge, BLOB))
        scratch.append(parts)
        asked = asked.unionByName(parts.where(F.col("kind") == ASK))
    found = to_ranges(asked).mapInArrow(compare, BLOB)
    if parts is not None:
        found = stage(found)
        scratch.append(found)
        said = found.where("pack < 0").groupBy("pack").agg(F.collect_list("blob").alias("found")).withColumnRenamed("pack", "m")

        def forward(batches):
            for b in batches:
                rows = Rows()
                for number, to, found_ in zip(*b.columns):
                    to = np.sort(np.frombuffer(to.as_buffer(), _MERGED), order="to")
                    f = np.concatenate([np.frombuffer(x.as_buffer(), _FOUND) for x in found_])
                    lo, hi = (np.searchsorted(to["to"], f["entry"], side=s) for s in ("left", "right"))
                    rep = np.repeat(np.arange(len(f)), hi - lo)
                    out = f[rep]
                    out["entry"] = to["entry"][np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)])[:-1], hi - lo) + np.arange(len(rep))]
                    if len(out):
                        rows.add(ASK, 0, 0, number.as_py(), out.tobytes())
                yield rows.batch()

        members = parts.where(F.col("kind") == MERGED).select(F.col("range").alias("r"), "pack", F.col("blob").alias("to"))
        told = members.join(said, F.col("r") == F.col("m")).select("pack", "to", "found").mapInArrow(forward, BLOB)
        within = parts.where((F.col("kind") == OWN)).withColumn("kind", F.lit(ASK))
        found = found.where("pack >= 0").unionByName(told).unionByName(within)
    found = stage(found.groupBy("pack").agg(F.collect_list(F.struct("kind", "blob")).alias("found")))
    drop_stage(shared, *scratch)
    schema = docs.select(*keep).schema.add(text, BinaryType()).add("n_bytes", LongType()).add("n_removed", LongType()).add("spans", ArrayType(StructType().add("start", LongType()).add("end", LongType())))

    def cut(table: pa.Table) -> pa.Table:
        out = []
        for b in table.to_batches():
            told_ = b.column(b.schema.names.index("found"))
            for i in range(b.num_rows):
                ids, lens, data = _unpacked(b, i)
                out.append(results(b, i, lens, data, removed(ids, lens, told_[i], len(data)), schema, keep, whole))
        # grouped functions have to give timestamps in UTC, whatever the session's zone that they got them in
        return pa.Table.from_batches(out).cast(to_arrow_schema(schema))

    # a group for each pack: a batch of many packs would be many megabytes, whatever limit the caller sets
    return packs.join(found, "pack", "left").select("pack", "ids", "lens", "rows", "data", "found").groupBy("pack").applyInArrow(cut, schema)


def removed(ids: np.ndarray, lens: np.ndarray, told: pa.Scalar, n: int) -> np.ndarray:
    """Which of a pack's n bytes the strings cover that it was told of, or that it holds twice itself."""
    gone = np.zeros(n, bool)
    if not told.is_valid:
        return gone
    known = ids != NO_ID
    ids, off = ids[known], np.concatenate([[0], np.cumsum(lens[known])]).astype(np.int64)
    begin = entry = np.zeros(0, np.int64)
    found = [np.zeros(0, _FOUND)]
    for x in told:
        raw = x["blob"].as_buffer()
        if x["kind"].as_py() == OWN:
            raw = unpressed(raw.to_pybytes())
            k = int.from_bytes(raw[:8], "little")
            place, own = np.frombuffer(raw, _PLACE, k, 8), np.frombuffer(raw, _ENTRY, -1, 8 + k * _PLACE.itemsize)
            begin, entry = np.cumsum(place["begin"].astype(np.uint32), dtype=np.uint32).astype(np.int64), place["entry"].astype(np.int64)
            f = np.zeros(len(own), _FOUND)
            f["entry"], f["hi"], f["least"] = np.arange(len(own)), own["size"], ids[own["doc"]]
            found.append(f)
        else:
            found.append(np.frombuffer(raw, _FOUND))
    f = np.concatenate(found)
    f = f[np.argsort(f["entry"], kind="stable")]
    lo, hi = (np.searchsorted(f["entry"], entry, side=s) for s in ("left", "right"))
    rep = np.repeat(np.arange(len(entry)), hi - lo)
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)])[:-1], hi - lo) + np.arange(len(rep))
    use = f["least"][at] < ids[(np.searchsorted(off, begin, side="right") - 1)[rep]]
    rep, at = rep[use], at[use]
    edge = np.bincount(begin[rep] + f["lo"][at], minlength=off[-1] + 1) - np.bincount(begin[rep] + f["hi"][at], minlength=off[-1] + 1)
    gone[np.repeat(known, lens)] = np.cumsum(edge)[:-1] > 0
    return gone


def results(b: pa.RecordBatch, i: int, lens: np.ndarray, data: np.ndarray, gone: np.ndarray, schema: StructType, keep: list[str], whole: bool = False) -> pa.RecordBatch:
    off = np.concatenate([[0], np.cumsum(lens)])
    raw, texts, cut, spans = data.tobytes(), [], [], []
    for a, z in zip(off, off[1:]):
        m = gone[a:z]
        if not m.any():
            texts.append(raw[a:z])
            cut.append(0)
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
        left = data[a:z][~m].tobytes()
        texts.append(left.decode("utf-8", "ignore").encode() if whole else left)
        cut.append(int(m.sum()))
        spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
    rows = b.column(b.schema.names.index("rows"))[i].values
    cols = [rows.field(k) for k in range(len(keep))]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary()), pa.array(lens, pa.int64()), pa.array(cut, pa.int64()), pa.array(spans, kind)], names=schema.names)
