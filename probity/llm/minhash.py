"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Two collections of GROUPS groups of WIDTH minhashes; each pair of a group of the first and one of the
second is the key of one of GROUPS**2 tables, so the tables cost 2 * GROUPS * WIDTH minhashes instead of
2 * WIDTH * GROUPS**2. A pair of similarity J meets in a table unless one collection has no equal group:
at J = 0.85 with a chance below 1e-4.

A table's bucket is searched without listing its pairs: all members are verified against the bucket's
least document, then, where a bucket is left in several components, against its most central one (least share
of shingles that no other open document holds). What is still apart meets by prefix filtering, which is exact:
with each document's shingles in order of their frequency, two linked documents share one so early that the
shingles behind it could still make up the overlap.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from probity.llm.common import drop_stage, mix, slices, stage, utf8
from probity.llm.components import components

WORDS = 5
GROUPS, WIDTH = 8, 2
HASHES = 2 * GROUPS * WIDTH
SEED = 1234567
#: Least similarity in per cent that the tables are laid out for.
LEAST_PERCENT = 80


def separators() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the rows' bytes, A-Z lower-cased: a polynomial prefix hash of the bytes,
    mixed with the word's length."""
    rng = np.random.default_rng(SEED)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = ~separators()[data]
    edge = np.flatnonzero(row[1:] != row[:-1]) + 1
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edge] |= inside[edge]
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] |= inside[edge - 1]
    last = np.flatnonzero(stop) + 1
    power = np.ones(n, dtype=np.uint64)
    power[1:] = base
    np.multiply.accumulate(power, out=power)
    inverse = np.ones(n, dtype=np.uint64)
    inverse[1:] = pow(base, -1, 1 << 64)
    np.multiply.accumulate(inverse, out=inverse)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value[data] * power, out=prefix[1:])
    h = (prefix[last] - prefix[first]) * inverse[first]
    return mix(h ^ (np.uint64(0x9E3779B97F4A7C15) * (last - first).astype(np.uint64))), row[first]


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words; of all the words of a row that has fewer."""
    h, row = word_hashes(data, off)
    n = np.bincount(row, minlength=len(off) - 1)
    odd = np.random.default_rng(SEED + 1).integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    rank = np.arange(len(h)) - first[row]
    full = np.flatnonzero(rank + k <= n[row])
    out = np.zeros(len(full), dtype=np.uint64)
    for j in range(k):
        out += h[full + j] * odd[j]
    short = np.flatnonzero((n > 0) & (n < k))
    extra = np.zeros(len(short), dtype=np.uint64)
    for j in range(k - 1):
        has = n[short] > j
        extra[has] += h[first[short[has]] + j] * odd[j]
    extra += n[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    hashes, rows = np.concatenate([mix(out), mix(extra)]), np.concatenate([row[full], short])
    by = np.argsort(rows, kind="stable")
    return hashes[by], rows[by]


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, row) to (doc_id, row, n_shingles, d1, d2, sig): the set's size, 128 bits of it, and
    its minhashes."""
    schema = docs.select("doc_id", "row").schema
    for name in ("n_shingles", "d1", "d2"):
        schema = schema.add(name, "long")
    schema = schema.add("sig", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED + 2)
        mul = rng.integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                sig = np.zeros((n, HASHES), dtype=np.uint32)
                full, sets = distinct_sets(*utf8(part.column(1)))
                if len(full):
                    size[full] = [len(x) for x in sets]
                    h = np.concatenate(sets)
                    first = np.concatenate([[0], np.cumsum(size[full])])[:-1]
                    d1[full] = np.add.reduceat(mix(h), first)
                    d2[full] = np.bitwise_xor.reduceat(mix(h ^ np.uint64(SEED)), first)
                    for j in range(HASHES):
                        sig[full, j] = np.minimum.reduceat(((h * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), first)
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, HASHES, dtype=np.int32)), pa.array(sig.ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sigs], names=["doc_id", "row", "n_shingles", "d1", "d2", "sig"])

    return docs.select("doc_id", "text", "row").mapInArrow(run, schema)


def distinct_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that have shingles, and the sorted distinct shingle hashes of each."""
    h, row = shingles(data, off)
    if not len(h):
        return np.zeros(0, np.int64), []
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[first], [np.unique(x) for x in np.split(h, first[1:])]


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, set): the distinct shingle hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                full, sets = distinct_sets(*utf8(part.column(1)))
                if len(full):
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, set array<long>")


def _group_keys(nodes: DataFrame, side: int) -> DataFrame:
    """(node, key): a key for each group of one collection."""
    keys = [F.xxhash64(F.lit(side * GROUPS + g), *[F.col("sig")[(side * GROUPS + g) * WIDTH + w] for w in range(WIDTH)]) for g in range(GROUPS)]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of keys whose key another row has, too."""
    common = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return keys.join(common, "key", "left_semi")


def tensor_keys(nodes: DataFrame) -> DataFrame:
    """(node, key): the table keys of the nodes that share a group of either collection. Other nodes meet
    no other one in any table."""
    left = stage(_shared(_group_keys(nodes, 0)).groupBy("node").agg(F.collect_list("key").alias("left")))
    some = nodes.join(left.select("node"), "node", "left_semi")
    right = _shared(_group_keys(some, 1)).groupBy("node").agg(F.collect_list("key").alias("right"))
    both = left.join(right, "node").select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r"))
    return both.select("node", F.xxhash64("l", "r").alias("key"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and minhashes allow: as many equal minhashes as six standard deviations
    below the mean at the similarity of `percent`."""
    p = percent / 100
    least = int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("a_n"), F.col("sig").alias("a_sig"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("b_n"), F.col("sig").alias("b_sig"))
    equal = F.size(F.filter(F.zip_with("a_sig", "b_sig", lambda x, y: x == y), lambda e: e))
    fit = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return pairs.join(a, "a").join(b, "b").where(fit & (equal >= least)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * |intersection| >= percent * |union|."""
    a = sets.select(F.col("doc_id").alias("a_id"), F.col("set").alias("a_set"))
    b = sets.select(F.col("doc_id").alias("b_id"), F.col("set").alias("b_set"))
    joined = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return joined.where(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, comp) of the buckets that hold several components."""
    of = label.select(F.col("node").alias("l_node"), F.col("comp").alias("l_comp"))
    placed = members.select("key", "node").join(of, F.col("node") == F.col("l_node"), "left").select("key", "node", F.coalesce("l_comp", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return stage(placed.join(mixed, "key", "left_semi"))


def _rare_first(sets: DataFrame) -> DataFrame:
    """(doc, n, own, shared): the size of each set, how many of its shingles no other set holds, and the others
    as (count, shingle), rarest first."""
    each = stage(sets.select(F.col("doc_id").alias("doc"), F.explode("set").alias("s")))
    counts = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select(F.col("s").alias("c_s"), "c")
    shared = each.join(counts, F.col("s") == F.col("c_s")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("shared"))
    out = stage(sets.select(F.col("doc_id").alias("d"), F.size("set").alias("n")).join(shared, F.col("d") == F.col("doc"), "left").select(F.col("d").alias("doc"), "n", (F.col("n") - F.coalesce(F.size("shared"), F.lit(0))).alias("own"), "shared"))
    drop_stage(each)
    return out


def _apart(rest: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in open buckets that prefix filtering can't rule out."""
    comps = rest.groupBy("key", "comp").agg(F.count("*").alias("members"))
    main = comps.groupBy("key").agg(F.max(F.struct("members", "comp"))["comp"].alias("main"))
    # one of two linked documents of a bucket is outside of the bucket's largest component
    docs = rest.join(main, "key").groupBy("node").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("out"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = docs.join(ranked, F.col("node") == F.col("doc")).where(F.col("own") < prefix)
    rows = rows.select("node", "comp", "out", "n", "own", F.posexplode(F.slice("shared", F.lit(1), (prefix - F.col("own")).cast("int"))).alias("i", "x"))
    rows = stage(rows.select("node", "comp", "out", "n", (F.col("own") + F.col("i") + 1).alias("pos"), F.col("x.s").alias("s")))
    x = rows.where("out").select(F.col("node").alias("a"), F.col("comp").alias("a_comp"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("s").alias("a_s"))
    fit = (F.col("s") == F.col("a_s")) & (F.col("comp") != F.col("a_comp")) & (~F.col("out") | (F.col("node") > F.col("a")))
    fit &= 100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")
    fit &= (100 + percent) * (1 + F.least(F.col("n") - F.col("pos"), F.col("a_n") - F.col("a_pos"))) >= percent * (F.col("n") + F.col("a_n"))
    pairs = stage(x.join(rows, fit).select("a", F.col("node").alias("b")).distinct())
    drop_stage(rows)
    return pairs


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85) -> DataFrame:
    """docs without its text, with n_shingles, component_id and kept behind its columns.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct shingles
    of WORDS words, or all its words as one shingle if it has fewer. Two documents are linked if 100 times
    their intersection is at least percent times their union. component_id: the least key that links reach;
    kept: whether it is the row's own. Null, empty and blank texts have no set and are linked with nothing.
    Documents with equal sets are linked. percent is LEAST_PERCENT at least. Each row has its own text's result, also where rows repeat a key.
    A row with a null key takes the component of an equal set, else null (kept then). Columns of docs
    named like a result are replaced.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the tables find similarities of {LEAST_PERCENT} per cent and more")
    names = ["n_shingles", "component_id", "kept"]
    keep = [c for c in docs.columns if c not in (text, *names)]
    src = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    sig = stage(signatures(src))
    alike = stage(sig.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    one = alike.select("d1", "d2", F.col("node").alias("doc_id"))
    nodes = stage(sig.join(one, ["d1", "d2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sig").dropDuplicates(["node", "sig"]))
    keys = stage(tensor_keys(nodes))
    buckets = stage(keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub"))
    members = stage(keys.join(buckets, "key"))
    drop_stage(keys)
    sets = stage(shingle_sets(src.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")))
    star = members.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(_verified(_likely(star, nodes, percent), sets, percent))
    label = components(links)
    rest = _open(members, label)
    if not rest.isEmpty():
        inside = rest.select(F.col("node").alias("doc_id")).distinct()
        ranked = _rare_first(sets.join(inside, "doc_id", "left_semi"))
        share = ranked.select("doc", (F.col("own") / F.col("n")).alias("share"))
        center = rest.join(share, F.col("node") == F.col("doc")).groupBy("key").agg(F.min(F.struct("share", "node", "comp")).alias("m")).select("key", F.col("m.node").alias("a"), F.col("m.comp").alias("a_comp"))
        star = rest.join(center, "key").where("comp <> a_comp").select("a", F.col("node").alias("b")).distinct()
        links = stage(links.unionByName(_verified(_likely(star, nodes, percent), sets, percent)))
        drop_stage(label, rest)
        label = components(links)
        rest = _open(members, label)
        more = stage(_verified(_likely(_apart(rest, ranked, percent), nodes, percent), sets, percent))
        if not more.isEmpty():
            drop_stage(label)
            label = components(links.unionByName(more))
        drop_stage(ranked, more)
    drop_stage(members, rest, sets, nodes, links)

    # back to every row, by its text's set
    named = alike.join(label, "node", "left").select(F.col("d1").alias("n1"), F.col("d2").alias("n2"), F.coalesce("comp", "node").alias("comp"))
    out = sig.join(named, (sig["d1"] == named["n1"]) & (sig["d2"] == named["n2"]) & (sig["n_shingles"] > 0), "left")
    component = F.coalesce(F.col("comp"), F.col("doc_id"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
