"""Approximate nearest neighbours: a neighbour graph by NN-descent, greedy search in it.

Rows of equal vectors are one node. The graph starts from small blocks of nodes whose random-projection codes
agree, then improves by rounds of local joins: each node's neighbours and reverse neighbours are compared
with each other, two that both were there in the round before excepted, and those nearer than a node's
farthest neighbour are proposed to it, until a round changes less than CHANGED of all neighbours. So a node
around which nothing has changed takes no part in a round. A query starts at its own node's neighbours and, round by
round, expands the nearest nodes that it hasn't expanded, until a round leaves its TOP as they were.

A node's neighbours are those of the largest inner product with it, which its own length doesn't change: the
product of their directions (float16) times the other one's length (double). So a vector of any length
leaves the precision of all others as it is. Only the order of candidates is approximate: scores are inner
products of the original vectors in double precision.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import drop_stage, stage

#: Neighbours and sampled reverse neighbours of a node; first blocks' trees and size.
K, REVERSE, TREES, BLOCK = 32, 16, 2, 256
#: Local joins end with the round that changes a smaller share of all neighbours.
CHANGED = 0.005
#: What a center proposes to a member: its nearest, and as many of the others, another draw each round.
PROPOSED = 8
#: Proposals that a task gathers before it hands on the best of each member.
HELD = 200_000
#: Search: nodes kept for each query, nodes expanded in a round, rounds at least.
POOL, EXPAND, HOPS = 192, 48, 2
TOP = 20
SEED = 5


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v): the float64 bytes of each key's usable vector; the least ones where a key has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not x or any(y is None for y in x):
                    continue
                a = np.array(x, dtype=np.float64) + 0.0
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    vs.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary())], names=["id", "v"])

    return vectors.select(vectors[key].cast("long").alias("id"), vectors[vec].alias("vec")).mapInArrow(run, "id long, v binary").groupBy("id").agg(F.min("v").alias("v"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """rows(id, v) to (node, ids, v): a row for each distinct vector, and its TOP + 1 least ids.

    Ids of one vector are thinned out by parts first, so no task collects all of a large group."""
    least = lambda c: F.slice(F.array_sort(c), 1, TOP + 1)
    part = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")).agg(F.collect_list("id").alias("ids"))
    part = part.select("v", least("ids").alias("ids"))
    return part.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v")


def _lists(ids: list, sims: list) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))]


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids of the highest sims; ties to the smaller id."""
    by = np.lexsort((ids, -sims))
    ids, sims = ids[by], sims[by]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], sims[first]


def _merge(parts: DataFrame) -> DataFrame:
    """Lists (node, ids, sims) of the same node become one of its K best."""

    def run(batches):
        for b in batches:
            nodes, ids, sims = [], [], []
            for node, many, values in zip(*(c.to_pylist() for c in b.columns)):
                i, s = _best(np.concatenate([np.array(x, np.int64) for x in many]), np.concatenate([np.array(x, np.float64) for x in values]), K)
                nodes.append(node)
                ids.append(i)
                sims.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *_lists(ids, sims)], names=["node", "ids", "sims"])

    return parts.groupBy("node").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims")).mapInArrow(run, "node long, ids array<long>, sims array<double>")


def directions(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float16).reshape(len(cells), -1).astype(np.float32)


def first_graph(points: DataFrame, n: int, dim: int) -> DataFrame:
    """The K best of each node among the nodes of its blocks, one block for each tree."""
    bits = max(0, round(np.log2(max(1, n / (0.6 * BLOCK)))))

    def codes(batches):
        planes = np.random.default_rng(SEED).normal(size=(dim, TREES * max(1, bits)))
        for b in batches:
            if not b.num_rows:
                continue
            side = (directions(b.column(1).to_pylist()) @ planes > 0).reshape(b.num_rows, TREES, -1)[:, :, :bits].astype(np.int64)
            code = (side << np.arange(bits)).sum(2) if bits else np.zeros((b.num_rows, TREES), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(code[:, t]) for t in range(TREES))], names=["node", "h", "m", *(f"c{t}" for t in range(TREES))])

    coded = points.select("node", "h", "m").mapInArrow(codes, "node long, h binary, m double, " + ", ".join(f"c{t} long" for t in range(TREES)))
    rows = stage(coded.select("node", "h", "m", F.posexplode(F.array(*[F.col(f"c{t}") for t in range(TREES)])).alias("tree", "code")))
    sizes = rows.groupBy("tree", "code").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / BLOCK)).select(F.col("tree").alias("t"), F.col("code").alias("c"), "parts")
    placed = rows.join(sizes, (F.col("tree") == F.col("t")) & (F.col("code") == F.col("c"))).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    blocks = placed.groupBy("tree", "code", "part").agg(F.collect_list(F.struct("node", "h", "m")).alias("b")).select("b.node", "b.h", "b.m")

    def inside(batches):
        for b in batches:
            for nodes, hs, ms in zip(*b.columns):
                ids, m = nodes.values.to_numpy(), ms.values.to_numpy()
                x = directions(hs.values.to_pylist())
                s = (x @ x.T) * m
                np.fill_diagonal(s, -np.inf)
                k = min(K, len(ids) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *_lists(list(ids[top]), list(np.take_along_axis(s, top, 1)))], names=["node", "ids", "sims"])

    graph = _merge(blocks.mapInArrow(inside, "node long, ids array<long>, sims array<double>"))
    graph = stage(graph.withColumn("fresh", F.transform("ids", lambda _: F.lit(True))))
    drop_stage(rows)
    return graph


def improved(graph: DataFrame, points: DataFrame, turn: int) -> DataFrame:
    """One round of NN-descent: neighbours of each node, either way, are joined with each other."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("to"), F.col("e.fresh").alias("is_fresh"))
    # reverse neighbours: a sample of the new and one of the old, others each round; how many a node has only
    # sets the sample's share
    many = edges.groupBy(F.col("to").alias("m_to"), F.col("is_fresh").alias("m_fresh")).agg(F.count("*").alias("many"))
    r = F.xxhash64("node", F.lit(turn))
    some = edges.join(many, (F.col("to") == F.col("m_to")) & (F.col("is_fresh") == F.col("m_fresh"))).where(F.pmod(r, F.col("many")) < 2 * REVERSE)
    sample = lambda which: F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("is_fresh") == which, F.struct(r.alias("r"), "node")))), 1, REVERSE), lambda x: F.struct(x["node"].alias("member"), F.lit(which).alias("is_fresh")))
    back = some.groupBy(F.col("to").alias("b")).agg(F.concat(sample(True), sample(False)).alias("in"))
    own = F.transform(F.arrays_zip("ids", "fresh"), lambda x: F.struct(x["ids"].alias("member"), x["fresh"].alias("is_fresh")))
    itself = F.array(F.struct(F.col("node").alias("member"), F.lit(False).alias("is_fresh")))
    around = graph.join(back, F.col("node") == F.col("b"), "left").select(F.col("node").alias("center"), F.concat(own, F.coalesce("in", F.slice(itself, 1, 0)), itself).alias("all"))
    around = around.where(F.exists("all", lambda x: x["is_fresh"])).select("center", F.inline("all"))
    worst = F.when(F.size("ids") < K, F.lit(float("-inf"))).otherwise(F.element_at("sims", -1)).alias("worst")
    state = points.join(graph, "node").select("node", "h", "m", worst)
    joined = around.join(state, F.col("member") == F.col("node")).groupBy("center").agg(F.collect_list(F.struct("member", "h", "m", "worst", "is_fresh")).alias("x")).select("x.member", "x.h", "x.m", "x.worst", "x.is_fresh")

    def told(held: dict[int, list]) -> pa.RecordBatch:
        # the best of each node, so that a node that many others have gets few rows
        kept = [_best(*(np.concatenate(c) for c in zip(*parts)), K) for parts in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *_lists([i for i, _ in kept], [v for _, v in kept])], names=["node", "ids", "sims"])

    def local(batches):
        rng = np.random.default_rng(turn)
        held: dict[int, list] = {}
        count = 0
        for b in batches:
            for member, h, m, worst, new in zip(*b.columns):
                ids, new = member.values.to_numpy(), new.values.to_numpy(zero_copy_only=False)
                # a member that is there both ways counts once, as new if it is so either way
                by = np.lexsort((~new, ids))
                by = by[np.diff(ids[by], prepend=ids[by[0]] - 1) != 0]
                ids, new, m = ids[by], new[by], m.values.to_numpy()[by]
                x = directions(h.values.take(pa.array(by)).to_pylist())
                s = (x @ x.T) * m
                np.fill_diagonal(s, -np.inf)
                good = (s > worst.values.to_numpy()[by][:, None]) & (new[:, None] | new)
                best = np.where(good, s, -np.inf)
                # the nearest may be known to the member already; a draw of the others gets its turn, too
                draw = np.where(good, rng.random(s.shape, dtype=np.float32), np.float32(-1))
                p = min(PROPOSED, len(ids) - 1)
                pick = np.hstack([np.argpartition(-best, p - 1, axis=1)[:, :p], np.argpartition(-draw, p - 1, axis=1)[:, :p]]) if p > 0 else np.zeros((len(ids), 0), np.int64)
                there = np.take_along_axis(good, pick, 1)
                found, values = ids[pick], np.take_along_axis(s, pick, 1)
                for i in np.flatnonzero(there.any(1)):
                    k = there[i]
                    held.setdefault(int(ids[i]), []).append((found[i][k], values[i][k]))
                    count += 1
            if count >= HELD:
                yield told(held)
                held, count = {}, 0
        if held:
            yield told(held)

    new = joined.mapInArrow(local, "node long, ids array<long>, sims array<double>")
    better = _merge(graph.select("node", "ids", "sims").unionByName(new))
    was = graph.select(F.col("node").alias("was"), F.col("ids").alias("had"))
    marked = F.transform("ids", lambda i: ~F.array_contains("had", i))
    return stage(better.join(was, F.col("node") == F.col("was")).select("node", "ids", "sims", marked.alias("fresh")))


def changed(graph: DataFrame) -> float:
    """The share of the graph's neighbours that the round before didn't have."""
    return graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))) / F.sum(F.size("ids"))).first()[0] or 0.0


def search(graph: DataFrame, points: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(q, qh) to (q, ids): the nearest nodes that greedy search finds, POOL at least, the start included.

    After HOPS rounds, a query ends with the round that leaves its TOP nearest as they were; the others go on
    with a wider pool."""
    state = stage(queries.join(graph, F.col("q") == F.col("node")).select("q", "qh", F.concat(F.array("q"), "ids").alias("ids"), F.concat(F.array(F.lit(float("inf"))), "sims").alias("sims"), F.array("q").alias("done"), F.lit(False).alias("ended")))
    hop = 0
    while hop < HOPS or not state.where("not ended").isEmpty():
        open_ = F.slice(F.array_except("ids", "done"), 1, EXPAND)
        front = state.where("not ended").select("q", F.explode(open_).alias("f"))
        near = front.join(graph, F.col("f") == F.col("node")).groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("reached"))
        fresh = state.join(near.withColumnRenamed("q", "nq"), F.col("q") == F.col("nq")).select("q", F.explode(F.array_except("reached", "ids")).alias("w"))
        found = fresh.join(points.select(F.col("node").alias("p"), "h", "m"), F.col("w") == F.col("p")).groupBy("q").agg(F.collect_list(F.struct("w", "h", "m")).alias("x")).select(F.col("q").alias("wq"), "x.w", "x.h", "x.m")
        rows = state.withColumn("done", F.when(F.col("ended"), F.col("done")).otherwise(F.array_union("done", open_))).join(found, F.col("q") == F.col("wq"), "left").select("q", "qh", "ids", "sims", "done", "w", "h", "m")

        def step(batches, hop=hop):
            pool = POOL + EXPAND * max(0, hop + 1 - HOPS)
            for b in batches:
                ids, sims, ended = [], [], []
                for qh, i, s, w, h, m in zip(b.column(1), b.column(2), b.column(3), b.column(5), b.column(6), b.column(7)):
                    i, s = i.values.to_numpy(), s.values.to_numpy()
                    top = set(i[: TOP + 1].tolist())
                    if w.is_valid and len(w):
                        new = w.values.to_numpy()
                        sim = (directions(h.values.to_pylist()) @ directions([qh.as_py()])[0]) * m.values.to_numpy()
                        i, s = _best(np.concatenate([i, new]), np.concatenate([s, sim]), pool)
                    ids.append(i)
                    sims.append(s)
                    ended.append(hop + 1 >= HOPS and top == set(i[: TOP + 1].tolist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_lists(ids, sims), b.column(4), pa.array(ended, pa.bool_())], names=["q", "qh", "ids", "sims", "done", "ended"])

        new = stage(rows.mapInArrow(step, "q long, qh binary, ids array<long>, sims array<double>, done array<long>, ended boolean"))
        drop_stage(state)
        state = new
        hop += 1
    return state.select("q", "ids")


def nearest(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the TOP rows nearest to each row whose key is divisible by `every`.

    Nearness is the inner product. Candidates are all rows but the query's own, equal vectors included;
    equal scores go to the smaller key. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, neither do those of another dimension than the commonest, nor null keys.
    A repeated key is one row, that of the least vector (by its bytes). An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, key, vec))
    per = rows.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not per:
        return spark.createDataFrame([], schema)
    size = per[0][0]
    rows = rows.where(F.length("v") == size)
    nodes = stage(nodes_of(rows))

    def split(batches):
        for b in batches:
            h, m = [], []
            for v in b.column(1).to_pylist():
                x = np.frombuffer(v, np.float64)
                top = np.abs(x).max()
                length = np.linalg.norm(x / top)
                h.append((x / top / length).astype(np.float16).tobytes())
                m.append(top * length)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary()), pa.array(m, pa.float64())], names=["node", "h", "m"])

    points = stage(nodes.select("node", "v").mapInArrow(split, "node long, h binary, m double"))
    graph = first_graph(points, nodes.count(), size // 8)
    turn, share = 0, 1.0
    while share >= CHANGED:
        better = improved(graph, points, turn)
        share = changed(better)
        drop_stage(graph)
        graph = better
        turn += 1
    # every usable row of the query set, by its node
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    asked = stage(asked.join(nodes.select(F.col("node").alias("q"), F.col("v").alias("nv")), F.col("qv") == F.col("nv")).select("query_id", "q"))
    starts = stage(asked.select("q").distinct().join(points.select("node", F.col("h").alias("qh")), F.col("q") == F.col("node")).select("q", "qh"))
    found = search(graph, points, starts)
    exact = nodes.select("node", "ids", "v")
    pairs = found.select("q", F.explode("ids").alias("c")).join(exact, F.col("c") == F.col("node")).groupBy("q").agg(F.collect_list("ids").alias("ids"), F.collect_list("v").alias("vs"))
    with_query = pairs.join(exact.select(F.col("node").alias("qn"), F.col("v").alias("qv")), F.col("q") == F.col("qn")).select("q", "qv", "ids", "vs")

    def rank(batches):
        for b in batches:
            ids, scores = [], []
            for qv, many, vs in zip(b.column(1), b.column(2), b.column(3)):
                v = np.frombuffer(qv.as_buffer(), np.float64)
                i, s = [], []
                for own, x in zip(many.as_py(), vs.as_py()):
                    i += own
                    s += [float(np.dot(np.frombuffer(x, np.float64), v))] * len(own)
                by = np.lexsort((np.array(i), -np.array(s)))[: TOP + 1]
                ids.append([i[k] for k in by])
                scores.append([s[k] for k in by])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["n", "ids", "scores"])

    ranked = stage(with_query.mapInArrow(rank, "n long, ids array<long>, scores array<double>"))
    lists = asked.join(ranked, F.col("q") == F.col("n")).select("query_id", F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")).alias("l"))
    return lists.select("query_id", F.posexplode(F.slice("l", 1, TOP)).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
