"""Operators against brute force or held-out labels on the small test data."""
import heapq
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from probity.llm import minhash, mixing, queries, substrings

DATA = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_components(rows, percent):
    """id to least linked id, by comparing all documents that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i in sorted(sets):
        for j, k in Counter(j for g in sets[i] for j in where[g]).items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in sets[i]:
            where[g].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def family(rng, base, n, rate):
    out = []
    for _ in range(n):
        out.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < rate else w for w in base.split()))
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, chains of near copies, many documents with one passage, short texts."""
    rng = random.Random(3)
    make = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    base, passage = make(300), make(80)
    texts = [base] * 40 + family(rng, base, 120, 0.008) + family(rng, base, 40, 0.03) + [make(60) + " " + passage + " " + make(60) for _ in range(60)] + [make(rng.randrange(1, 8)) for _ in range(40)] + ["", None, "one two", "One two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash_equals_brute_force(spark, corpus, percent):
    out = minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5), percent=percent).collect()
    comp, size = plain_components(corpus, percent)
    assert {r["doc_id"]: r["component_id"] for r in out} == comp
    assert {r["doc_id"]: r["n_shingles"] for r in out} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def plain_cuts(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            g = b[k : k + n]
            first[g] = min(i, first.get(g, i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("hot, pack", [(128, 1 << 20), (1, 1 << 12), (3, 1 << 12)])
def test_cuts_equal_brute_force(spark, corpus, monkeypatch, hot, pack):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "PACK", pack)
    rows = corpus + [(1000, "ab" * 200), (1001, "ab" * 90), (1002, "é" * 60), (1003, "xé" + "é" * 60)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = plain_cuts(rows)
    assert {r["doc_id"]: bytes(r["text"]) for r in out} == want
    for r in out:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["text"])


def test_ranges_are_even():
    """Anchors are minima of windows: by their own top bits, the first of 64 ranges would hold over a third."""
    data = np.frombuffer(random.Random(1).randbytes(200_000), np.uint8)
    h = substrings.Pack(np.array([1]), np.array([len(data)]), data).anchors()
    sizes = [len(part) for _, part in substrings._split(h, 6)]
    assert sum(sizes) == len(h) and len(sizes) == 64 and max(sizes) < 2 * len(h) / 64


def test_a_pack_gets_one_row_of_many_ranges():
    """Found strings of 40 ranges and 3 packs: a row for each pack, one string each at the least."""
    rng, rows = random.Random(2), substrings.Rows()
    for r in range(40):
        text = np.frombuffer(bytes(rng.randrange(97, 123) for _ in range(80)), np.uint8)
        for pack in range(3):
            rows.add(substrings.ASK, r, 0, pack, substrings.write_contexts(np.array([pack]), np.array([r]), np.array([80]), np.array([30]), text))
    asked = rows.batch()
    told = [x for b in substrings.compare(iter([asked])) for x in b.to_pylist()]
    assert sorted(x["pack"] for x in told) == [1, 2]
    split = [x for b in substrings.compare(iter([asked]), 1) for x in b.to_pylist()]
    assert len(split) == 80
    for pack in (1, 2):
        one, many = ([np.frombuffer(x["blob"], substrings._FOUND) for x in some if x["pack"] == pack] for some in (told, split))
        assert np.array_equal(np.sort(np.concatenate(one)), np.sort(np.concatenate(many)))
        assert set(one[0]["entry"]) == set(range(40)) and set(one[0]["least"]) == {0}


def test_cuts_keep_columns_and_whole_characters(spark):
    base = "é" * 40 + "x" * 30
    rows = [(1, base, None, [1]), (2, "è" + base[1:], "a", None), (3, "yy", "b", [])]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n array<int>").selectExpr("*", "timestamp_seconds(doc_id) t", "cast(doc_id as decimal(20, 3)) d").repartition(3)
        out = {r["doc_id"]: r for r in substrings.remove_repeats(docs, whole=True).collect()}
        assert {i: (r["lang"], r["n"], r["t"], r["d"]) for i, r in out.items()} == {r["doc_id"]: (r["lang"], r["n"], r["t"], r["d"]) for r in docs.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # 109 bytes behind the other letter's first byte and 1 byte that both letters have in common
    cuts = plain_cuts([r[:2] for r in rows])
    assert {i: bytes(r["text"]) for i, r in out.items()} == {i: b.decode(errors="ignore").encode() for i, b in cuts.items()}


@pytest.mark.parametrize("bits", [64, 8, 2, 0])
def test_equal_hashes_of_different_bytes(monkeypatch, bits):
    """Contexts of one anchor against brute force, with hashes of so many bits that count."""
    mask = np.uint64((1 << bits) - 1)
    for name in ("prefix_hashes", "row_hashes", "span_hashes", "mix"):
        monkeypatch.setattr(substrings, name, lambda *a, f=getattr(substrings, name): f(*a) & mask)
    rng = np.random.default_rng(1)
    gram, words = b"abcdefghijklmnopqrst", [b"aab", b"ab", b"b", b"aabb"]
    bases = [b"".join(words[k] for k in rng.integers(0, 4, 40))[:30] for _ in range(3)]

    def side():
        out = bytearray(bases[rng.integers(3)])
        out[rng.integers(30)] = ord("b")
        return bytes(out)

    texts = [(side()[rng.integers(12) :], side()[: 30 - rng.integers(12)]) for _ in range(150)]
    data = np.frombuffer(b"".join(left + gram + right for left, right in texts), np.uint8)
    lead = np.array([len(left) for left, _ in texts])
    size = np.array([len(left) + 20 + len(right) for left, right in texts])
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    least = rng.permutation(len(texts))
    covered = np.zeros(len(data), bool)
    for e, lo, hi, doc in zip(*substrings.shared_strings(np.zeros(len(texts), np.uint64), data, start, size, lead, least)):
        assert doc < least[e]
        covered[start[e] + lo : start[e] + hi] = True
    first: dict[tuple[int, bytes], int] = {}
    windows = [(e, o, (lead[e] - o, data[start[e] + o : start[e] + o + 50].tobytes())) for e in range(len(texts)) for o in range(size[e] - 49) if 0 <= lead[e] - o <= 30]
    for e, _, w in windows:
        first[w] = min(least[e], first.get(w, 1 << 60))
    want = np.zeros(len(data), bool)
    for e, o, w in windows:
        want[start[e] + o : start[e] + o + 50] |= first[w] < least[e]
    assert 0 < want.sum() < len(want) and (covered == want).all()
    # a pack's own contexts
    blocks = [b"".join(words[k] for k in rng.integers(0, 4, 40)) for _ in range(60)]
    pack = substrings.Pack(np.arange(60), np.array(list(map(len, blocks))), np.frombuffer(b"".join(blocks), np.uint8))
    if len(pack.hash):
        e = pack.entries(np.unique(pack.hash))
        for begin, k in zip(e.begin, e.entry):
            assert (pack.data[begin : begin + e.size[k]] == pack.data[e.start[k] : e.start[k] + e.size[k]]).all()


def plain_seats(rows, seats):
    """rows (at, weight, most) to seats by the highest quotients, one after another."""
    out = {at: 0 for at, _, _ in rows}
    heap = [(-w, at, w, most) for at, w, most in rows if w > 0 and most > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, at, w, most = heapq.heappop(heap)
        out[at] += 1
        if out[at] < most:
            heapq.heappush(heap, (-w / (2 * out[at] + 1), at, w, most))
    return out


def test_apportion_equals_highest_quotients(spark):
    rng = random.Random(5)
    cases = [([1000.0] + [1.0] * 19, 400, [10**6] * 20), ([1000.0] + [1.0] * 19, 100, [20] + [10**6] * 19), ([5.0, 2.0, 1.0], 8, [3, 100, 100]), ([1.0] * 7, 3, [9] * 7), ([2.0, 0.0, 3.0], 5, [1, 4, 1]), ([4.0], 0, [5])]
    for _ in range(40):
        n = rng.randrange(1, 30)
        cases.append(([rng.choice([rng.random(), rng.random() ** 6 * 1e6, rng.randrange(1, 4)]) for _ in range(n)], rng.randrange(0, 500), [rng.choice([rng.randrange(0, 12), 10**6]) for _ in range(n)]))
    rows = [(g, k, float(w), seats, m) for g, (ws, seats, most) in enumerate(cases) for k, (w, m) in enumerate(zip(ws, most))]
    out = mixing.apportion(spark.createDataFrame(rows, "g int, at int, w double, seats long, most long"), ["g"], "w", "seats", "got", "most").collect()
    for g, (ws, seats, most) in enumerate(cases):
        want = plain_seats([(k, w, m) for k, (w, m) in enumerate(zip(ws, most))], seats)
        assert {r["at"]: r["got"] for r in out if r["g"] == g} == want, g


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    total = sum(r["size"] for r in out)
    goal = {r["source"]: r["target"] for r in out}
    assert sum(goal.values()) == pytest.approx(total)
    for s, g in goal.items():
        own = [r for r in out if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(g, rel=0.01)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own) and g <= 3 * own[0]["source_size"] + 1e-6


@pytest.mark.parametrize("shard_rows", [4, 16, 64, 4096])
def test_mixing_capped_source_of_many_shards(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    rows = [(i, "w " * (1 + i % 3), "a") for i in range(3000)] + [(i, "w " * 50, "b") for i in range(3000, 7000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, size in (("a", 6000), ("b", 200000)):
        own = [r for r in out if r["source"] == s]
        goal = own[0]["target"]
        assert own[0]["source_size"] == size and (s == "b" or goal == pytest.approx(3 * size))
        assert sum(r["taken"] for r in own) == pytest.approx(goal, abs=2 * 18000 / mixing.GRAIN)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)


def held_out(spark, query, label):
    out = query(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    lab = duckdb.sql("select * from read_parquet('/root/testdata/sf0.01/labels.parquet')").df()
    return out.merge(lab, on="doc_id").assign(y=lambda x: x[label])


def test_quality_held_out(spark):
    x = held_out(spark, queries.op1_quality, "quality")
    r = x.score.rank()
    p, n = (x.y == 1).sum(), (x.y == 0).sum()
    assert (r[x.y == 1].sum() - p * (p + 1) / 2) / (p * n) > 0.95


def test_language_held_out(spark):
    out = queries.op4_langid(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    docs = duckdb.sql("select doc_id, lang from read_parquet('/root/testdata/sf0.01/documents.parquet')").df()
    x = out.merge(docs, on="doc_id")
    assert (x.lang == x.lang_pred).mean() > 0.98 and not x.rejected.any()


def test_toxicity_runs(spark):
    x = held_out(spark, queries.op2_toxicity, "toxic")
    assert x.score.between(0, 1).all() and x[x.y == 1].score.mean() > x[x.y == 0].score.mean()


def test_passages_take_one_python_process_a_task(spark):
    """Whole characters come from the cut itself: a second Python process beside it cost memory."""
    out = corpus_pipeline.drop_repeated_passages(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" in plan and "ArrowEvalPython" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        docs = stage(spark, docs, DATA).persist()
        assert docs.count() <= kept
        kept = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            comp, _ = plain_components([(r["doc_id"], r["text"]) for r in rows], 85)
            assert {r["doc_id"] for r in docs.collect()} == set(comp.values())
        if name == "suffix_array_dedup":
            want = {i: b.decode(errors="ignore") for i, b in plain_cuts([(r["doc_id"], r["text"]) for r in rows]).items() if b}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
    assert kept == corpus_pipeline.run(spark, DATA).count()
