"""Ranked search, whitening and URL filters against plain Python, on awkward rows and on the small test data."""
import math
import random
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest

from probity.llm import queries, search, urls, whitening

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, top):
    """(item, rank, doc, score) by the formula, rows of docs in order."""
    texts = [(d, Counter(words(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in texts if c), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in texts:
            n, score = sum(c.values()), 0
            for t in set(words(text)) & set(c):
                m = 10 + 90 * n * n_docs // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [1, 200, 1 << 22])
def test_search_equals_brute_force(spark, monkeypatch, part_bytes):
    rng = random.Random(11)
    make = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(n))
    docs = [(i, make(rng.randrange(1, 40))) for i in range(120)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (500, docs[3][1]), (None, docs[3][1]), (501, None), (502, ""), (503, " .,; "), (504, "Été ÉTÉ été w1\x00w2 日本-W3_w4"), (505, make(30000))]
    items = [(i, make(rng.randrange(1, 12))) for i in range(15)] + [(1, "w1 w1 W1"), (None, "w2 w3"), (20, None), (21, ""), (22, "nowhere"), (23, "Été 日本 w4"), (24, docs[3][1]), (24, docs[3][1])]
    monkeypatch.setattr(search, "PART_BYTES", part_bytes)
    extra = (None, None, None)
    index = search.build(spark.createDataFrame([d + extra for d in docs], "doc_id long, text string, rank int, score long, part long").repartition(3))
    found = search.search(index, spark.createDataFrame([i + extra for i in items], "item_id long, text string, rank int, score long, item long"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(docs, items, 10)


def test_search_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    nothing = search.build(docs.limit(0))
    assert (nothing.n_docs, nothing.n_terms) == (0, 0) and search.search(nothing, items).count() == 0
    assert search.search(search.build(docs), items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(search.build(docs), items).collect()] == ranked([(1, "a b")], [(1, "a")], 10)


def test_long_documents_count_beyond_64_bits(spark):
    """The length's product is a decimal where it may not fit into 64 bits; results are the same."""
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = search.build(docs)
    want = [tuple(r) for r in search.search(index, items).collect()]
    index.longest = 1 << 62
    assert [tuple(r) for r in search.search(index, items).collect()] == want and len(want) == 3


@pytest.mark.parametrize("bits, rows", [(5, 300), (19, 8192), (24, 100), (70, 40)])
def test_gram_is_exact(bits, rows):
    rng = random.Random(bits)
    high = 1 << bits
    y = [[rng.choice([rng.randrange(-high, high + 1), -high, high]) for _ in range(3)] for _ in range(rows)]
    array = np.array(y, dtype=np.int64 if bits < 62 else object)
    got = whitening.gram(array, high.bit_length() // whitening.LIMB + 1)
    assert got.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    big = np.array([[v * high for v in r] for r in y[:5]], dtype=object)
    count = (2 * bits + 2) // whitening.DIGIT + 1
    assert whitening.whole(whitening.digits(big, count)) == [v * high for r in y[:5] for v in r]


def plain_whitening(rows, k):
    """Per usable row: deviation and |whitened|; explained. By fractions and one eigendecomposition."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    cov = [[sum((Fraction(v[i]) - Fraction(sums[i], n)) * (Fraction(v[j]) - Fraction(sums[j], n)) for v in fit) / n for j in range(dim)] for i in range(dim)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    order = np.argsort(-values)[:k]
    centred = {i: np.array([float(Fraction(v[d]) - Fraction(sums[d], n)) for d in range(dim)]) for i, v in x.items()}
    trace = float(sum(cov[i][i] for i in range(dim)))
    return n, {i: sum((n * v[d] - sums[d]) ** 2 for d in range(dim)) for i, v in x.items()}, {(i, c + 1): abs(z @ axes[:, o]) / math.sqrt(values[o]) for i, z in centred.items() for c, o in enumerate(order)}, [values[o] / trace for o in order]


@pytest.mark.parametrize("scale", [0.3, 40.0, 1e12])
def test_whitening_equals_fractions(spark, scale):
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(6, 6)) * np.array([3, 2, 1.5, 1, 0.5, 0.2])[:, None]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 6)) @ basis * scale)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [-0.0] * 6)]
    odd = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [math.nan] + [1.0] * 5), (203, [math.inf] + [1.0] * 5), (204, [1.0, 2.0]), (205, [])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd + [rows[5]]], "vec_id long, embedding array<double>, n int, whitened double")
    got = [r.asDict() for r in whitening.whiten(df).collect()]
    n, deviation, white, share = plain_whitening(rows, 4)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c) for i, _ in [*rows, rows[5]] for c in (1, 2, 3, 4))
    for r in got:
        assert r["n"] == n == 61 and int(r["deviation"]) == deviation[r["vec_id"]]
        assert abs(r["whitened"]) == pytest.approx(white[r["vec_id"], r["component"]], rel=1e-6, abs=1e-8)
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
    assert len({np.sign(r["whitened"]) for r in got if r["vec_id"] in (0, 100, 101) and r["component"] == 1}) == 1


def test_whitening_of_few_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([]), components=4).count() == 0
    assert whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 3.0])])).collect()
    assert sorted((str(r["vec_id"]), r["component"], abs(r["whitened"]), r["explained"]) for r in got) == [("1", 1, 1.0, 1.0), ("2", 1, 1.0, 1.0), ("None", 1, 1.0, 1.0)]
    huge = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in huge)


def verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v, h.translate(UPPER) + p) for h, p, v in rules if h is not None and p is not None and (host == h.translate(UPPER) or host.endswith("." + h.translate(UPPER))) and path.startswith(p)]
    tokens = set(re.findall(r"[^\W_]+", (host + path).lower()))
    own = "block" if tokens & set(urls.STRICT) or len(tokens & set(urls.SOFT)) >= urls.SEVERAL else "allow"
    best = max(fit, default=(0, 0, own, None))
    return host, path, best[3], best[2]


def test_urls_equal_plain_python(spark):
    rng = random.Random(13)
    hosts = ["a.example.net", "EXAMPLE.net", "example.net.", "xample.net", "free-bets.b.example.com", "casino.org", "x.y.z.org", "freebets.com", "free.com", "user@h.com:80", "net", "", ".".join("d" * 400), "casinos.com", "free-free.com"]
    paths = ["", "/", "/en/", "/en", "/en/free/pills", "/de/x", "/fr/casino.html", "/fr/a?b=casino", "/x#casino", "/日本/adult", "/\n/porn", "/" + "q" * 5000, "/en/spam_farm"]
    rows = [(rng.choice(["http", "https", ""]) + "://" + h + p) for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/d", "https://"] * 2
    rules = [*queries.URL_RULES, ("z.org", "/en", "block"), ("Y.z.org", "/en/", "allow"), ("com", "/x", "block"), ("com", "/x", "allow"), ("d", "", "block"), (None, "/", "block"), ("com", None, "block"), ("casino.org", "/fr/casino.html", "allow")]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(rows)] + [(None, rows[0], None, "x")], "page_id long, url string, verdict string, Host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: verdict(u, rules) for i, u in [*enumerate(rows), (None, rows[0])]}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, none).collect()} == {i: verdict(u, [])[3] for i, u in [*enumerate(rows), (None, rows[0])]}
    assert urls.judge(df.limit(0), none).count() == 0
    assert {r["verdict"] for r in urls.judge(df, none, strict=(), soft=()).collect()} == {"allow"}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["op11_search", "op13_urls"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
