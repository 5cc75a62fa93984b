"""Each operator on nulls, empty, blank and long texts, ties, repeated rows, empty tables, clashing columns."""
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from probity.llm import common, decontam, html_text, langid, minhash, mixing, neighbours, quality, substrings, tokens, toxicity

LONG = " ".join(f"word{i % 977} and" for i in range(30000))
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, " \n\t ", "fr", "b"),
    (None, "le chat est sur la table et regarde le chien", "fr", "b"),
    (5, "le chat est sur la table et regarde le chien", "fr", "c"),
    (6, LONG, "en", "c"),
    (7, "12345 !!! 678", "en", "c"),
    (8, "été ∑ 日本 <|endoftext|> x", "fr", None),
]
# columns named like results of the operators
EXTRA = "score double, size long, n_bytes long, kept boolean, text_md5 string, rejected boolean, n_hit long"
SCHEMA = "doc_id long, text string, lang string, source string, " + EXTRA
NONE = (None,) * 7
LABELS = [(1, 1, 0), (2, 0, 0), (3, None, None), (5, 1, 1), (None, 1, 1), (6, 1, 0), (7, 0, 1), (8, 1, 0), (8, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + NONE for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


BENCH = [(1, "cat sat on the mat and looked at the dog"), (2, None), (3, ""), (4, "le chat"), (4, "le chat")]
OPS = {
    "op1": lambda s, d, lab: quality.quality(d, lab),
    "op2": lambda s, d, lab: toxicity.score(d, toxicity.train(d, lab)),
    "op3": lambda s, d, lab: minhash.near_duplicates(d),
    "op4": lambda s, d, lab: langid.identify(d, langid.train(d)),
    "op6": lambda s, d, lab: decontam.decontaminate(d, s.createDataFrame(BENCH, "item_id long, text string")),
    "op7": lambda s, d, lab: mixing.mix(d),
    "op8": lambda s, d, lab: html_text.extract(d, "text"),
    "op9": lambda s, d, lab: substrings.remove_repeats(d),
    "op10": lambda s, d, lab: tokens.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("op", OPS)
def test_every_row_comes_back_once(spark, docs, labels, op):
    out = OPS[op](spark, docs, labels)
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    got = sorted((r[0] for r in out.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert got == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


@pytest.mark.parametrize("op", OPS)
def test_empty_table(spark, docs, labels, op):
    assert OPS[op](spark, docs.limit(0), labels).count() == 0


def test_values(spark, docs, labels):
    sizes = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert sizes[2]["size"] == 0 and sizes[1]["size"] == 11 and all(r["taken"] <= 3 * r["size"] for r in sizes.values())
    lang = {r["doc_id"]: r["lang_pred"] for r in OPS["op4"](spark, docs, labels).collect()}
    assert lang[2] == lang[3] == lang[4] == lang[7] == "und" and lang[5] != "und"
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert near[1]["component_id"] == 1 and near[None]["component_id"] == 5 and near[4]["n_shingles"] == 0 and near[4]["kept"]
    leak = {r["doc_id"]: r for r in OPS["op6"](spark, docs, labels).collect()}
    assert leak[1]["n_hit"] == 10 and leak[1]["items"] == ["1"] and leak[5]["items"] == ["4"] and leak[5]["n_hit"] == 2 and leak[2]["n_words"] == 0
    cut = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert cut[2]["n_bytes"] == 0 and cut[1]["n_removed"] == 0 and cut[6]["n_bytes"] == len(LONG)


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 256), (64, 8), (17, 1)])
def test_tokens_equal_the_library(spark, docs, chunk, overlap):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = tokens.count_tokens(docs, path, chunk=chunk, overlap=overlap).collect()
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS)
    assert sorted(r["n_tokens"] for r in got) == want


def test_one_chunk_needs_no_offsets(monkeypatch):
    """Texts of one chunk are counted without offsets, in the order of the texts; longer ones are spliced."""
    asked = []
    chunks = tokens.Library.chunks

    def seen(self, parts):
        parts = list(parts)
        asked.extend(z - a for _, a, z in parts)
        return chunks(self, parts)

    monkeypatch.setattr(tokens.Library, "chunks", seen)
    lib = tokens.Library(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["short one", "words of a longer text " * 40, "", "é" * 30, "<|endoftext|> b"]
    assert tokens.counts(lib, texts, 200, 50) == [len(lib.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(asked) > 1 and sum(asked) < 2 * len(texts[1])
    asked.clear()
    assert tokens.counts(lib, texts, 4096, 128) == [len(lib.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert asked == []


def test_fewer_steps_find_the_same_tokens():
    """A text that needs fewer steps gets the file's own tokens, offsets and words."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, tok = tokens.Library(path), Tokenizer.from_file(path)
    printed = ["It's  WE'LL\n\t'tis ''S 'RE12 a-b", "<|endoftext|>x <|ENDOFTEXT|>", "", " \r\n"]
    composed = ["Été\u3000日本 \u0130st ΣΑΣ 12½", "a\x1cb \x7f\x00 c", "\u0301e \u00a0\u2003x\u0085y", "é<|endoftext|>É"]
    for texts, fits in ((printed, lib.printed), (composed, lib.composed), (["e\u0301 \u2000 x"], lib.tok)):
        for t, found, short in zip(texts, lib.encoded(texts, True), lib.encoded(texts, False)):
            want = tok.encode(t, add_special_tokens=False)
            assert lib.fitting(t) is fits
            assert (found.ids, found.offsets, found.word_ids) == (want.ids, want.offsets, want.word_ids) and short.ids == want.ids
    assert len({id(lib.printed), id(lib.composed), id(lib.tok)}) == 3


def test_only_overlaps_need_offsets(monkeypatch):
    """Chunks of a composed text are encoded without offsets, whatever lies at the cuts."""
    asked = []
    chunks = tokens.Library.chunks

    def seen(self, parts):
        parts = list(parts)
        asked.extend(z - a for _, a, z in parts)
        return chunks(self, parts)

    monkeypatch.setattr(tokens.Library, "chunks", seen)
    lib = tokens.Library(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Words of a longer text, it's été. " * 60, "a " * 1500, "ab" * 1500, "<|endoftext|>" * 200, "x<|endoftext|> y\n" * 150, "'s't " * 500]
    assert tokens.counts(lib, texts, 400, 40) == [len(lib.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert asked and sum(asked) < sum(map(len, texts)) / 4


def test_no_splice_inside_a_character():
    """Lower-cased, U+0130 is a letter and a mark, the start of a word each, at the same character: 53 for 52 tokens."""
    lib = tokens.Library(public_tokenizers.path("word_bpe_49k.json"))
    text = "\u0937r\u0323\n\u03001\nv<|ENDOFTEXT|>\xc9R<|endoftet|>\u0663\n\xdf'\u0301'M\u0130D'a\x85|\u093fD\u03c2 the\nlv\xdfb     \xc9\xb2\u094dd \x85,r"
    assert not lib.bare(text)
    assert tokens.counts(lib, [text], 40, 8) == [len(lib.tok.encode(text, add_special_tokens=False).ids)]


def test_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (64, [1.0]), (5, [5.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df).orderBy("query_id", "rank").collect()
    usable = {i: v for i, v in rows[:60]}
    for q in (0, 20, 40):
        want = sorted(((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q))[:20]
        assert [(r["vec_id"], r["score"]) for r in out if r["query_id"] == q] == [(i, -s) for s, i in want]
    assert neighbours.nearest(df.limit(0)).count() == 0


def gaussian(rng, n, kind):
    x = rng.normal(size=(n, 32))
    if kind == "clusters":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.3 * x
    if kind in ("tail", "huge"):
        x *= np.exp(rng.normal(size=(n, 1)))
    if kind == "huge":
        x[7] *= 1e6
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


@pytest.mark.parametrize("kind", ["plain", "unit", "clusters", "tail", "huge"])
def test_vectors_recall(spark, monkeypatch, kind):
    x = gaussian(np.random.default_rng(1), 2000, kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(q, i) for q in range(0, len(x), 20) for i in np.argsort(-s[q])[:20].tolist()}
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df).collect()}
    assert len(want & got) > 0.9 * len(want)


def test_vectors_rounds_lift_recall(spark, monkeypatch):
    """The first blocks alone find little; the rounds of local joins find the neighbours."""
    x = gaussian(np.random.default_rng(1), 1500, "plain")
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    points = spark.createDataFrame([(i, (v / np.linalg.norm(v)).astype(np.float16).tobytes(), float(np.linalg.norm(v))) for i, v in enumerate(x)], "node long, h binary, m double")
    recall = lambda g: np.mean([len(set(r["ids"][:20]) & set(np.argsort(-s[r["node"]])[:20].tolist())) / 20 for r in g.collect()])
    graph = neighbours.first_graph(points, len(x), 32)
    first = recall(graph)
    for turn in range(4):
        graph = neighbours.improved(graph, points, turn)
    assert first < 0.5 < 0.9 < recall(graph)


def test_vectors_ties_repeats_and_columns(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same, i) for i in range(0, 50)] + [(20, [9.0, 9.0, 9.0], 1), (60, [2.0, 4.0, 4.0], 1), (60, [2.0, 4.0, 4.0], 2), (80, None, 3)]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    # key 20 has two vectors: one of them counts, and it comes once
    assert set(by) == {0, 20, 40, 60} and all(len(v) == len({i for i, _ in v}) == 20 for v in by.values())
    for q in (0, 40):
        assert [i for i, _ in by[q] if i not in (20, 60)] == [i for i in range(50) if i not in (q, 20)][: len([i for i, _ in by[q] if i not in (20, 60)])]
        assert by[q][0][0] in (20, 60)


def test_html():
    page = """<html><head><title>No</title></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use</div><article><h1>Head&eacute;</h1><p>One <b>two</b>three
    four<br>five<p>six</article><aside>Side</aside><div id="comments"><p>Me too</div><form><input>Name</form><footer>End</footer>"""
    assert html_text.main_text(page) == "Headé One twothree four five six"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""


PARAS = [f"Paragraph {i} " + "tells its story at some length and without any link in it, " * 4 for i in range(6)]
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Other story number {i}</a></li>" for i in range(5)) + "</ul>"
TEASERS = "".join(f"<article><h3><a href=/t{i}>Teaser {i}</a></h3><p>Short words {i}</p></article>" for i in range(6))


def body(paras):
    return "".join(f"<p>{x}</p>" for x in paras)


@pytest.mark.parametrize(
    "page",
    [
        f"<div>{body(PARAS)}</div><div>{TEASERS}</div>",
        f"<div>{TEASERS}</div><div>{body(PARAS)}</div>",
        f"<div>{body(PARAS[:3])}</div>{TEASERS}<div>{body(PARAS[3:])}</div>",
        f"<main><div>{body(PARAS)}</div>{LINKS}</main>",
        f"<main><div>{body(PARAS[:3])}{LINKS}{body(PARAS[3:])}</div></main>",
        f"<main><article>{body(PARAS)}</article><div>" + "".join(f"<div><b>Reader {i}</b><p>I agree</p></div>" for i in range(8)) + "</div></main>",
    ],
)
def test_html_ratios_choose_the_regions(page):
    assert html_text.main_text(page) == " ".join(" ".join(PARAS).split())


def test_html_article_stays_whole():
    short = ["Note.", "More.", "Thus.", "End."]
    page = f"<div>{TEASERS}</div><article><h1>Head</h1>{body(PARAS + short)}</article>"
    assert html_text.main_text(page) == " ".join(" ".join(["Head", *PARAS, *short]).split())


def test_scratch_is_shared_folder(spark):
    path = common.scratch_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert F.lit(1) is not None
