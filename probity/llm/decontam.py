"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Each window of WINDOW words holds WINDOW - GRAM + 1 hashes of GRAM consecutive words; its least hash is a
fingerprint. A text and an item that share WINDOW consecutive words share that window's fingerprint, so
a join of fingerprints misses no shared window. Hits are then extended: each joined row's text is searched
for the item's windows word by word.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probity.llm.common import stage

WINDOW, GRAM = 10, 5
#: What separates words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(low, F.lit("")), BETWEEN), lambda w: w != "")


def _prints(df: DataFrame, ws: str) -> DataFrame:
    """df with prints: the distinct least hashes of the windows of WINDOW words; empty for fewer words.

    Rows are made of them by an outer explode: for an inner one Spark first tests for empty arrays, for
    which it would compute the hashes several times over."""
    span = WINDOW - GRAM + 1
    h = F.col("_h")
    df = df.withColumn("_h", F.transform(F.col(ws), lambda w: F.xxhash64(w)))
    n = F.size("_h")
    # shifted copies side by side keep the hashing free of look-ups by position
    shifted = lambda a, m, k: F.slice(a, k + 1, F.greatest(m, F.lit(0)))
    grams = F.transform(F.arrays_zip(*[shifted(h, n - GRAM + 1, k).alias(f"g{k}") for k in range(GRAM)]), lambda g: F.xxhash64(*[g[f"g{k}"] for k in range(GRAM)]))
    df = df.withColumn("_g", grams)
    m = F.size("_g") - span + 1
    least = F.transform(F.arrays_zip(*[shifted(F.col("_g"), m, k).alias(f"m{k}") for k in range(span)]), lambda g: F.least(*[g[f"m{k}"] for k in range(span)]))
    return df.withColumn("prints", F.array_distinct(least)).drop("_h", "_g")


def windows(bench: DataFrame, item: str, text: str) -> DataFrame:
    """(item, len, gram): the windows of every item; an item of fewer words is one window."""
    b = bench.select(F.col(item).alias("item"), words(F.col(text)).alias("ws"))
    b = b.withColumn("len", F.least(F.size("ws"), F.lit(WINDOW))).where(F.col("len") > 0)
    at = F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1))
    return b.select("item", "len", "ws", at.alias("at")).select("item", "len", F.array_join(F.slice("ws", F.col("at"), F.col("len")), " ").alias("gram")).distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without its text, with n_words, n_hit, n_items, items (sorted as strings) and contaminated.

    A word is hit if it lies inside any occurrence of an item's window. Null and empty texts have no words;
    items without words have no windows; equal items each count. Repeated rows of docs and null keys each
    get their own text's result. Columns of docs named like a result are replaced.
    """
    names = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    keep = [c for c in docs.columns if c not in (text, *names)]
    grams = stage(windows(bench, item, item_text))
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # at most WINDOW values

    # one row for each distinct text keeps repeated rows from being searched again and again
    src = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"), F.xxhash64(docs[text]).alias("_h1"), F.xxhash64(F.lit(1), docs[text]).alias("_h2"))
    base = src.select("_text", "_h1", "_h2").withColumn("ws", words(F.col("_text"))).drop("_text")
    out = src.withColumn("n_words", F.size(words(F.col("_text"))).cast("long")).drop("_text")

    found = []
    if WINDOW in lengths:
        b = _prints(grams.where(F.col("len") == WINDOW).select(F.split("gram", " ").alias("ws")), "ws").select(F.explode_outer("prints").alias("print")).distinct()
        d = _prints(base, "ws").select("_h1", "_h2", F.explode_outer("prints").alias("print"))
        found.append(d.join(b, "print", "left_semi").select("_h1", "_h2"))
    for n in [n for n in lengths if n < WINDOW]:
        b = grams.where(F.col("len") == n).select(F.xxhash64("gram").alias("print")).distinct()
        short = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, n), " ")))
        d = base.where(F.size("ws") >= n).select("_h1", "_h2", F.explode_outer(F.array_distinct(short)).alias("print"))
        found.append(d.join(b, "print", "left_semi").select("_h1", "_h2"))
    if not found:
        return out.select(*keep, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    suspects = found[0]
    for f in found[1:]:
        suspects = suspects.unionByName(f)
    suspects = stage(suspects.distinct())

    # extension: every window of a suspect text against the items' windows, on the words themselves
    texts = base.join(suspects, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])
    hits = None
    for n in lengths:
        at = F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " ")))
        d = texts.where(F.size("ws") >= n).select("_h1", "_h2", at.alias("pos", "gram"))
        g = grams.where(F.col("len") == n).select("gram", "item")
        part = d.join(g, "gram").select("_h1", "_h2", "pos", (F.col("pos") + n).alias("end"), "item")
        hits = part if hits is None else hits.unionByName(part)
    hits = stage(hits)
    order = W.partitionBy("_h1", "_h2").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.groupBy("_h1", "_h2", "pos").agg(F.max("end").alias("end"))
    spans = spans.withColumn("done", F.greatest("pos", F.coalesce(F.max("end").over(order), F.lit(0))))
    n_hit = spans.groupBy("_h1", "_h2").agg(F.sum(F.greatest(F.col("end") - F.col("done"), F.lit(0))).cast("long").alias("n_hit"))
    items = hits.select("_h1", "_h2", F.col("item").cast("string").alias("item")).distinct().groupBy("_h1", "_h2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    result = n_hit.join(items, ["_h1", "_h2"])
    joined = out.join(result, ["_h1", "_h2"], "left")
    return joined.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
