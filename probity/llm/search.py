"""Ranked lexical search: postings in term buckets, integer scores, the best documents of each item.

The index is one pass over the texts. A part is the documents of a few megabytes of text, ordered by key; each
of its terms is one posting row (term, part, hits, n): hits holds position-in-part * 2^32 + occurrences, n the
documents' lengths. So a frequent term is many rows of bounded size, dealt to its bucket's files by part.

A search joins the items' distinct terms with the postings, scores each posting once, deals the scores by part,
joins the items' terms to them, sums by item and document, and ranks: first inside each part, whose documents
stand in the order of their keys, then over what the parts keep. Nothing is dropped before its sum is whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probity.llm.common import drop_stage, sized, slices, stage, utf8

#: What separates terms, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same as a table over UTF-8 bytes: separators become blanks, A-Z lower case.
BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of text of a part, about (one document at least); buckets of terms, and shares of a bucket.
PART_BYTES = 4 << 20
BUCKETS, SHARES = 64, 16
#: The bucket of the rows that hold the documents of a part.
DOCUMENTS = -1
TOP = 10


@dataclass
class Index:
    """postings(term, part, hits, n) and documents(part, keys, n); documents with terms, all their terms with
    repeats, the longest document's terms."""

    postings: DataFrame
    documents: DataFrame
    n_docs: int
    n_terms: int
    longest: int


def terms(text: Column) -> Column:
    """The distinct terms of a text; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(low, BETWEEN), lambda w: w != ""))


def _postings(rows: pa.RecordBatch, part: int, schema: pa.Schema) -> pa.RecordBatch:
    """The posting rows of one part, and behind them the row of its documents."""
    rows = rows.take(pa.compute.sort_indices(rows.column(0), null_placement="at_start"))
    raw, off = utf8(rows.column(1))
    data = raw.tobytes()
    words = [data[a:b].translate(BYTES).split() for a, b in zip(off[:-1], off[1:])]
    n = np.array([len(x) for x in words], dtype=np.int64)
    coded = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
    # one number for each occurrence: term by term, document by document
    at = coded.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
    where, tf = np.unique(at, return_counts=True)
    term, doc = np.divmod(where, len(n))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    offsets = np.concatenate([starts, [len(where), len(where)]]).astype(np.int32)
    count = len(starts)
    hits = pa.ListArray.from_arrays(pa.array(offsets), pa.array((doc << 32) | tf))
    sizes = pa.ListArray.from_arrays(pa.array(np.concatenate([offsets[:-1], [len(where) + len(n)]]).astype(np.int32)), pa.array(np.concatenate([n[doc], n]).astype(np.int32)))
    keys = pa.ListArray.from_arrays(pa.array([0] * (count + 1) + [len(n)], pa.int32()), rows.column(0))
    names = pa.array([*coded.dictionary.take(pa.array(term[starts])).to_pylist(), None], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array([part] * (count + 1), pa.int64()), hits, sizes, keys.cast(schema.field("keys").type)], schema=schema)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents. Null and empty texts have no terms and are no documents of the counts; a null
    key stands before all others; repeated rows are documents of their own. An empty table gives an empty index."""
    src = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            schema = pa.schema([("term", pa.string()), ("part", pa.int64()), ("hits", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("keys", pa.list_(batch.schema.field(0).type))])
            for rows in slices(batch, "text", PART_BYTES):
                yield _postings(rows, part, schema)
                part += 1

    found = src.mapInArrow(run, f"term string, part long, hits array<long>, n array<int>, keys array<{kind}>")
    bucket = F.when(F.col("term").isNull(), DOCUMENTS).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    dealt = found.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("part"), F.lit(SHARES))).sortWithinPartitions("bucket", "term")
    kept = stage(dealt)
    documents = kept.where(F.col("bucket") == DOCUMENTS).select("part", "keys", "n")
    held = F.filter("n", lambda x: x > 0)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    n_docs, n_terms, longest = documents.agg(F.sum(F.size(held)), F.sum(total), F.max(F.array_max("n"))).first()
    return Index(kept.where(F.col("bucket") != DOCUMENTS).select("term", "part", "hits", "n", "bucket"), documents, n_docs or 0, n_terms or 0, longest or 0)


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(key, rank, doc, score): the `top` highest-scoring documents of each item, all with a score above 0 if
    fewer; equal scores by ascending document key.

    A term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))). A document's score is the sum over the item's
    distinct terms of w * (10^9 tf div (1000 tf + 8 m)), m = 10 + (90 n N div L). Items without a term in the
    index, null ones among them, give no row; a repeated item row or key is an item of its own."""
    rows = stage(items.select(F.monotonically_increasing_id().alias("item"), items[key].alias("item_key"), terms(items[text]).alias("terms")))
    pairs = rows.select("item", F.explode_outer("terms").alias("term")).where("term is not null")
    vocabulary = stage(pairs.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    wanted = sized(vocabulary.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), 64)
    matched = stage(index.postings.join(wanted, ["bucket", "term"]).select("tid", "part", "hits", "n"))
    df = matched.groupBy("tid").agg(F.sum(F.size("hits")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weights = stage(df.select("tid", weight.alias("w")))

    wide = "decimal(38,0)" if 90 * index.longest * index.n_docs >= 1 << 63 else "long"
    hit = matched.join(sized(weights, 32), "tid").repartition("part")
    hit = hit.select("part", "tid", "w", F.explode(F.arrays_zip("hits", "n")).alias("h"))
    hit = hit.select("part", "tid", "w", F.shiftright("h.hits", 32).alias("at"), F.col("h.hits").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tf"), F.expr(f"10 + (90 * cast(h.n as {wide}) * cast({index.n_docs} as {wide})) div {max(1, index.n_terms)}").alias("m"))
    hit = hit.select("part", "tid", "at", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))").alias("s"))
    asked = stage(pairs.join(sized(vocabulary, 64), "term").select("item", "tid"))
    # all of a document's postings have its part, so the sums and the ranks inside a part need no other shuffle
    sums = hit.join(sized(asked, 32), "tid").groupBy("item", "part", "at").agg(F.sum("s").alias("score")).where("score > 0")
    inside = W.partitionBy("item", "part").orderBy(F.desc("score"), "at")
    first = sums.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= top).drop("_r")
    who = index.documents.select("part", F.posexplode("keys").alias("at", "doc"))
    named = first.join(who, ["part", "at"])
    over = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"), "part", "at")
    ranked = named.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)
    out = stage(ranked.join(rows.select("item", "item_key"), "item").select("item_key", F.col("rank").cast("int").alias("rank"), "doc", F.col("score").cast("long").alias("score")))
    drop_stage(matched, weights, asked, vocabulary)
    return out
