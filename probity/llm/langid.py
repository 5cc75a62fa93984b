"""Language identification by interpolated Kneser-Ney character models, one for each language."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm import kn
from probity.llm.common import fold, fresh, slices

ORDER, BITS, PRIME = 4, 15, 32749
#: Rejected: mean -log p above the language's own mean by this many of its standard deviations of one
#: character, and this many standard errors of the text's length besides.
SPREAD, ERRORS = 1.0, 6.0
#: Languages whose models a task holds at once; more are scored in passes over the same rows.
AT_ONCE = 32


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[kn.Model]:
    """Models from all rows with a language whose crc32(key) mod 4 is not 2, AT_ONCE languages in each."""
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull() & (fold(docs[key], 4) != 2)).select(docs[lang].cast("string").alias("cls"), docs[text].cast("string").alias("text"))
    counts = kn.stage(kn.count_grams(rows, ORDER, BITS, PRIME))
    names = sorted(r[0] for r in counts.select("cls").distinct().collect())
    return [kn.fit(counts.where(F.col("cls").isin(names[i : i + AT_ONCE])), names[i : i + AT_ONCE], ORDER, BITS, PRIME) for i in range(0, len(names), AT_ONCE)]


def identify(docs: DataFrame, models: list[kn.Model], text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy (nats a character) and rejected behind its own columns.

    lang_pred is the language of the lowest mean -log p of the text's characters; `und` for a null text,
    one without letters, or without any model. score is its share among the languages, at an evidence of
    at most 50 characters. rejected: `und`, or cross_entropy above the calibrated threshold, which the
    mean and variance of the training grams give (see SPREAD and ERRORS). Ties go to the first language
    in order of code points. Rows are independent: repeated rows and other columns stay. Columns of docs
    that have one of the four names are replaced.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    held = sc.broadcast(models)
    inner = fresh(docs, "kn_text")
    src = docs.withColumn(inner, docs[text].cast("string"))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [kn.Scorer(m) for m in held.value]
        names = [c for m in held.value for c in m.classes]
        mean = np.concatenate([m.mean for m in held.value]) if names else np.zeros(0)
        sd = np.sqrt(np.concatenate([m.var for m in held.value])) if names else np.zeros(0)
        for batch in batches:
            for part in slices(batch, inner):
                i = part.schema.get_field_index(inner)
                c, owner, target = kn.codes(part.column(i).to_pylist(), ORDER, PRIME)
                n = np.bincount(owner[target], minlength=part.num_rows)
                letters = np.bincount(owner[target & (c > 0)], minlength=part.num_rows)
                pred, score, ce, rejected = ["und"] * part.num_rows, np.zeros(part.num_rows), [None] * part.num_rows, np.ones(part.num_rows, bool)
                if names:
                    full = np.flatnonzero(n)
                    first = np.searchsorted(owner[target], full)
                    key = kn.pack(c, ORDER, BITS)[target]
                    if len(full):
                        h = -np.hstack([np.add.reduceat(s.logp(key), first, axis=0, dtype=np.float64) for s in scorers]) / n[full][:, None]
                        best = h.argmin(1)
                        low = h[np.arange(len(full)), best]
                        share = 1 / np.exp((low[:, None] - h) * np.minimum(n[full], 50)[:, None]).sum(1)
                        limit = mean[best] + sd[best] * (SPREAD + ERRORS / np.sqrt(n[full]))
                        for j, row in enumerate(full):
                            if letters[row]:
                                pred[row], score[row], ce[row], rejected[row] = names[best[j]], share[j], low[j], low[j] > limit[j]
                cols = [part.column(k) for k in range(part.num_columns) if k != i]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(rejected, pa.bool_())], names=[*(f.name for k, f in enumerate(part.schema) if k != i), "lang_pred", "score", "cross_entropy", "rejected"])

    out = schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")
    return src.mapInArrow(run, out)
