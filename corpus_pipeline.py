"""From raw documents to a training mix: language ID, near-dedup, repeated passages, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import common, decontam, langid, minhash, mixing, substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last: list[str] = []


def _tidy(stage: Stage, first: bool) -> Stage:
    """The stage; before it runs, the scratch tables of the one before go, whose result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            common.drop_paths(spark, _last)
        before = set(common.scratch_paths())
        out = stage(spark, docs, sf_dir)
        _last[:] = [p for p in common.scratch_paths() if p not in before]
        return out

    return run


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the models reject go: null texts, texts without
    letters, and those whose cross-entropy is above the calibrated threshold. Repeated rows stay."""
    return langid.identify(docs, langid.train(docs)).where(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates. Texts without words stay, and so do
    all rows of a repeated id that stays."""
    out = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = common.stage(out.where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids hold; a document of nothing else goes.

    A cut inside a character takes the rest of the character, too. Null and empty texts and repeated rows stay."""
    out = substrings.remove_repeats(docs, whole=True)
    out = out.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", F.col("text").cast("string"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts stay."""
    out = decontam.decontaminate(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    gone = common.stage(out.where("contaminated").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; 0 of null and empty texts."""
    return mixing.mix(docs).select("doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _tidy(identify_language, True)),
    ("minhash_near_dedup", _tidy(drop_near_duplicates, False)),
    ("suffix_array_dedup", _tidy(drop_repeated_passages, False)),
    ("benchmark_decontamination", _tidy(drop_benchmark_texts, False)),
    ("source_mixing", _tidy(mix_sources, False)),
]

#: No SQL expresses the language models, so the rows are tested stage by stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    written: DataFrame | None = None
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = common.stage(out)
        if written is not None:
            common.drop_stage(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
