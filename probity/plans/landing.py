"""Landed pages to stored tables, as an incremental job.

    python -m probity.plans.landing LANDED STORE CHECKPOINT [--base URL] [--files N]

LANDED: a folder of Parquet files of pages: kind (posts, comments, profile or label), page_id, owner_id, post_id,
user_id, html, collected_at (epoch seconds). Each call handles the files that no call before has: a file stream
takes them in batches, and a batch becomes one transaction of the store, whose manifest holds the batch's number.
So a call that is killed repeats its last batch, and a batch that had been published changes nothing.

Besides the stored tables a batch appends `errors` (page_id, field, reason, value): what a page says but no row
can hold, and pages without what their kind asks for; and `runs` (batch, step, pages, found, stored).
"""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import parse as P
from probity.operators import batches as B
from probity.operators import pages as G
from probity.sources.tables import Tables, Transaction

PAGES = "kind STRING, page_id STRING, owner_id BIGINT, post_id BIGINT, user_id BIGINT, html STRING, collected_at BIGINT"
RUNS = "batch BIGINT, step STRING, pages BIGINT, found BIGINT, stored BIGINT"
ERRORS = ["page_id", "field", "reason", "value"]


def _ordered(rows: DataFrame, *place: str) -> DataFrame:
    """_seq: later collected rows behind earlier ones, then by page and place."""
    return rows.withColumn("_seq", F.struct("collected_at", "page_id", *place))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", F.inline("problems")).select(*ERRORS)


def land(tx: Transaction, pages: DataFrame, batch: int = 0, base: str = "") -> None:
    """Write a batch of pages into the stored tables. Posts go first, so that their comments find them."""
    spark = pages.sparkSession
    # a page may have been collected several times: each is a page of its own
    pages = tx._kept(pages.withColumn("_page", F.monotonically_increasing_id()))
    runs, errors = [], []
    there = {r["kind"]: r["count"] for r in pages.groupBy("kind").count().collect()}  # kinds that no table has are few
    B.declare(tx)

    def kind(name: str) -> DataFrame:
        return pages.where(F.col("kind") == name)

    def named(rows: DataFrame, *also: str) -> DataFrame:
        return rows.drop("collected_at").join(pages.select("_page", "page_id", "collected_at", *also), "_page")

    def posts() -> tuple[int, int]:
        rows = named(G.parse_posts(kind("posts").select("_page", "html", "collected_at"), key="_page", base=base))
        rows = tx._kept(_ordered(rows, "place"))
        errors.append(_told(rows))
        return rows.count(), B.put_posts(tx, rows.drop("problems", "place")).count()

    def comments() -> tuple[int, int]:
        rows = named(G.parse_comments(kind("comments").select("_page", "post_id", "html", "collected_at"), key="_page"), "owner_id")
        rows = rows.withColumns({"is_deleted": F.lit(None).cast("boolean"), "is_edited": F.lit(None).cast("boolean")})
        rows = tx._kept(_ordered(rows, "place"))
        errors.append(_told(rows))
        return rows.count(), B.put_comments(tx, rows.drop("problems", "place", "author_href")).count()

    def profiles() -> tuple[int, int]:
        own = kind("profile").select("_page", "page_id", "html")
        bundles = tx._kept(_ordered(named(G.profile_bundles(own, key="_page"))))
        errors.append(G.profile_problems(own).select(*ERRORS))
        return bundles.count(), B.put_profiles(tx, bundles).count()

    def labels() -> tuple[int, int]:
        rows = kind("label").select("page_id", "user_id", "collected_at", P.bot_label(F.col("html")).alias("is_bot"), P.registration_date(F.col("html")).alias("registered_at"))
        rows = tx._kept(_ordered(rows))
        none = "is_bot is null and registered_at is null"
        errors.append(rows.where(none).select("page_id", F.lit("html").alias("field"), F.lit("no label").alias("reason"), F.lit(None).cast("string").alias("value")))
        return rows.where(f"not ({none})").count(), B.put_labels(tx, rows).count()

    for step, name, save in (("posts", "posts", posts), ("comments", "comments", comments), ("profiles", "profile", profiles), ("labels", "label", labels)):
        found, stored = save() if name in there else (0, 0)
        runs.append((batch, step, there.get(name, 0), found, stored))

    other = pages.where("kind is null or kind not in ('posts', 'comments', 'profile', 'label')")
    errors.append(other.select("page_id", F.lit("kind").alias("field"), F.lit("unknown kind").alias("reason"), F.col("kind").alias("value")))
    all_errors = errors[0]
    for e in errors[1:]:
        all_errors = all_errors.unionByName(e)
    tx.append("errors", all_errors, "page_id")
    tx.append("runs", spark.createDataFrame(runs, RUNS), "step")


def run(spark: SparkSession, landed: str, store: Tables, checkpoint: str, base: str = "", files: int = 1000) -> None:
    """Handle all files that have come since the last call."""

    def save(batch: DataFrame, number: int) -> None:
        tx = store.begin("landing", number)
        if tx is not None:
            land(tx, batch, number, base)
            tx.commit()

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(landed)
    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("landed")
    p.add_argument("store")
    p.add_argument("checkpoint")
    p.add_argument("--base", default="")
    p.add_argument("--files", type=int, default=1000)
    p.add_argument("--buckets", type=int, default=16)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Tables(spark, a.store, a.buckets)
    run(spark, a.landed, store, a.checkpoint, a.base, a.files)
    store.read("runs").orderBy("batch", "step").show(100, truncate=False)


if __name__ == "__main__":
    main()
