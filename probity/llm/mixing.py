"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets by source come from water-filling; blocks of equal size go to sources, and the tokens of each
source's blocks (blocks of one) to its shards, by highest quotients size / (2 * seats + 1). Within a shard,
documents stand in an order that the seed fixes, as one line of tokens; a shard takes its quota of tokens
from that line, whole passes first and the rest from its start.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probity.llm.common import stage

SIZE = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents of a shard, about; and shards of a source at most.
SHARD_ROWS, SHARDS = 4096, 4096
#: A block is this part of the smallest positive target, and at least one token.
GRAIN = 256


def apportion(rows: DataFrame, by: list[str], weight: str, seats: str, out: str, most: str) -> DataFrame:
    """rows with out: its seats among the rows of the same `by`, by the highest quotients weight/(2s+1).

    `seats` (the same in each group) is the number of seats, `most` a row's limit. Ties go to the smaller `at`,
    a unique order of the rows. Rows without weight or limit get none; seats beyond all limits stay free.

    The divisor is bracketed first: n rows hold within n/2 of sum(min(most, weight / (2 * divisor))) quotients,
    and that sum is solved by the order in which rows reach their limits. Quotients above the bracket are seats
    at once; those inside, fewer than 4n + 4 in all, are ranked.
    """
    g = W.partitionBy(*by)
    base = rows.withColumn("_m", F.when(F.col(weight) > 0, F.greatest(F.col(most), F.lit(0))).otherwise(0).cast("double"))
    base = base.withColumn("_c", F.when(F.col("_m") > 0, F.col(weight) / (2 * F.col("_m") - 1)))
    order = g.orderBy(F.desc_nulls_last("_c"), "at")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    w = F.when(F.col("_m") > 0, F.col(weight).cast("double")).otherwise(0.0)
    base = base.withColumns(
        {
            "_i": F.row_number().over(order),
            "_full": F.coalesce(F.sum("_m").over(before), F.lit(0.0)),
            "_left": F.sum(w).over(order.rowsBetween(0, W.unboundedFollowing)),
            "_up": F.coalesce(F.lag("_c").over(order), F.lit(float("inf"))),
            "_n": F.count("*").over(g) / 2 + 1,
        }
    )

    def divisor(goal: Column) -> Column:
        level = F.when(goal > F.col("_full"), F.col("_left") / (2 * (goal - F.col("_full")))).otherwise(F.lit(float("inf")))
        reached = F.col("_full") + F.col("_left") / (2 * F.col("_c")) >= goal
        return F.coalesce(F.min(F.when(reached, F.struct("_i", F.least("_up", level).alias("v")))).over(g)["v"], F.lit(0.0))

    def held(div: Column) -> Column:
        return F.when(div > 0, F.floor((F.col(weight) / div + 1) / 2)).otherwise(F.col("_m"))

    base = base.withColumns({"_high": divisor(F.col(seats) - F.col("_n")), "_low": divisor(F.col(seats) + F.col("_n"))})
    base = base.withColumns({"_base": F.greatest(F.lit(0), F.least("_m", held(F.col("_high"))) - F.when(F.col("_high") > 0, 1).otherwise(0)).cast("long"), "_end": F.least("_m", held(F.col("_low")) + 1).cast("long")})
    base = base.withColumn("_base", F.when(F.col("_m") > 0, F.col("_base")).otherwise(0)).withColumn("_free", F.col(seats) - F.sum("_base").over(g))
    claims = base.where("_m > 0 and _end > _base").select(*by, "at", weight, "_free", F.explode(F.sequence(F.col("_base"), F.col("_end") - 1)).alias("_s"))
    claims = claims.withColumn("_q", F.col(weight) / (2 * F.col("_s") + 1))
    won = claims.withColumn("_r", F.row_number().over(g.orderBy(F.desc("_q"), "at", "_s"))).where(F.col("_r") <= F.col("_free")).groupBy(*by, "at").agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in [*by, "at"]], "_won")
    cond = F.col("at") == F.col("_w_at")
    for c in by:
        cond &= F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return base.join(won, cond, "left").select(*rows.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias(out))


def targets(sizes: DataFrame, total: int) -> DataFrame:
    """sizes(source, source_size, ...) with weight and target.

    target = min(CAP * size, level * weight) with the one level at which the targets sum up to total: the
    fixed point of handing the excess over the caps on by weight. Sources by cap / weight ascending; the
    level is that of the first one whose cap isn't reached.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, WEIGHTS))[(F.row_number().over(order) - 1) % len(WEIGHTS)]
    t = sizes.withColumn("weight", w.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(CAP)))
    at = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = at.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_level", (F.lit(float(total)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(at.rowsBetween(0, W.unboundedFollowing)))
    level = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("_level").alias("v")))).over(W.partitionBy(F.lit(0)))["v"]
    return t.withColumn("target", F.least(F.col("_cap"), level * F.col("weight"))).drop("_cap", "_level")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """docs without its text, with size, source_size, target and taken behind its columns.

    size: words of the text (null: 0). Sources in order of code points, null last, weigh WEIGHTS, repeated,
    and share the sum of all sizes; no target exceeds CAP times its source's size. taken: the words that
    the mix takes of the row, repeats counted; CAP * size at most. The sum of a source's taken words is its
    quota of blocks, within a block of its target. Rows with equal key, text and source are alike: which of
    them is taken does not matter. Null keys are ordered first. An empty table gives no rows, and where
    all sizes are 0 all targets are. Columns of docs named like one of the four are replaced.
    """
    spark = docs.sparkSession
    names = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in (text, *names)]
    # the text's hash spreads rows of one key, null ones above all
    rank: Column = F.xxhash64(F.lit(seed), docs[key], docs[text])
    rows = stage(docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[source].alias("source"), F.coalesce(F.regexp_count(docs[text], F.lit(SIZE)), F.lit(0)).cast("long").alias("size"), rank.alias("rank"), docs[key].alias("key")))
    per = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    goal = stage(targets(per, total))
    least = goal.where(F.col("target") > 0).agg(F.min("target")).first()[0]
    block = max(1, int((least or 1) / GRAIN))
    goal = goal.withColumn("shards", F.least(F.lit(SHARDS), F.ceil(F.col("n") / SHARD_ROWS)).cast("long"))
    seated = goal.select("*", F.lit(0).alias("all"), F.lit(round(total / block)).cast("long").alias("seats"), F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())).alias("at"), F.floor(F.col("source_size") * CAP / block).cast("long").alias("most"))
    quota = stage(apportion(seated, ["all"], "target", "seats", "blocks", "most").select("source", "source_size", "target", "shards", "blocks", "at"))

    # at most one row for each source: broadcast or not as Spark measures it
    q = quota.select(F.col("source").alias("q_source"), "source_size", "target", "shards", "blocks", F.col("at").alias("source_at"))
    placed = rows.join(q, rows["source"].eqNullSafe(q["q_source"]))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "rank"), F.col("shards")))
    shards = placed.groupBy("source_at", "shard").agg(F.sum("size").cast("double").alias("shard_size"), (F.first("blocks") * block).alias("tokens"))
    # seats of one token: a shard holds CAP * shard_size of them, so the shards of a source hold all its blocks
    shards = shards.withColumns({"at": F.col("shard"), "most": (F.col("shard_size") * CAP).cast("long")})
    shards = stage(apportion(shards, ["source_at"], "shard_size", "tokens", "quota", "most").select(F.col("source_at").alias("s_at"), F.col("shard").alias("s_shard"), F.col("shard_size").cast("long").alias("shard_size"), F.col("quota").alias("tokens")))
    line = placed.join(shards, (F.col("source_at") == F.col("s_at")) & (F.col("shard") == F.col("s_shard")))
    w = W.partitionBy("source_at", "shard").orderBy("rank", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("tokens") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("tokens") - passes * F.col("shard_size") - F.coalesce(F.sum("size").over(w), F.lit(0))
    taken = passes * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return line.select("row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))
