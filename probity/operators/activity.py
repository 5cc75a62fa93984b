"""Per-account activity: intervals, hours, bursts, reply degrees; keyed dedupe and upsert."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from probity import const


def intervals(df: DataFrame, user: str, t: str, key: str) -> DataFrame:
    """Gaps between a user's consecutive rows in minutes (sample deviation); users of fewer than two rows are absent."""
    gap = (F.col(t) - F.lag(t).over(W.partitionBy(user).orderBy(t, key))) / 60
    per = df.select(user, gap.alias("gap")).groupBy(user).agg(F.count("*").alias("comments_count"), F.avg("gap").alias("interval_mean_minutes"), F.stddev_samp("gap").alias("interval_std_minutes"))
    per = per.where(F.col("comments_count") >= const.ACTIVITY_MIN_COMMENTS)
    cv = F.when(F.col("interval_mean_minutes") > 0, F.col("interval_std_minutes") / F.col("interval_mean_minutes"))
    return per.withColumn("interval_cv", cv).withColumn("suspiciously_regular", F.when(F.col("interval_cv") < 0.5, 1).otherwise(0))


def hours(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Natural-log entropy of hours (more than 5 rows), night and weekend rates, evenness over the hours seen.

    Counts by user and hour come first, so a busy user is at most 24 rows in the second step."""
    k = df.groupBy(user, F.hour(ts).alias("h")).agg(F.count("*").alias("k"), F.count_if(F.weekday(ts) >= 5).alias("we"))
    per = k.groupBy(user).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("s"), F.sum(F.when(F.col("h").between(0, 6), F.col("k")).otherwise(0)).alias("night"), F.sum("we").alias("weekend"), F.count("*").alias("hours"), F.stddev_samp("k").alias("sd"))
    n = F.col("n")
    return per.select(
        user, F.when(n > const.ENTROPY_MIN_COMMENTS, F.log(n) - F.col("s") / n).alias("hour_entropy"), (F.col("night") / n).alias("night_rate"), (F.col("weekend") / n).alias("weekend_rate"),
        F.when(F.col("hours") > 1, 1 - F.col("sd") / (n / F.col("hours"))).otherwise(0.0).alias("hour_uniformity"),
    )


def bursts(df: DataFrame, user: str, ts: str) -> DataFrame:
    """The most rows of a user in one hour and in one day; days are summed from hours."""
    by_hour = df.groupBy(user, F.date_trunc("hour", ts).alias("h")).agg(F.count("*").alias("k"))
    by_day = by_hour.groupBy(user, F.to_date("h").alias("day")).agg(F.max("k").alias("mh"), F.sum("k").alias("kd"))
    return by_day.groupBy(user).agg(F.max("mh").alias("max_in_hour"), F.max("kd").alias("max_in_day"))


def type_entropy(df: DataFrame, user: str, kind: str) -> DataFrame:
    k = df.where(F.col(kind).isNotNull()).groupBy(user, kind).agg(F.count("*").alias("k"))
    per = k.groupBy(user).agg(F.count("*").alias("types"), F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return per.select(user, "types", F.when(F.col("types") > 1, F.log2("n") - F.col("s") / F.col("n")).otherwise(0.0).alias("type_entropy"))


def keep_row(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in the order. An aggregate of structs, so that rows are
    thinned out before the shuffle, which a ranking window can't."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in rest if c not in order])
    best = df.groupBy(*keys).agg((F.max if last else F.min)(row).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def keep_one(df: DataFrame, keys: list[str], order: list[str], out: str, last: bool = False) -> DataFrame:
    return keep_row(df.select(*keys, *order, *([] if out in order else [out])), keys, order, last).select(*keys, out)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """new merged into old by key; a rule gives a column's value from the new and the old one. Columns
    without a rule are overwritten wherever the key is new or updated; columns that new doesn't have keep
    the old value (null in new rows)."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c not in keys], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_n"))
    both = o.join(n, keys, "full")
    out = []
    for c in [c for c in old.columns if c not in keys]:
        b = F.col(f"_o_{c}")
        if c not in new.columns:
            out.append(b.alias(c))
            continue
        a = F.col(f"_n_{c}")
        merged = rules[c](a, b) if c in rules else a
        out.append(F.when(F.col("_n").isNull(), b).otherwise(merged).alias(c))
    return both.select(*keys, *out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in new are replaced; those of other parents stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def reply_degrees(edges: DataFrame, scope: list[str]) -> DataFrame:
    """In- and out-degrees, partners and reciprocity of edges(scope..., src, dst); self replies count both ways."""
    pairs = edges.groupBy(*scope, "src", "dst").agg(F.count("*").alias("k"))
    out = pairs.groupBy(*scope, F.col("src").alias("who")).agg(F.sum("k").alias("out_degree"), F.count("*").alias("out_partners"))
    into = pairs.groupBy(*scope, F.col("dst").alias("who")).agg(F.sum("k").alias("in_degree"), F.count("*").alias("in_partners"))
    back = pairs.select(*scope, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = pairs.join(back, [*scope, "src", "dst"], "left_semi").groupBy(*scope, F.col("src").alias("who")).agg(F.count("*").alias("mutual"))
    keys = [*scope, "who"]
    all_ = out.join(into, keys, "full").join(mutual, keys, "left").na.fill(0)
    top = F.greatest("out_partners", "in_partners")
    return all_.withColumn("reciprocity", F.when(top > 0, F.col("mutual") / top).otherwise(0.0)).withColumn("low_engagement", F.when(F.col("in_degree") < 0.1 * F.col("out_degree"), 1).otherwise(0))
