"""Measures of binary classifiers over (label, score) tables, each one aggregate or one window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def threshold_grid(df: DataFrame, label: str, score: str, lo: float = 0.05, hi: float = 0.95, steps: int = 50) -> DataFrame:
    """(threshold, precision, recall, f1) at evenly spaced thresholds.

    Rows are counted by the last threshold that they reach; the counts at a threshold are sums from there
    on, so the rows aren't multiplied by the number of thresholds."""
    step = (hi - lo) / (steps - 1)
    grid = df.sparkSession.range(steps).select(F.col("id").alias("i"), (F.lit(lo) + F.col("id") * step).alias("threshold"))
    # the bin from the same thresholds that are compared, against rounding
    at = F.lit(-1)
    guess = F.floor((F.col(score) - lo) / step)
    for d in (-1, 0, 1):
        at = F.when(F.col(score) >= F.lit(lo) + (guess + d) * step, guess + d).otherwise(at)
    bins = df.select(F.least(at, F.lit(steps - 1)).alias("i"), label).groupBy("i").agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    positives = bins.agg(F.sum("p").alias("all_p"))
    w = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    both = grid.join(bins, "i", "full").where(F.col("i") >= 0).withColumn("tp", F.coalesce(F.sum("p").over(w), F.lit(0))).withColumn("pp", F.coalesce(F.sum("n").over(w), F.lit(0)))
    both = both.where("threshold is not null").crossJoin(positives)  # one row
    precision = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    recall = F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).otherwise(0.0)
    out = both.select("threshold", precision.alias("precision"), recall.alias("recall"))
    s = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The row of the highest f1; ties to the smaller threshold."""
    return grid.orderBy(F.desc("f1"), "threshold").limit(1)


def precise_threshold(grid: DataFrame) -> DataFrame:
    """The row of the highest precision, then the highest recall; ties to the smaller threshold."""
    return grid.orderBy(F.desc("precision"), F.desc("recall"), "threshold").limit(1)


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn, accuracy and the Brier score."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    return df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.avg((y == p).cast("double")).alias("accuracy"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"),
    )


#: Value ranges that a running sum is cut into.
RANGES = 256


def range_of(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts are at most value, by halves."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts))


def running(df: DataFrame, value: str, sums: list[str], descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """df(by..., value unique in its group, ...) with before_<c> for each of sums: its sum over all rows of the
    group of smaller (greater, if descending) values.

    Approximate quantiles of all values cut them into ranges of about as many rows; sums of a group's ranges, a few
    hundred rows, are added up and meet the rows of their range, which each have a window of their own. So no task
    sorts all values, nor all of a hot group's. Null values come first (last, if descending); null groups are one."""
    cuts = df.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10000)).first()[0] or []
    x = df.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(range_of(F.col(value), sorted(set(cuts)))))
    per = x.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    turn = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_first(c))
    ahead = W.partitionBy(*by).orderBy(turn("_range")).rowsBetween(W.unboundedPreceding, -1)  # RANGES + 1 rows of a group at most
    per = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_to_{c}") for c in sums])
    w = W.partitionBy(*by, "_range").orderBy(turn(value)).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    x = x.join(per if by else F.broadcast(per), same)
    return x.select(*df.columns, *[(F.col(f"_to_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"before_{c}") for c in sums])


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from ranks (ties share their mean rank)."""
    k = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    ranks = running(k, score, ["n"]).withColumn("mid", F.col("before_n") + (F.col("n") + 1) / 2)
    s = ranks.agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("roc_auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """The step sum of precision over recall, by distinct score."""
    k = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    c = running(k, score, ["n", "p"], descending=True)
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    return c.agg((F.sum(precision * F.col("p")) / F.sum("p")).alias("average_precision"))


def in_class_ranks(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """df with _rank (from 1) and _size in its class, in the order of a seeded hash.

    Ranks are counts of 2**16 hash bins plus the rank within the bin, so no class is sorted in one task."""
    x = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_b", F.shiftrightunsigned("_h", 48))
    bins = x.groupBy(label, "_b").agg(F.count("*").alias("n"))
    w = W.partitionBy(label).orderBy("_b")
    b = bins.select(F.col(label).alias("_l"), F.col("_b").alias("_bb"), (F.sum("n").over(w) - F.col("n")).alias("_before"), F.sum("n").over(W.partitionBy(label)).alias("_size"))
    y = x.join(b, x[label].eqNullSafe(b["_l"]) & (x["_b"] == b["_bb"]))
    return y.select(*df.columns, (F.col("_before") + F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key))).alias("_rank"), "_size")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: exactly the rounded share of each class, by seeded hash."""
    y = in_class_ranks(df, label, key, seed)
    return y.withColumn("is_test", F.col("_rank") <= F.round(F.col("_size") * share).cast("long")).drop("_rank", "_size")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1: each class is dealt in turn, so folds hold equal numbers of it, but for one."""
    return in_class_ranks(df, label, key, seed).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_size")


def average_ranks(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(key, r_<col>...): ranks, ties at their mean, from counts by distinct value."""
    out = df
    for c in cols:
        k = running(df.groupBy(c).agg(F.count("*").alias("n")), c, ["n"])
        r = k.select(F.col(c).alias(f"_{c}"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"r_{c}"))
        out = out.join(r, F.col(c) == F.col(f"_{c}"))
    return out.select(key, *[f"r_{c}" for c in cols])
