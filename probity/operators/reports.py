"""Reports: run statistics, data audit, curves, model comparison, top lists."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from probity.operators.metrics import running


def tenths(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, p50, p90): the median, and the exclusive ninth of ten quantiles (n+1 places; the greatest of
    fewer than ten values; 0 of none)."""
    x = F.col(value).cast("double")
    k = df.groupBy(*by, x.alias("_v")).agg(F.count("*").alias("_k"))
    seen = running(k.where("_v is not null"), "_v", ["_k"], by=by)
    # the value of rank r is the first one up to which r values are seen
    n = k.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_k"))), F.lit(0)).alias("n"), F.max("_v").alias("_max"))
    named = n.select(*[F.col(c).alias(f"_g_{c}") for c in by], "n")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    seen = seen.join(named if by else F.broadcast(named), same)
    lo = F.greatest(F.lit(1), F.least(F.floor(9 * (F.col("n") + 1) / 10), F.col("n") - 1))
    at = lambda r: F.min(F.when(F.col("before__k") + F.col("_k") >= r, F.col("_v")))
    pick = seen.groupBy(*by).agg(at(lo).alias("_a"), at(lo + 1).alias("_b"), F.max((9 * (F.col("n") + 1) / 10) - lo).alias("_f"), ((at(F.floor((F.col("n") + 1) / 2)) + at(F.ceil((F.col("n") + 1) / 2))) / 2).alias("p50"))
    pick = pick.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_a", "_b", "_f", "p50")
    out = n.join(pick, same, "left")
    p90 = F.when(F.col("n") >= 10, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).otherwise(F.coalesce("_max", F.lit(0.0)))
    return out.select(*by, "n", F.coalesce("p50", F.lit(0.0)).alias("p50"), p90.alias("p90"))


def ranked(df: DataFrame, order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows in the order, numbered from 1."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(out, F.row_number().over(W.orderBy(*order)))  # k rows


def audit(df: DataFrame) -> DataFrame:
    """(column, rows, missing, mean, std, min, median, max): one aggregate over all columns; numbers alone have
    the last five. Medians are exact to a relative rank error of 1e-4."""
    cols = [(f.name, isinstance(f.dataType, NumericType)) for f in df.schema]
    stats = []
    for i, (c, numeric) in enumerate(cols):
        x = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        stats += [F.count_if(F.col(c).isNull()).alias(f"m{i}"), *[f(x).alias(f"{n}{i}") for n, f in (("a", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))], F.percentile_approx(x, 0.5, 10000).alias(f"d{i}")]
    one = df.agg(F.count("*").alias("rows"), *stats)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"m{i}").alias("missing"), *[F.col(f"{k}{i}").alias(n) for k, n in (("a", "mean"), ("s", "std"), ("l", "min"), ("d", "median"), ("h", "max"))]) for i, (c, _) in enumerate(cols)])
    return one.select(F.inline(rows))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    n = df.groupBy(value).agg(F.count("*").alias("count"))
    return n.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy(F.lit(0))))


def totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """df(key unique) with the sums of rows and values up to each key."""
    x = df.select(key, F.col(value).alias("_x"), F.lit(1).alias("_one"))
    return running(x, key, ["_x", "_one"]).select(key, (F.col("before__one") + 1).alias("items"), (F.col("before__x") + F.col("_x")).alias("total"))


def curves(df: DataFrame, label: str, score: str) -> DataFrame:
    """A row for each distinct score, as a threshold: fpr, tpr, precision, recall of the rows at or above it."""
    k = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    all_ = k.agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    x = running(k, score, ["n", "p"], descending=True).crossJoin(all_)  # one row
    tp, pp = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n")
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return x.select(F.col(score).alias("threshold"), zero(pp - tp, F.col("_n") - F.col("_p")).alias("fpr"), zero(tp, F.col("_p")).alias("tpr"), zero(tp, pp).alias("precision"), zero(tp, F.col("_p")).alias("recall"))


def compare_models(df: DataFrame, model: str, label: str, score: str) -> DataFrame:
    """df(model, label, score) to a row of measures for each model, best AUC first (rank 1; ties by name)."""
    y, s = F.col(label) == 1, F.col(score)
    c = df.groupBy(model).agg(F.count_if(y & (s >= 0.5)).alias("tp"), F.count_if(~y & (s >= 0.5)).alias("fp"), F.count_if(y & (s < 0.5)).alias("fn"), F.avg((y == (s >= 0.5)).cast("double")).alias("accuracy"))
    k = df.groupBy(model, score).agg(F.count("*").alias("n"), F.count_if(y).alias("p"))
    k = running(k, score, ["n"], by=[model]).withColumn("mid", F.col("before_n") + (F.col("n") + 1) / 2).drop("before_n")
    k = running(k, score, ["n", "p"], descending=True, by=[model]).withColumn("prec", (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n")))
    a = k.groupBy(model).agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"), (F.sum(F.col("prec") * F.col("p")) / F.sum("p")).alias("average_precision"))
    zero = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    x = c.join(a, model).withColumns({"precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn")), "roc_auc": (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))})
    x = x.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return x.select(model, F.row_number().over(W.orderBy(F.desc("roc_auc"), model)).alias("rank"), "precision", "recall", "f1", "accuracy", "roc_auc", "average_precision")  # a row for each model


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, pearson) of all pairs of the columns, each pair both ways: one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    both = [(a, b, k) for k, (a, b) in enumerate(pairs)] + [(b, a, k) for k, (a, b) in enumerate(pairs) if a != b]
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("pearson")) for a, b, k in both])))
