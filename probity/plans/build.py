"""The two jobs of the feature build, as commands.

    python -m probity.plans.build features TABLES OUT [--as-of SECONDS] [--compat]
    python -m probity.plans.build score FEATURES OUT [--model NAME] [--folds K]

TABLES: a SQLite file, or a folder that holds the stored tables as Parquet (CSV with --csv). `features` writes
advanced, text, network and complete_features below OUT as CSV with a header, and _errors: a row for each
table that failed, which doesn't stop the others. `score` reads complete_features, fits a calibrated model on
the labelled accounts, chooses the threshold of the best F1, and writes predictions_calibrated (CSV), metrics
(CSV) and the fitted models (folder `model`). With --model best it compares all models first (`comparison`), searches
the parameters of the best three (`holdout`), and goes on with the best of these on rows that no fit has seen.
"""
from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import clean as C
from probity.operators import metrics as M
from probity.operators import models as L
from probity.plans import features
from probity.sources import schema
from probity.sources.sqlite import SqliteSource


def stored_tables(spark: SparkSession, place: str, csv: bool = False) -> dict[str, DataFrame]:
    """The stored tables by name, from a SQLite file or a folder."""
    if not place.endswith((".sqlite", ".db", ".sqlite3")):
        return schema.tables(spark, place, "csv" if csv else "parquet")
    spark.dataSource.register(SqliteSource)
    return {n: spark.read.format("sqlite_table").schema(ddl).option("path", place).option("table", n).load() for n, ddl in schema.DDL.items()}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def build(t: dict[str, DataFrame], out: str, as_of: int, compat: bool = False) -> DataFrame:
    """Writes the feature tables of the stored tables t below out; returns _errors(part, error)."""
    spark = t["profiles"].sparkSession
    parts: dict[str, Callable[[], DataFrame]] = {"advanced": lambda: features.advanced(t, as_of, compat), "text": lambda: features.text(t), "network": lambda: features.network(t, compat)}
    made: dict[str, DataFrame] = {}
    errors: list[tuple[str, str]] = []
    for name, make in parts.items():
        try:
            df = C.kept(make())
            write_csv(df, f"{out}/{name}")
            made[name] = df
        except Exception as e:  # one part's failure leaves the others
            errors.append((name, f"{type(e).__name__}: {str(e).partition(chr(10))[0][:500]}"))
    if "advanced" in made:
        write_csv(features.assembled(made["advanced"], made.get("text"), made.get("network")), f"{out}/complete_features")
    found = spark.createDataFrame(errors, "part string, error string")
    write_csv(found, f"{out}/_errors")
    return found


def score(table: DataFrame, out: str, model: str = "gradient_boosting", folds: int = 5, make: Callable | None = None, makes: dict[str, Callable] | None = None, grids: dict | None = None) -> dict[str, float]:
    """Fits, chooses the threshold and writes predictions, metrics and models below out."""
    table = table.select(*[F.col(c) if c in L.KEYS else F.col(c).cast("double").alias(c) for c in table.columns]).na.fill(0)
    known = C.kept(M.stratified_split(L.labelled(table), L.LABEL, "id"))
    names = L.feature_names(known)
    train, test = known.where("not is_test"), known.where("is_test")
    makes, chosen = makes or L.classifiers(), {}
    if make is None and model == "best":
        rows, held = L.compare(train, test, names, makes, grids, folds)
        for name, found in (("comparison", rows), ("holdout", held)):
            flat = [{"rank": i + 1, **{k: json.dumps(v) if isinstance(v, dict) else v for k, v in r.items()}} for i, r in enumerate(found)]
            write_csv(table.sparkSession.createDataFrame(flat).coalesce(1), f"{out}/{name}")  # a row for each model
        model, chosen = held[0]["model"], held[0]["parameters"]
    apply = L.calibrated(train, make or (lambda: makes[model](**chosen)), names, folds)
    rated = C.kept(apply(test))
    best = M.best_threshold(M.threshold_grid(rated, L.LABEL, L.SCORE)).first()
    measures = {**L.evaluate(rated), "threshold": best["threshold"], "threshold_f1": best["f1"]}
    write_csv(L.predict(apply, table, best["threshold"]), f"{out}/predictions_calibrated")
    write_csv(table.sparkSession.createDataFrame(sorted((k, float(v or 0.0)) for k, v in measures.items()), "measure string, value double"), f"{out}/metrics")
    for i, (fitted, platt) in enumerate(apply.pairs):
        fitted.write().overwrite().save(f"{out}/model/{i}/classifier")
        platt.write().overwrite().save(f"{out}/model/{i}/calibration")
    return measures


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=["features", "score"])
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--as-of", type=int, default=int(time.time()))
    p.add_argument("--compat", action="store_true")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--model", default="gradient_boosting")
    p.add_argument("--folds", type=int, default=5)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "features":
        build(stored_tables(spark, a.source, a.csv), a.out, a.as_of, a.compat).show(truncate=False)
    else:
        print(score(spark.read.option("header", True).option("inferSchema", True).csv(a.source), a.out, a.model, a.folds))


if __name__ == "__main__":
    main()
