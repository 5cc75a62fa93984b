"""The complete feature table on a small fixture: width, keys, both id modes, hand-computed values."""
import datetime

import pytest
from pyspark.ml import PipelineModel

from probity.operators import models
from probity.plans import build, features
from probity.sources import schema

AS_OF = 1706745600  # 2024-02-01


@pytest.fixture(scope="module")
def tables(spark):
    t = {name: schema.empty(spark, name) for name in schema.DDL}

    def fill(name, rows):
        cols = t[name].columns
        t[name] = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema.DDL[name])

    day = datetime.date(2024, 1, 2)
    fill("profiles", [dict(id=1, user_id=11, first_name="Иван", last_name="Petrov", status="", about="кредит тут", registered_at=day, last_seen_ts=AS_OF - 86400, is_bot=1), dict(id=2, user_id=12, first_name="Iv4n", last_name="Petrov", registered_at=day), dict(id=3, user_id=13)])
    fill("profile_counters", [dict(id=1, profile_id=1, followers=0, friends=5, groups=4, subscriptions=2), dict(id=2, profile_id=2, followers=10, friends=5)])
    fill("comments", [dict(id=i, owner_id=-1, post_id=1, comment_id=i, from_id=f, reply_to_comment_id=r, timestamp=1704100000 + 600 * i, text=x, likes=i % 2) for i, f, r, x in [(1, 11, None, "Да да нет."), (2, 12, 1, "один два три четыре"), (3, 11, 2, "ааа!!! http://bit.ly/x"), (4, 11, 1, "   "), (5, 0, None, "x")]])
    fill("comment_urls", [dict(id=1, comment_id_fk=3, url="http://bit.ly/x")])
    fill("profile_followers_sample", [dict(id=i, profile_id=p, follower_user_id=f, online=True, sex=1) for i, (p, f) in enumerate([(1, 12), (1, 13), (2, 13), (3, 12)])])
    fill("profile_subscriptions_sample", [dict(id=i, profile_id=p, group_id=g, type=y) for i, (p, g, y) in enumerate([(1, 1, "page"), (1, 2, "group"), (2, 1, "page")])])
    fill("profile_schools", [dict(id=1, profile_id=2, school_id=5, year_graduated=2001)])
    return t


def test_complete(tables):
    out = features.complete(tables, AS_OF)
    assert len(out.columns) == 166 == len(set(out.columns))
    rows = {r["user_id"]: r.asDict() for r in out.collect()}
    assert set(rows) == {11, 12, 13} and rows[11]["target_is_bot"] == 1 and rows[13]["target_is_bot"] == -1
    assert all(v is not None for r in rows.values() for v in r.values())
    a, b = rows[11], rows[12]
    assert a["account_age_days"] == 30 and a["accounts_registered_same_day"] == 2 and a["days_since_last_seen"] == 1
    assert a["ff_ratio"] == 0 and a["ff_ratio_extreme"] == 1 and b["ff_ratio"] == 0.5
    assert a["comments_count"] == 3 and a["url_count"] == 1 and a["total_comments"] == 3 and a["reply_out_degree"] == 2
    assert a["first_name_cyrillic_ratio"] == 1 and b["name_has_digits"] == 1 and b["name_quality_score"] == pytest.approx(0.2)
    assert b["education_career_score"] == 2 and a["avg_group_overlap"] == pytest.approx(a["avg_group_popularity"] - 1) == pytest.approx(0.5)
    assert a["follower_network_density"] == 1.0 and b["follower_network_density"] == 0.0


def test_compat_differs_in_social_family_only_by_position(tables):
    fixed = features.advanced(tables, AS_OF).where("id = 1").first()
    compat = features.advanced(tables, AS_OF, compat=True).where("id = 1").first()
    assert fixed["friends"] == 5 and fixed["followers"] == 0 and compat["followers"] == 10


def test_moving_diversity_equals_the_array_form(spark):
    from pyspark.sql import functions as F

    from probity.functions.text import words
    from probity.operators.profile_features import moving_diversity
    from probity.operators.text_features import mattr

    df = spark.createDataFrame([(u, " ".join(f"w{(i * i + u) % 37}" for i in range(n)), u) for u, n in [(1, 10), (2, 50), (3, 173)]], "user long, text string, id long")
    want = {r[0]: r[1] for r in df.select("user", mattr(words(F.col("text")))).collect()}
    got = {r[0]: r[1] for r in moving_diversity(df, "user", "id", "text").collect()}
    assert got == pytest.approx(want)


def test_build_writes_tables_and_errors(tables, tmp_path):
    broken = dict(tables, profile_subscriptions_sample=tables["profile_subscriptions_sample"].drop("group_id"))
    errors = build.build(broken, str(tmp_path), AS_OF).collect()
    assert [r["part"] for r in errors] == ["network"] and "group_id" in errors[0]["error"]
    spark = tables["profiles"].sparkSession
    done = spark.read.option("header", True).csv(f"{tmp_path}/complete_features")
    assert done.count() == 3 and len(done.columns) == 141
    assert spark.read.option("header", True).csv(f"{tmp_path}/_errors").count() == 1


def test_score_writes_predictions(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    rows = [(i, 100 + i, -1 if i % 5 == 0 else int(i % 7 < 3), float(i % 7), float(i % 3)) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, user_id long, target_is_bot int, a_rate double, b_count double")
    got = build.score(table, str(tmp_path), folds=2, make=lambda: LogisticRegression(labelCol=models.LABEL, featuresCol="features", weightCol=models.WEIGHT))
    assert got["roc_auc"] > 0.95
    p = spark.read.option("header", True).csv(f"{tmp_path}/predictions_calibrated")
    assert p.columns == ["id", "user_id", "bot_probability", "predicted_bot"] and p.count() == 80
    assert PipelineModel.load(f"{tmp_path}/model/1/classifier").stages


def test_score_chooses_the_best_model(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    common = {"labelCol": models.LABEL, "featuresCol": "features", "weightCol": models.WEIGHT}
    # bots are those of a middle a: a line can't tell them, a tree can
    rows = [(i, 100 + i, -1 if i % 6 == 0 else int(2 <= i * 7 % 8 <= 5), float(i * 7 % 8), float(i % 5)) for i in range(420)]
    table = spark.createDataFrame(rows, "id long, user_id long, target_is_bot int, a_rate double, b_count double")
    makes = {"line": lambda **p: LogisticRegression(**common, **p), "tree": lambda **p: DecisionTreeClassifier(**common, **p)}
    got = build.score(table, str(tmp_path), "best", 2, makes=makes, grids={"tree": ({"maxDepth": [1, 4]}, 3)})
    read = lambda n: spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/{n}")
    ranks = {r["model"]: r["rank"] for r in read("comparison").collect()}
    assert ranks == {"tree": 1, "line": 2} and read("holdout").count() == 2
    assert got["roc_auc"] > 0.99
    p = read("predictions_calibrated")
    truth = {i: int(2 <= i * 7 % 8 <= 5) for i, *_ in rows}
    assert p.count() == 70 and all(r["predicted_bot"] == truth[r["id"]] for r in p.collect())


def test_search_drops_draws_and_keeps_the_result(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = [(i, i, int(2 <= i * 7 % 8 <= 5), float(i * 7 % 8), float(i % 5)) for i in range(240)]
    table = models.labelled(spark.createDataFrame(rows, "id long, user_id long, target_is_bot int, a_rate double, b_count double"))
    make = lambda **p: DecisionTreeClassifier(labelCol=models.LABEL, featuresCol="features", **p)
    told: list = []
    best, auc = models.random_search(table, make, {"maxDepth": [0, 1, 4]}, ["a_rate", "b_count"], draws=6, k=2, told=told)
    assert best == {"maxDepth": 4} and auc > 0.99
    assert {d for d, _ in told} == set(range(6)) and len(told) < 12  # all draws began, not all went on
    assert models.cross_validate(table, lambda: make(maxDepth=4), ["a_rate", "b_count"], 2)["roc_auc"] == pytest.approx(auc)
