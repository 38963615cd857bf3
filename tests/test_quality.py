from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cartulary import Constraints, Registry, TableSource
from cartulary.functions import scores
from cartulary.operators import quality
from cartulary.plans import profile as profiling

NOW = datetime(2024, 2, 1)


def scored(spark, frame, key=(), required=(), as_of=NOW):
    reg = Registry(
        spark, [TableSource("t", frame=frame)], Constraints({"t": key}, (), {"t": required})
    )
    return profiling.quality_profile(reg, as_of).first()


def aged(days):
    return F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def test_published_scores(spark):
    # A table of 500 without nulls, its newest row some days old, no key violated.
    users = spark.range(500).select(
        "id", F.concat(F.lit("n"), "id").alias("email"), aged(3).alias("created_at")
    )
    assert scored(spark, users, ("id",), ("email",))["overall_score"] == 97.0
    # No check applies: 95 for validity.
    addresses = spark.range(10).select("id", aged(0).alias("created_at"))
    assert scored(spark, addresses, ("id",))["overall_score"] == 98.75
    # 5 of 22 null in one of six columns.
    categories = spark.range(22).select(
        "id",
        F.lit("x").alias("category_name"),
        F.when(F.col("id") >= 5, F.col("id")).alias("parent_id"),
        F.lit("d").alias("description"),
        F.lit(True).alias("is_active"),
        aged(0).alias("created_at"),
    )
    found = scored(spark, categories, ("id",), ("category_name",))
    assert (found["completeness"], found["overall_score"]) == (96.21, 98.67)
    # 427 of 1000 null in one of nine columns, a few days old.
    payments = spark.range(1000).select(
        "id",
        *[F.lit("x").alias(f"c{i}") for i in range(6)],
        F.when(F.col("id") >= 427, F.col("id")).alias("amount"),
        aged(5).alias("created_at"),
    )
    found = scored(spark, payments, ("id",))
    assert (found["completeness"], found["freshness"]) == (95.26, 80.0)
    assert (found["overall_score"], found["grade"]) == (95.34, "A")


def test_empty_tables(spark):
    with_time = spark.createDataFrame([], "id int, created_at timestamp, price double")
    found = scored(spark, with_time, ("id",))
    assert (found["freshness"], found["overall_score"], found["checks_run"]) == (50.0, 92.5, 0)
    without = scored(spark, spark.createDataFrame([], "id int"), ("id",))
    assert (without["freshness"], without["overall_score"]) == (70.0, 95.5)


@pytest.mark.parametrize(
    "days, score",
    [(-400, 100), (0, 100), (1, 100), (2, 80), (7, 80), (8, 60), (30, 60), (31, 40), (90, 40),
     (91, 20)],
)
def test_freshness_steps(spark, days, score):
    found = spark.range(1).select(scores.freshness_score(F.lit(True), F.lit(days))).first()[0]
    assert found == score


def test_first_date_column_in_table_order_counts(spark):
    frame = spark.range(3).select(
        "id", F.lit(None).cast("date").alias("born_on"), aged(0).alias("created_at")
    )
    found = scored(spark, frame)
    assert (found["freshness_column"], found["freshness"]) == ("born_on", 50.0)
    dated = spark.range(3).select(F.to_date(aged(2)).alias("d"))
    assert scored(spark, dated)["days_since_update"] == 2


def test_duplicate_groups_and_rounding(spark):
    frame = spark.createDataFrame([(i // 2,) for i in range(6)] + [(9,)], "id int")
    found = scored(spark, frame, ("id",))
    assert (found["duplicate_count"], found["uniqueness"]) == (3, 57.14)


def test_rules_and_their_texts(spark):
    frame = spark.createDataFrame(
        [(-1.0, " ", 0, -5, -2), (1.0, "x", 5, 3, 1), (None, None, None, 4, 1)],
        "unit_price double, title string, rating int, discount int, other int",
    )
    found = scored(spark, frame, (), ("title",))
    # discount holds the word count; other holds no word.
    assert found["checks_run"] == 4
    assert found["issues"] == [
        "unit_price: 1 negative values found",
        "title: 1 empty string values found",
        "rating: 1 ratings outside 1-5 range",
        "discount: 1 negative values found",
    ]
    assert found["validity"] == 66.67


def test_a_rule_that_always_fails_scores_zero(spark):
    # One column, two rules, both broken by every row.
    frame = spark.createDataFrame([(-1,), (-2,)], "rating_count int")
    found = scored(spark, frame)
    assert (found["checks_run"], found["issue_count"], found["validity"]) == (2, 4, 0.0)


@pytest.mark.parametrize(
    "score, grade", [(100, "A"), (90, "A"), (89.99, "B"), (80, "B"), (70, "C"), (60, "D"), (0, "F")]
)
def test_grades(spark, score, grade):
    assert spark.range(1).select(scores.grade(F.lit(float(score)))).first()[0] == grade


def test_ranking(spark, rows):
    found = [("b", 90.0), ("a", 90.0), ("c", 95.0)]
    frame = spark.createDataFrame(found, "table_name string, overall_score double")
    assert rows(quality.rank_tables(frame), "table_name") == [("c",), ("a",), ("b",)]
