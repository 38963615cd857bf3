"""Quality of tables: four scores, their weighted sum and a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import scores
from cartulary.functions import vocabulary as V
from cartulary.functions.expressions import elapsed_days, percent


def _filled_percents() -> Column:
    filled = F.col("row_count")
    return F.transform(
        "columns",
        lambda c: F.lit(100).cast("decimal(5,2)")
        - percent(c["null_count"], filled).cast("decimal(5,2)"),
    )


def completeness(facts: DataFrame) -> DataFrame:
    """Share of filled values, averaged over the columns."""
    score = scores.completeness_score(_filled_percents(), F.col("row_count"))
    return facts.withColumn("completeness", score)


def uniqueness(facts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Share of rows left after taking off one for each repeated key.

    ``repeated`` holds one row per table, so it is broadcast; an empty table has none.
    """
    joined = facts.join(F.broadcast(repeated), "table_name", "left")
    duplicates = F.coalesce("duplicate_count", F.lit(0))
    return joined.withColumns(
        {
            "duplicate_count": duplicates,
            "uniqueness": scores.uniqueness_score(duplicates, F.col("row_count")),
        }
    )


def freshness(facts: DataFrame, as_of: Column) -> DataFrame:
    """Age of the newest value in the first date or timestamp column."""
    days = elapsed_days(F.col("latest"), as_of)
    known = F.col("freshness_column").isNotNull()
    return facts.withColumns(
        {"days_since_update": days, "freshness": scores.freshness_score(known, days)}
    )


def validity(facts: DataFrame) -> DataFrame:
    """Share of values that pass the rules, with a text for every rule that fails."""
    checks = F.when(F.col("row_count") > 0, F.size("checks")).otherwise(0)
    issues = F.aggregate("checks", F.lit(0).cast("long"), lambda n, c: n + c["issues"])
    wording = F.create_map(*[F.lit(x) for pair in V.ISSUE_TEXTS.items() for x in pair])
    texts = F.transform(
        F.filter("checks", lambda c: c["issues"] > 0),
        lambda c: F.concat(
            c["column_name"], F.lit(": "), c["issues"], F.lit(" "), wording[c["rule"]]
        ),
    )
    return facts.withColumns(
        {
            "checks_run": checks,
            "issue_count": issues,
            "issues": texts,
            "validity": scores.validity_score(issues, checks, F.col("row_count")),
        }
    )


def grade_tables(scored: DataFrame) -> DataFrame:
    """Adds the weighted sum of the four scores and the grade it earns."""
    overall = scores.overall_score(
        F.col("completeness"), F.col("uniqueness"), F.col("freshness"), F.col("validity")
    )
    return scored.withColumn("overall_score", overall).withColumn(
        "grade", scores.grade(F.col("overall_score"))
    )


def score_tables(facts: DataFrame, repeated: DataFrame, as_of: Column) -> DataFrame:
    """All four scores and the grade for every table in ``facts``."""
    scored = validity(freshness(uniqueness(completeness(facts), repeated), as_of))
    return grade_tables(scored).withColumn("profiled_at", as_of)


def rank_tables(quality: DataFrame) -> DataFrame:
    """Best table first."""
    return quality.orderBy(F.desc_nulls_last("overall_score"), "table_name")
