"""Quality scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions import vocabulary as V
from cartulary.functions.expressions import ratio, round2


def completeness_score(filled_percents: Column, row_count: Column) -> Column:
    """Mean of the rounded percentages in the array; 100 for an empty table."""
    exact = F.aggregate(
        filled_percents,
        F.lit(0).cast("decimal(20,2)"),
        lambda total, pct: (total + pct.cast("decimal(5,2)")).cast("decimal(20,2)"),
    )
    mean = round2(ratio(exact, F.size(filled_percents)))
    return F.when(row_count == 0, float(V.EMPTY_TABLE_SCORE)).otherwise(mean)


def uniqueness_score(duplicates: Column, row_count: Column) -> Column:
    """Share of rows beyond the number of repeated keys; 100 for an empty table."""
    score = round2(ratio(row_count - duplicates, row_count, 100))
    return F.when(row_count == 0, float(V.EMPTY_TABLE_SCORE)).otherwise(score)


def freshness_score(has_column: Column, days: Column) -> Column:
    """Steps over the age in days; fixed scores without a column or without a value."""
    score = F.when(~has_column, V.NO_FRESHNESS_COLUMN_SCORE).when(
        days.isNull(), V.NO_FRESHNESS_VALUE_SCORE
    )
    for limit, points in V.FRESHNESS_STEPS:
        score = score.when(days <= limit, points)
    return score.otherwise(V.STALE_SCORE).cast("double")


def validity_score(issues: Column, checks: Column, row_count: Column) -> Column:
    """100 minus the share of failed checks, at least 0; fixed where nothing was checked."""
    failed = ratio(issues, row_count * checks, 100)
    score = F.greatest(F.lit(0.0), round2(F.lit(100).cast("decimal(3,0)") - failed))
    return (
        F.when(row_count == 0, float(V.EMPTY_TABLE_SCORE))
        .when(checks == 0, float(V.NO_CHECKS_SCORE))
        .otherwise(score)
    )


def overall_score(
    completeness: Column, uniqueness: Column, freshness: Column, validity: Column
) -> Column:
    """Weighted sum of the four scores, each with two decimals."""
    scores = {
        "completeness": completeness,
        "uniqueness": uniqueness,
        "freshness": freshness,
        "validity": validity,
    }
    total = F.lit(0).cast("decimal(10,4)")
    for name, weight in V.WEIGHTS.items():
        total = total + scores[name].cast("decimal(10,2)") * F.lit(weight).cast("decimal(3,2)")
    return round2(total)


def grade(score: Column) -> Column:
    letter = None
    for limit, name in V.GRADE_STEPS:
        test = score >= limit
        letter = F.when(test, name) if letter is None else letter.when(test, name)
    return letter.otherwise(V.LOWEST_GRADE)
