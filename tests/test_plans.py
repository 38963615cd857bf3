"""What the plans look like: shared shuffles, early limits, pushed filters, no cross joins."""

import os

import pytest

from cartulary.operators import stats, traversal
from cartulary.plans import profile as profiling
from checks import row_catalog
from checks.tables import registry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def final_plan(df):
    """The plan as it ran, with what AQE changed; the first of the two parts."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def first_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_and_top_values_share_their_shuffles(spark):
    plans = profiling.table_plans(registry(spark, FOLDER))
    df = stats.value_summary(plans, stats.value_frequencies(plans))
    text = final_plan(df)
    # One per kind of key, and more where texts that tie are settled.
    assert text.count("ReusedExchange") >= 3
    # Each column is read once for its frequencies; texts once more for the lookup of digests, and
    # once more for the smallest of those that occur once.
    scans = text.count("FileScan parquet")
    kinds = sum(
        len({stats.key_kind(c.dtype, True) for c in plan.columns}) for plan in plans
    )
    texts = sum(any(c.label == "string" for c in plan.columns) for plan in plans)
    assert scans <= kinds + 2 * texts


def test_top_values_are_limited_before_they_are_shuffled(spark):
    plans = profiling.table_plans(registry(spark, FOLDER), ["orders"])
    text = first_plan(stats.top_values(plans, stats.value_frequencies(plans)))
    assert "WindowGroupLimit" in text and "Partial" in text and "Final" in text


def test_counts_of_a_table_take_one_scan(spark):
    plan = profiling.table_plans(registry(spark, FOLDER), ["lineitem"])[0]
    text = first_plan(stats.table_facts(plan))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange") == 1
    assert "partial_avg" in text


def test_quality_reads_each_key_once(spark):
    text = final_plan(profiling.quality_profile(registry(spark, FOLDER), "2024-02-01"))
    names = registry(spark, FOLDER).names()
    assert text.count("FileScan parquet") == 2 * len(names)


def test_search_opens_the_files_of_tables_only(spark, tmp_path):
    graph = row_catalog.graph(spark, FOLDER).store()
    text = first_plan(traversal.search_tables(graph, "ring"))
    assert "PartitionFilters: [isnotnull(label" in text
    assert "null_pct" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("question", [traversal.related_tables, traversal.downstream])
def test_questions_about_a_table_leave_the_edges_in_place(spark, question):
    graph = row_catalog.graph(spark, FOLDER).store()
    text = first_plan(question(graph, "supplier_7"))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text

