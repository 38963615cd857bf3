from pyspark.sql import functions as F

from cartulary.operators import catalog



def stamp():
    return F.lit("2024-02-01 10:00:00").cast("timestamp_ntz")


def later():
    return F.lit("2024-02-02 10:00:00").cast("timestamp_ntz")


def tables(spark, rows, **extra):
    frame = spark.createDataFrame(rows, "table_name string, row_count long, overall_score double")
    frame = frame.withColumns({k: F.lit(v) for k, v in extra.items()})
    return frame.withColumn("grade", F.lit("A"))


def test_upsert(spark, rows):
    old = catalog.table_rows(tables(spark, [("kept", 1, 50.0), ("gone", 2, 60.0)]), stamp())
    old = old.withColumns({"ai_description": F.lit("told"), "ai_tags": F.lit("tags")})
    new = catalog.table_rows(tables(spark, [("kept", 9, 70.0), ("new", 3, 80.0)]), later())
    merged = catalog.upsert_tables(old, new).orderBy("table_name")
    assert merged.columns == old.columns
    found = rows(
        merged.withColumns(
            {c: F.col(c).cast("string") for c in ("created_at", "last_crawled_at")}
        ),
        "table_name", "row_count", "quality_score", "ai_description", "ai_tags",
        "last_crawled_at", "created_at", "schema_name",
    )
    first, second = "2024-02-01 10:00:00", "2024-02-02 10:00:00"
    assert found == [
        ("gone", 2, 60.0, "told", "tags", first, first, "public"),
        ("kept", 9, 70.0, "told", "tags", second, first, "public"),
        ("new", 3, 80.0, None, None, second, second, "public"),
    ]


def test_upsert_takes_new_figures_even_if_null(spark, rows):
    old = catalog.table_rows(tables(spark, [("t", 1, 50.0)]), stamp())
    new = catalog.table_rows(tables(spark, [("t", None, None)]), later())
    merged = catalog.upsert_tables(old, new)
    assert rows(merged, "row_count", "quality_score") == [(None, None)]


def columns(spark, rows):
    frame = spark.createDataFrame(
        rows, "table_name string, column_name string, null_pct double, ai_description string"
    )
    return catalog.fit(frame, "catalog_columns")


def test_columns_of_crawled_tables_are_replaced(spark, rows):
    old = columns(
        spark,
        [("t", "a", 1.0, "about a"), ("t", "b", 2.0, "about b"), ("u", "c", 3.0, "about c")],
    )
    new = columns(spark, [("t", "a", 5.0, None), ("t", "z", 6.0, None)])
    pick = ("table_name", "column_name", "null_pct", "ai_description")
    merged = sorted(rows(catalog.replace_columns(old, new), *pick), key=str)
    assert merged == [("t", "a", 5.0, "about a"), ("t", "z", 6.0, None), ("u", "c", 3.0, "about c")]
    lost = sorted(rows(catalog.replace_columns(old, new, keep_ai=False), *pick), key=str)
    assert lost == [("t", "a", 5.0, None), ("t", "z", 6.0, None), ("u", "c", 3.0, "about c")]
    crawled = spark.createDataFrame([("t",), ("u",)], "table_name string")
    both = sorted(rows(catalog.replace_columns(old, new, crawled), *pick), key=str)
    assert both == [("t", "a", 5.0, "about a"), ("t", "z", 6.0, None)]


def links(spark, rows):
    schema = "source_table string, source_column string, target_table string, target_column string"
    return catalog.fit(spark.createDataFrame(rows, schema), "catalog_relationships")


def test_relationships_of_crawled_tables_are_replaced(spark, rows):
    old = links(spark, [("t", "a", "u", "x"), ("v", "b", "u", "x")])
    new = links(spark, [("t", "c", "u", "x"), ("t", None, "u", "x"), ("t", "d", "", "x")])
    pick = ("source_table", "source_column", "target_table")
    merged = sorted(rows(catalog.replace_relationships(old, new), *pick))
    assert merged == [("t", "c", "u"), ("v", "b", "u")]
    crawled = spark.createDataFrame([("v",)], "table_name string")
    none = links(spark, [])
    left = rows(catalog.replace_relationships(old, none, crawled), *pick)
    assert left == [("t", "a", "u")]


def test_descriptions_are_set_by_key(spark, rows):
    known = catalog.table_rows(tables(spark, [("t", 1, 1.0), ("u", 2, 2.0)]), stamp())
    known = known.withColumns({"ai_description": F.lit("old"), "ai_tags": F.lit("old")})
    updates = spark.createDataFrame(
        [("t", "new", None), ("missing", "x", "y")],
        "table_name string, description string, tags string",
    )
    told = catalog.describe_tables(known, updates)
    found = sorted(rows(told, "table_name", "ai_description", "ai_tags"))
    assert found == [("t", "new", None), ("u", "old", "old")]
    cols = columns(spark, [("t", "a", 0.0, "old"), ("t", "b", 0.0, "old")])
    updates = spark.createDataFrame(
        [("t", "a", "new")], "table_name string, column_name string, description string"
    )
    found = sorted(rows(catalog.describe_columns(cols, updates), "column_name", "ai_description"))
    assert found == [("a", "new"), ("b", "old")]


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "table_name string, column_count int, error string")


def test_crawl_log(spark, rows):
    opened = catalog.open_crawl(spark, "r2", stamp()).unionByName(
        catalog.open_crawl(spark, "r1", stamp())
    )
    assert rows(opened, "status", "tables_crawled") == [("running", 0)] * 2
    failed = outcomes(spark, [("u", 0, "broken"), ("t", 3, None), ("a", 0, "missing")])
    closed = catalog.close_crawl(opened, failed, "r2", later())
    found = sorted(
        rows(closed, "run_id", "tables_crawled", "columns_crawled", "status", "error_message")
    )
    assert found == [
        ("r1", 0, 0, "running", None),
        ("r2", 1, 3, "partial", "a: missing\nu: broken"),
    ]
    clean = catalog.close_crawl(opened, outcomes(spark, [("t", 3, None)]), "r1", later())
    assert ("r1", "success", None) in rows(clean, "run_id", "status", "error_message")
    assert rows(catalog.crawl_totals(failed)) == [(1, 3, 2)]
    assert rows(catalog.crawl_totals(outcomes(spark, []))) == [(0, 0, 0)]


def test_reads(spark, rows):
    found = tables(spark, [("b", 5, 1.0), ("a", 5, 2.0), ("c", None, 3.0)])
    known = catalog.table_rows(found, stamp())
    assert [r[0] for r in rows(catalog.tables_by_size(known))] == ["c", "a", "b"]
    assert [r[0] for r in rows(catalog.tables_for_lineage(known))] == ["a", "b", "c"]
    cols = columns(spark, [("t", "b", 1.0, None), ("t", "a", 2.0, None), ("u", "c", 3.0, None)])
    assert rows(catalog.columns_of(cols, "t")) == [("a", None, 2.0), ("b", None, 1.0)]
    assert [r[1] for r in rows(catalog.columns_for_lineage(cols))] == ["a", "b", "c"]
    found = links(spark, [("v", "b", "u", "x"), ("t", "a", "u", "x")])
    assert [r[0] for r in rows(catalog.relationships_for_lineage(found))] == ["t", "v"]


def test_summary(spark, rows):
    known = catalog.table_rows(tables(spark, [("a", 1, 90.0), ("b", 2, 80.01)]), stamp())
    known = known.withColumn(
        "ai_description", F.when(F.col("table_name") == "a", "told")
    )
    cols = columns(spark, [("a", "x", 0.0, None)] * 3)
    logs = catalog.open_crawl(spark, "old", stamp()).unionByName(
        catalog.open_crawl(spark, "new", later())
    )
    logs = logs.withColumn("tables_crawled", F.when(F.col("run_id") == "new", 2).otherwise(1))
    found = catalog.catalog_summary(known, cols, logs, stamp(), later()).first().asDict()
    assert found == {
        "table_count": 2,
        "avg_quality": 85.01,
        "described_count": 1,
        "column_count": 3,
        "status": "running",
        "tables_crawled": 2,
        "columns_crawled": 0,
        "duration_minutes": 1440.0,
    }
    empty = catalog.catalog_summary(known, cols, logs.limit(0)).first()
    assert (empty["status"], empty["duration_minutes"]) == (None, 0.0)
    assert rows(catalog.coverage(known)) == [(1, 2)]
    assert rows(catalog.described_sample(known, 5)) == [("a", "told", None)]


def test_a_run_without_start_leads_the_log(spark, rows):
    logs = catalog.open_crawl(spark, "a", later()).unionByName(
        catalog.open_crawl(spark, "b", F.lit(None)).withColumn("status", F.lit("unknown"))
    )
    assert rows(catalog.latest_crawl(logs), "status") == [("unknown",)]
