"""Catalog tables: the rows of a crawl, merges with what is already there, and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.expressions import side_by_side
from cartulary.session import sorted_by

CATALOG_SCHEMAS = {
    "catalog_tables": (
        "table_name string, column_count bigint, row_count bigint, table_size_bytes bigint, "
        "primary_keys string, foreign_key_count bigint, schema_name string, "
        "quality_score double, quality_grade string, completeness double, uniqueness double, "
        "freshness double, validity double, ai_description string, ai_tags string, "
        "last_crawled_at timestamp_ntz, created_at timestamp_ntz"
    ),
    "catalog_columns": (
        "table_name string, column_name string, ordinal int, clean_type string, "
        "raw_type string, max_length int, is_nullable boolean, is_primary_key boolean, "
        "is_foreign_key boolean, references_table string, references_column string, "
        "null_count bigint, null_pct double, ai_description string, "
        "last_crawled_at timestamp_ntz"
    ),
    "catalog_relationships": (
        "source_table string, source_column string, target_table string, "
        "target_column string, relationship_type string, last_crawled_at timestamp_ntz"
    ),
    "crawl_logs": (
        "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, "
        "tables_crawled bigint, columns_crawled bigint, status string, error_message string"
    ),
}

KEPT_BY_UPSERT = ("schema_name", "ai_description", "ai_tags", "created_at")


def empty_catalog(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMAS[name])


def fit(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the column order and types of a catalog table; missing columns are null."""
    wanted = [piece.split(" ") for piece in CATALOG_SCHEMAS[name].split(", ")]
    return rows.select(
        [
            (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
            for c, t in wanted
        ]
    )


# ---------------------------------------------------------------------------------------------
# Rows of a crawl
# ---------------------------------------------------------------------------------------------


def table_rows(profiled: DataFrame, crawled_at: Column) -> DataFrame:
    """Catalog rows from the table side of a profile."""
    renamed = profiled.withColumns(
        {
            "quality_score": F.col("overall_score"),
            "quality_grade": F.col("grade"),
            "schema_name": F.lit("public"),
            "last_crawled_at": crawled_at,
            "created_at": crawled_at,
        }
    )
    return fit(renamed, "catalog_tables")


def column_rows(profiled: DataFrame, crawled_at: Column) -> DataFrame:
    """Catalog rows from the column side of a profile."""
    return fit(profiled.withColumn("last_crawled_at", crawled_at), "catalog_columns")


def relationship_rows(found: DataFrame, crawled_at: Column) -> DataFrame:
    return fit(found.withColumn("last_crawled_at", crawled_at), "catalog_relationships")


# ---------------------------------------------------------------------------------------------
# Merges
# ---------------------------------------------------------------------------------------------


def upsert_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old catalog tables with those of a crawl merged in by name.

    A known table takes the new figures and keeps its descriptions and creation time, a new one
    is added, and one the crawl did not see stays as it is.
    """
    o, n = old.alias("o"), new.alias("n")
    seen = F.col("n.table_name").isNotNull()
    known = F.col("o.table_name").isNotNull()
    merged = [F.coalesce("n.table_name", "o.table_name").alias("table_name")]
    for name in old.columns[1:]:
        ours, theirs = F.col(f"o.{name}"), F.col(f"n.{name}")
        keep = known if name in KEPT_BY_UPSERT else ~seen
        merged.append(F.when(keep, ours).otherwise(theirs).alias(name))
    return o.join(n, F.col("o.table_name") == F.col("n.table_name"), "full_outer").select(merged)


def replace_columns(
    old: DataFrame, new: DataFrame, crawled: DataFrame | None = None, keep_ai: bool = True
) -> DataFrame:
    """Old catalog columns with those of the crawled tables replaced.

    ``crawled`` names the tables; without it they are the ones the new rows belong to. A
    description survives for a column that is still there, unless ``keep_ai`` is off.
    """
    crawled = _names(new, "table_name") if crawled is None else crawled.select("table_name")
    fresh = new
    if keep_ai:
        keys = ["table_name", "column_name"]
        described = old.where("ai_description is not null").select(
            *keys, F.col("ai_description").alias("_kept")
        )
        fresh = (
            new.join(described, keys, "left")
            .withColumn("ai_description", F.coalesce("ai_description", "_kept"))
            .select(new.columns)
        )
    return old.join(crawled, "table_name", "left_anti").select(new.columns).unionByName(fresh)


def replace_relationships(
    old: DataFrame, new: DataFrame, crawled: DataFrame | None = None
) -> DataFrame:
    """Old relationships with those that start at a crawled table replaced.

    New rows need a source column and a target table.
    """
    crawled = (
        _names(new, "source_table")
        if crawled is None
        else crawled.select(F.col("table_name").alias("source_table"))
    )
    valid = new.where("source_column <> '' and target_table <> ''")
    kept = old.join(crawled, "source_table", "left_anti").select(new.columns)
    return kept.unionByName(valid)


def _names(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def describe_tables(tables: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets description and tags of the tables named in (table_name, description, tags)."""
    new = updates.select(
        "table_name",
        F.lit(True).alias("_hit"),
        F.col("description").alias("_description"),
        F.col("tags").alias("_tags"),
    )
    joined = tables.join(new, "table_name", "left")
    return joined.withColumns(
        {
            "ai_description": F.when(F.col("_hit"), F.col("_description")).otherwise(
                F.col("ai_description")
            ),
            "ai_tags": F.when(F.col("_hit"), F.col("_tags")).otherwise(F.col("ai_tags")),
        }
    ).select(tables.columns)


def describe_columns(columns: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets the description of the columns named in (table_name, column_name, description)."""
    keys = ["table_name", "column_name"]
    new = updates.select(
        *keys, F.lit(True).alias("_hit"), F.col("description").alias("_description")
    )
    text = F.when(F.col("_hit"), F.col("_description")).otherwise(F.col("ai_description"))
    joined = columns.join(new, keys, "left")
    return joined.withColumn("ai_description", text).select(columns.columns)


# ---------------------------------------------------------------------------------------------
# Crawl log
# ---------------------------------------------------------------------------------------------


def open_crawl(spark: SparkSession, run_id: str, started_at: Column) -> DataFrame:
    """The log row of a crawl that has just started."""
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        started_at.alias("started_at"),
        F.lit(0).alias("tables_crawled"),
        F.lit(0).alias("columns_crawled"),
        F.lit("running").alias("status"),
    )
    return fit(row, "crawl_logs")


def crawl_totals(outcomes: DataFrame) -> DataFrame:
    """Tables and columns crawled and number of errors, from (table_name, column_count, error).

    A table with an error counts neither itself nor its columns.
    """
    return outcomes.agg(*_totals(), F.count("error").alias("error_count"))


def _totals() -> list[Column]:
    good = F.col("error").isNull()
    columns = F.sum(F.when(good, F.col("column_count")))
    return [
        F.count_if(good).alias("tables_crawled"),
        F.coalesce(columns, F.lit(0)).alias("columns_crawled"),
    ]


def crawl_result(outcomes: DataFrame) -> DataFrame:
    """What the end of a crawl adds to its log row: totals, status and the errors, a line each.

    Outcomes have a row per table of the registry, and failed ones are few.
    """
    failed = F.when(
        F.col("error").isNotNull(), F.concat_ws(": ", F.col("table_name"), F.col("error"))
    )
    totals = outcomes.agg(
        *_totals(), F.array_sort(F.collect_list(failed)).alias("errors")
    )
    clean = F.size("errors") == 0
    return totals.select(
        "tables_crawled",
        "columns_crawled",
        F.when(clean, "success").otherwise("partial").alias("status"),
        F.when(~clean, F.array_join("errors", "\n")).alias("error_message"),
    )


def closed_crawl(started: DataFrame, outcomes: DataFrame, finished_at: Column) -> DataFrame:
    """The completed log row of a run, from its (run_id, started_at) and its outcomes."""
    closed = side_by_side(started, crawl_result(outcomes))
    return fit(closed.withColumn("finished_at", finished_at), "crawl_logs")


def close_crawl(
    logs: DataFrame, outcomes: DataFrame, run_id: str, finished_at: Column
) -> DataFrame:
    """The log with the row of this run completed."""
    started = logs.where(F.col("run_id") == run_id).select("run_id", "started_at")
    closed = closed_crawl(started, outcomes, finished_at)
    return logs.where(F.col("run_id") != run_id).unionByName(closed)


# ---------------------------------------------------------------------------------------------
# Reads
# ---------------------------------------------------------------------------------------------


def tables_by_size(tables: DataFrame) -> DataFrame:
    """Largest table first; tables without a count lead, as in a descending SQL sort."""
    return tables.select("table_name", "row_count", "column_count").orderBy(
        F.desc_nulls_first("row_count"), "table_name"
    )


def columns_of(columns: DataFrame, table: str) -> DataFrame:
    """Name, label and null share of the columns of one table, by name."""
    return (
        columns.where(F.col("table_name") == table)
        .select("column_name", "clean_type", "null_pct")
        .orderBy("column_name")
    )


def tables_for_lineage(tables: DataFrame) -> DataFrame:
    return tables.select(
        "table_name",
        "row_count",
        "column_count",
        "quality_score",
        "quality_grade",
        "ai_description",
        "ai_tags",
        "last_crawled_at",
    ).orderBy("table_name")


def columns_for_lineage(columns: DataFrame) -> DataFrame:
    found = columns.select(
        "table_name",
        "column_name",
        "clean_type",
        "is_nullable",
        "is_primary_key",
        "is_foreign_key",
        "references_table",
        "references_column",
        "null_pct",
        "ai_description",
    )
    return sorted_by(found, "table_name", "column_name")


def relationships_for_lineage(found: DataFrame) -> DataFrame:
    """Foreign keys by source table; the other names only settle the order of equals."""
    names = ["source_table", "source_column", "target_table", "target_column"]
    return found.select(*names, "relationship_type").orderBy(names)


# ---------------------------------------------------------------------------------------------
# Figures about the catalog
# ---------------------------------------------------------------------------------------------


def coverage(tables: DataFrame) -> DataFrame:
    """How many of the tables have a description."""
    return tables.agg(
        F.count("ai_description").alias("described"), F.count(F.lit(1)).alias("total")
    )


def described_sample(tables: DataFrame, limit: int) -> DataFrame:
    """The first few described tables."""
    return (
        tables.where("ai_description is not null")
        .select("table_name", "ai_description", "ai_tags")
        .orderBy("table_name")
        .limit(limit)
    )


def latest_crawl(logs: DataFrame) -> DataFrame:
    """Status and totals of the run that started last; one not yet started counts as later."""
    return (
        logs.orderBy(F.desc_nulls_first("started_at"), F.desc("run_id"))
        .limit(1)
        .select("status", "tables_crawled", "columns_crawled")
    )


def minutes_between(started_at: Column, finished_at: Column) -> Column:
    """Duration in minutes with one decimal; 0 where the start is unknown."""
    seconds = F.unix_micros(finished_at.cast("timestamp")) - F.unix_micros(
        F.coalesce(started_at, finished_at).cast("timestamp")
    )
    return F.round(seconds.cast("decimal(20,0)") / F.lit(60000000), 1).cast("double")


def catalog_summary(
    tables: DataFrame,
    columns: DataFrame,
    logs: DataFrame,
    started_at: Column | None = None,
    finished_at: Column | None = None,
) -> DataFrame:
    """One row about the whole catalog: counts, average quality, latest crawl, duration."""
    finished = F.current_timestamp() if finished_at is None else finished_at
    started = finished if started_at is None else started_at
    facts = tables.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.round(F.avg("quality_score"), 2).alias("avg_quality"),
        F.count("ai_description").alias("described_count"),
    )
    counted = columns.agg(F.count(F.lit(1)).alias("column_count"))
    return side_by_side(facts, counted, latest_crawl(logs)).withColumn(
        "duration_minutes", minutes_between(started, finished)
    )
