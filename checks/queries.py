"""One query per operator, over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary import Registry, TableSource
from cartulary.functions import scores
from cartulary.functions.expressions import as_of_column, elapsed_days, side_by_side
from cartulary.operators import catalog, generation, lineage, prompts, quality, schema, stats
from cartulary.operators import traversal
from cartulary.operators.increments import FileStates
from cartulary.plans import describe as describing
from cartulary.plans import profile as profiling
from cartulary.plans import refresh as refreshing
from cartulary.plans.crawl import crawl, crawl_sampled
from cartulary.session import materialize, scratch_root
from cartulary.sources import cache as caching
from cartulary.sources.store import CatalogStore
from checks import row_catalog as rows
from checks.tables import AS_OF, CONSTRAINTS, footer_registry, gappy_registry, registry, table

KEYS = ["table_name", "column_name"]


def fixed_now():
    return as_of_column(AS_OF)


@contextmanager
def scratch_store(spark: SparkSession) -> Iterator[CatalogStore]:
    """A catalog of its own, dropped at the end: results read from it are written aside first."""
    store = CatalogStore(spark, f"check_{uuid.uuid4().hex}").setup()
    try:
        yield store
    finally:
        store.drop()


def facts_of(reg, ranges=False) -> DataFrame:
    plans = profiling.table_plans(reg)
    return stats.union_all([stats.table_facts(p, ranges=ranges) for p in plans])


# ---------------------------------------------------------------------------------------------
# Profiles and quality of the test tables
# ---------------------------------------------------------------------------------------------


def flagship_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(profiling.quality_profile(registry(spark, sf_dir), AS_OF))


def _scores(found: DataFrame) -> DataFrame:
    return found.select(
        "table_name",
        "row_count",
        "completeness",
        "duplicate_count",
        "uniqueness",
        F.col("days_since_update").cast("bigint").alias("days_since_update"),
        "freshness",
        F.col("checks_run").cast("bigint").alias("checks_run"),
        "issue_count",
        F.array_join("issues", "; ").alias("issues"),
        "validity",
        "overall_score",
        "grade",
    )


def gappy_quality(spark, sf_dir):
    return _scores(profiling.quality_profile(gappy_registry(spark, sf_dir), AS_OF))


def footer_quality(spark, sf_dir):
    """Quality with row and null counts from file footers."""
    return _scores(profiling.quality_profile(footer_registry(spark, sf_dir), AS_OF))


def table_list(spark, sf_dir):
    """Tables to crawl with their row and column counts."""
    reg = registry(spark, sf_dir)
    counted = facts_of(reg).select("table_name", "row_count", F.size("columns").alias("n"))
    return (
        reg.list_tables()
        .join(counted, "table_name")
        .select("table_name", "row_count", F.col("n").cast("bigint").alias("column_count"))
    )


def table_metadata(spark, sf_dir):
    """The table side of a crawl."""
    found = profiling.profile_tables(registry(spark, sf_dir), AS_OF, sizes=False).tables
    return found.select(
        "table_name",
        "row_count",
        F.col("column_count").cast("bigint").alias("column_count"),
        "primary_keys",
        "foreign_key_count",
        "overall_score",
        "grade",
    )


def table_size(spark, sf_dir):
    return registry(spark, sf_dir).table_sizes()


def crawl_totals(spark, sf_dir):
    return catalog.crawl_totals(_outcomes(spark, sf_dir))


def _outcomes(spark, sf_dir) -> DataFrame:
    """What a crawl notes about each table; a table without rows would count as failed."""
    found = facts_of(registry(spark, sf_dir))
    empty = F.when(F.col("row_count") == 0, "no rows")
    return found.select("table_name", F.size("columns").alias("column_count"), empty.alias("error"))


def crawl_log(spark, sf_dir):
    """The log row of a crawl whose tables fail where their quality is below A."""
    found = profiling.quality_profile(registry(spark, sf_dir), AS_OF)
    failed = F.when(F.col("grade") > "A", F.concat(F.lit("grade "), F.col("grade")))
    outcomes = found.select("table_name", "column_count", failed.alias("error"))
    opened = catalog.open_crawl(spark, "run-1", fixed_now())
    return catalog.close_crawl(opened, outcomes, "run-1", fixed_now()).select(
        "run_id", "tables_crawled", "columns_crawled", "status", "error_message"
    )


def latest_crawl(spark, sf_dir):
    """Every day of events as a crawl: its errors are the tables that failed."""
    return catalog.latest_crawl(_daily_logs(spark, sf_dir))


def _daily_logs(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    good = F.col("event_type") != "error"
    return events.groupBy(F.to_date("ts").cast("string").alias("run_id")).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
        F.count_if(good).alias("tables_crawled"),
        F.count_distinct(F.when(good, F.col("user_id"))).alias("columns_crawled"),
        F.when(F.count_if(~good) == 0, "success").otherwise("partial").alias("status"),
    )


def crawl_runs(spark, sf_dir):
    """The log of a run per day of events; days with an odd number of users are still running.

    Every run is an event that opens it and, later, one that closes it.
    """
    logs = catalog.fit(_daily_logs(spark, sf_dir), "crawl_logs")
    opened = logs.select(
        "run_id",
        "started_at",
        F.lit(0).alias("tables_crawled"),
        F.lit(0).alias("columns_crawled"),
        F.lit("running").alias("status"),
    )
    with scratch_store(spark) as store:
        store.put("crawl_logs", catalog.fit(opened, "crawl_logs"))
        store.put("crawl_logs", logs.where("columns_crawled % 2 = 0"))
        times = {c: F.col(c).cast("string") for c in ("started_at", "finished_at")}
        found = store.read("crawl_logs").withColumns(times).drop("error_message")
        return materialize(found, "log")


def crawl_durations(spark, sf_dir):
    logs = _daily_logs(spark, sf_dir)
    minutes = catalog.minutes_between(F.col("started_at"), F.col("finished_at"))
    return logs.select("run_id", minutes.alias("duration_minutes"))


def quality_rank(spark, sf_dir):
    found = profiling.quality_profile(registry(spark, sf_dir), AS_OF)
    return quality.rank_tables(found.select("table_name", "row_count", "overall_score", "grade"))


def uniqueness(spark, sf_dir):
    reg = registry(spark, sf_dir)
    repeated = stats.repeated_keys(profiling.table_plans(reg))
    found = quality.uniqueness(facts_of(reg), repeated)
    return found.select("table_name", "row_count", "duplicate_count", "uniqueness")


def freshness(spark, sf_dir):
    found = quality.freshness(facts_of(registry(spark, sf_dir)), fixed_now())
    return found.select(
        "table_name",
        "freshness_column",
        F.col("latest").cast("string").alias("latest"),
        F.col("days_since_update").cast("bigint").alias("days_since_update"),
        "freshness",
    )


def freshness_steps(spark, sf_dir):
    """Every order as a table last updated on its date, seen from near the newest date."""
    days = elapsed_days(F.col("o_orderdate"), as_of_column("2001-07-20 12:00:00"))
    return (
        table(spark, sf_dir, "orders")
        .select(scores.freshness_score(F.lit(True), days).alias("freshness"))
        .groupBy("freshness")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def completeness(spark, sf_dir):
    found = quality.completeness(facts_of(gappy_registry(spark, sf_dir)))
    return found.select("table_name", "row_count", "completeness")


def _checks(spark, sf_dir, rule: str) -> DataFrame:
    found = facts_of(gappy_registry(spark, sf_dir)).select("table_name", F.inline("checks"))
    return found.where(F.col("rule") == rule).select("table_name", "column_name", "issues")


def validity_negative(spark, sf_dir):
    return _checks(spark, sf_dir, "negative")


def validity_blank(spark, sf_dir):
    return _checks(spark, sf_dir, "blank")


def validity_rating(spark, sf_dir):
    return _checks(spark, sf_dir, "rating")


def validity_score(spark, sf_dir):
    found = quality.validity(facts_of(gappy_registry(spark, sf_dir)))
    return found.select(
        "table_name",
        F.col("checks_run").cast("bigint").alias("checks_run"),
        "issue_count",
        F.array_join("issues", "; ").alias("issues"),
        "validity",
    )


def grade(spark, sf_dir):
    """Every line as a table: quantity, discount, tax and line number give its four scores."""
    line = table(spark, sf_dir, "lineitem").select(
        F.round(F.col("l_quantity") * 2, 2).alias("completeness"),
        F.round(100 - F.col("l_discount") * 100, 2).alias("uniqueness"),
        F.round(F.col("l_linenumber") * 14.25, 2).alias("validity"),
        F.round(100 - F.col("l_tax") * 1000, 2).alias("freshness"),
    )
    return (
        quality.grade_tables(line)
        .groupBy("grade")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.min("overall_score").alias("lowest"),
            F.max("overall_score").alias("highest"),
        )
    )


def column_nulls(spark, sf_dir):
    found = stats.column_nulls(facts_of(gappy_registry(spark, sf_dir)))
    return found.select(*KEYS, "null_count", "null_pct", "filled_pct")


def column_minmax(spark, sf_dir):
    found = stats.column_ranges(stats.column_nulls(facts_of(registry(spark, sf_dir), ranges=True)))
    return found.where("min_number is not null").select(
        *KEYS, "min_value", "max_value", "avg_value", "min_number", "max_number", "avg_number"
    )


def column_distinct(spark, sf_dir):
    plans = profiling.table_plans(registry(spark, sf_dir))
    found = stats.distinct_counts(stats.value_frequencies(plans))
    return stats.name_columns(plans, found).select(*KEYS, "distinct_count")


def column_topk(spark, sf_dir):
    plans = profiling.table_plans(registry(spark, sf_dir))
    found = stats.top_values(plans, stats.value_frequencies(plans, stats.has_top_values))
    return stats.name_columns(plans, found).select(
        *KEYS, F.col("rank").cast("bigint").alias("rank"), "value", "freq"
    )


def column_profile(spark, sf_dir):
    """The column side of a crawl, from one pass for counts and one for values."""
    found = profiling.column_statistics(registry(spark, sf_dir))
    return _column_side(found)


def gappy_profile(spark, sf_dir):
    return _column_side(profiling.column_statistics(gappy_registry(spark, sf_dir)))


def _column_side(found: DataFrame) -> DataFrame:
    return found.select(
        *KEYS,
        "clean_type",
        "row_count",
        "null_count",
        "null_pct",
        "distinct_count",
        "min_value",
        "max_value",
        F.array_join("top_values", " | ").alias("top_values"),
    )


def approx_distinct(spark, sf_dir):
    """Exact distinct counts, and whether the sketches of a profile are within a twentieth."""
    reg = registry(spark, sf_dir)
    plans = profiling.table_plans(reg)
    sketched = profiling.column_statistics(reg, sketches=True)
    exact = stats.name_columns(plans, stats.distinct_counts(stats.value_frequencies(plans)))
    estimate = sketched.select(*KEYS, F.col("distinct_count").alias("estimate"))
    off = F.abs(F.col("estimate") - F.col("distinct_count")) / F.col("distinct_count")
    return exact.join(estimate, KEYS).select(*KEYS, "distinct_count", (off <= 0.05).alias("close"))


def incremental_profile(spark, sf_dir):
    """Columns and keys of all tables, from states that an earlier profile kept for their files."""
    reg = registry(spark, sf_dir)
    states = FileStates(spark, f"{scratch_root(spark)}/states-{uuid.uuid4().hex}")
    for _ in range(2):
        found = profiling.profile_tables(reg, AS_OF, states=states)
    tables = found.tables.select("table_name", "duplicate_count", "overall_score", "grade")
    columns = found.columns.select(
        *KEYS, "row_count", "null_count", "null_pct", "min_number", "max_number", "avg_number"
    )
    return columns.join(tables, "table_name")


def sample_values(spark, sf_dir):
    plans = profiling.table_plans(registry(spark, sf_dir))
    found = stats.sample_values(plans)
    return found.select(*KEYS, F.array_join("values", " | ").alias("sample"))


# ---------------------------------------------------------------------------------------------
# Descriptors, with a raw type for every part and a foreign key for every line
# ---------------------------------------------------------------------------------------------

RAW_TYPE = """
CASE p_type
  WHEN 'STANDARD' THEN concat('character varying(', p_size, ')')
  WHEN 'SMALL' THEN concat(' NUMERIC(', p_size, ', ', p_size % 7, ') ')
  WHEN 'MEDIUM' THEN concat('timestamp(', p_size % 10, ') with time zone')
  WHEN 'LARGE' THEN CASE WHEN p_size > 25 THEN 'bigint' ELSE 'double precision' END
  WHEN 'ECONOMY' THEN CASE WHEN p_size > 25 THEN 'integer[]' ELSE 'jsonb' END
  ELSE CASE WHEN p_size > 40 THEN 'numeric(x)' WHEN p_size > 20 THEN 'text'
       WHEN p_size > 10 THEN concat('numeric(', p_size, ')') ELSE 'interval' END
END"""
DEFAULT = "CASE WHEN p_size > 45 THEN '' WHEN p_size > 30 THEN p_name END"


def raw_columns(spark, sf_dir) -> DataFrame:
    """Every part as a column of the table its brand names."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS table_name",
        "CAST(p_partkey AS INT) AS ordinal",
        "concat('part_', p_partkey) AS name",
        f"{RAW_TYPE} AS type",
        "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS nullable",
        f"{DEFAULT} AS `default`",
    )


def type_normalize(spark, sf_dir):
    return schema.parse_types(raw_columns(spark, sf_dir)).select("name", "raw_type", "clean_type")


def type_params(spark, sf_dir):
    found = schema.parse_types(raw_columns(spark, sf_dir))
    return found.select("name", "max_length", "precision", "scale")


def parse_column(spark, sf_dir):
    return schema.parse_columns(raw_columns(spark, sf_dir)).select(
        "table_name", "column_name", "clean_type", "is_nullable", "has_default", "default_value"
    )


def raw_foreign_keys(spark, sf_dir) -> DataFrame:
    """Every line as a foreign key of its order: two columns, one, or none at all."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('order_', l_orderkey) AS table_name",
        "l_linenumber AS fk_ordinal",
        "CASE WHEN l_returnflag = 'R' THEN array() "
        "ELSE array(concat('line_', l_linenumber), 'l_suppkey') END AS constrained_columns",
        "CASE WHEN l_linestatus = 'O' THEN concat('part_', l_partkey) END AS referred_table",
        "CASE WHEN l_returnflag = 'A' THEN array() ELSE array('p_partkey', 'ps_suppkey') END "
        "AS referred_columns",
    )


def parse_fk(spark, sf_dir):
    return schema.parse_foreign_keys(raw_foreign_keys(spark, sf_dir))


def mark_keys(spark, sf_dir):
    """Columns of every order; several lines may make one column a foreign key."""
    return _marked(spark, sf_dir).select(
        *KEYS, "is_primary_key", "is_foreign_key", "references_table", "references_column"
    )


def _marked(spark, sf_dir) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    own = orders.selectExpr(
        "concat('order_', o_orderkey) AS table_name",
        "0 AS ordinal",
        "'o_orderkey' AS name",
        "'bigint' AS type",
        "false AS nullable",
        "CAST(NULL AS STRING) AS `default`",
    )
    per_line = lines.selectExpr(
        "concat('order_', l_orderkey) AS table_name",
        "l_linenumber AS ordinal",
        "concat('line_', l_linenumber) AS name",
        "'integer' AS type",
        "l_linenumber > 2 AS nullable",
        "CAST(NULL AS STRING) AS `default`",
    ).distinct()
    keys = own.select(
        "table_name", F.col("name").alias("column_name"), F.lit(1).alias("ordinal")
    )
    foreign = lines.selectExpr(
        "concat('order_', l_orderkey) AS table_name",
        "l_partkey AS fk_ordinal",
        "concat('line_', l_linenumber) AS column",
        "concat('part_', l_partkey) AS references_table",
        "'p_partkey' AS references_column",
    )
    return schema.mark_keys(schema.parse_columns(own.unionByName(per_line)), keys, foreign)


def table_summary(spark, sf_dir):
    found = schema.summarize_tables(_marked(spark, sf_dir))
    return found.select(
        "table_name",
        "column_count",
        F.array_join("primary_key_cols", ", ").alias("primary_key_cols"),
        F.array_join("nullable_cols", ", ").alias("nullable_cols"),
        F.array_join("required_cols", ", ").alias("required_cols"),
    )


# ---------------------------------------------------------------------------------------------
# Catalog tables: two crawls, the later one over what changed since a date
# ---------------------------------------------------------------------------------------------

FIRST_UNTIL, SECOND_FROM = "1998-06-01", "1997-01-01"


def _customer_crawl(spark, sf_dir, period: str, day: str) -> DataFrame:
    """Customers as tables, with the orders a crawl saw as rows."""
    seen = table(spark, sf_dir, "orders").where(period).groupBy("o_custkey")
    found = seen.agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    at = F.lit(day).cast("timestamp_ntz")
    profiled = found.select(
        rows.named("customer", "o_custkey").alias("table_name"),
        F.lit(6).alias("column_count"),
        F.col("n").alias("row_count"),
        (F.col("top") / 5000).alias("overall_score"),
        scores.grade(F.col("top") / 5000).alias("grade"),
    )
    return catalog.table_rows(profiled, at)


def catalog_upsert(spark, sf_dir):
    """Two crawls saved to a store, the second over tables the first knows and new ones."""
    old = _customer_crawl(spark, sf_dir, f"o_orderdate < '{FIRST_UNTIL}'", "2024-01-01")
    described = old.withColumn("ai_description", F.concat(F.lit("about "), "table_name"))
    new = _customer_crawl(spark, sf_dir, f"o_orderdate >= '{SECOND_FROM}'", "2024-02-01")
    with scratch_store(spark) as store:
        store.upsert_tables(described)
        store.upsert_tables(materialize(new, "crawled"))
        found = store.read("catalog_tables").select(
            "table_name",
            "row_count",
            "quality_score",
            "quality_grade",
            "ai_description",
            F.col("last_crawled_at").cast("string").alias("last_crawled_at"),
            F.col("created_at").cast("string").alias("created_at"),
        )
        return materialize(found, "catalog")


def _order_columns(spark, sf_dir, period: str) -> DataFrame:
    """Orders as tables and their distinct lines as columns."""
    lines = table(spark, sf_dir, "lineitem").where(period)
    found = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return catalog.fit(
        found.select(
            rows.named("order", "l_orderkey").alias("table_name"),
            rows.named("line", "l_linenumber").alias("column_name"),
            F.col("q").alias("null_pct"),
        ),
        "catalog_columns",
    )


def catalog_replace(spark, sf_dir):
    old = _order_columns(spark, sf_dir, f"l_shipdate < '{FIRST_UNTIL}'").withColumn(
        "ai_description", F.concat_ws(".", "table_name", "column_name")
    )
    new = materialize(_order_columns(spark, sf_dir, f"l_shipdate >= '{SECOND_FROM}'"), "crawled")
    with scratch_store(spark) as store:
        store.put("catalog_columns", old)
        store.replace_columns(new, new.select("table_name").distinct())
        found = store.read("catalog_columns").select(*KEYS, "null_pct", "ai_description")
        return materialize(found, "catalog")


def relationship_replace(spark, sf_dir):
    def crawl(period):
        lines = table(spark, sf_dir, "lineitem").where(period)
        found = lines.select(
            rows.named("order", "l_orderkey").alias("source_table"),
            F.when(F.col("l_returnflag") != "R", rows.named("line", "l_linenumber")).alias(
                "source_column"
            ),
            F.when(F.col("l_linestatus") == "O", rows.named("part", "l_partkey"))
            .otherwise("")
            .alias("target_table"),
            F.lit("p_partkey").alias("target_column"),
        ).distinct()
        return catalog.fit(found, "catalog_relationships")

    new = materialize(crawl(f"l_shipdate >= '{SECOND_FROM}'"), "crawled")
    with scratch_store(spark) as store:
        store.put("catalog_relationships", crawl(f"l_shipdate < '{FIRST_UNTIL}'"))
        store.replace_relationships(new, new.select(F.col("source_table").alias("table_name")))
        found = store.read("catalog_relationships")
        found = found.select("source_table", "source_column", "target_table", "target_column")
        return materialize(found, "catalog")


def describe_tables(spark, sf_dir):
    """Descriptions for the tables of all orders that are open."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    updates = orders.select(
        rows.named("order", "o_orderkey").alias("table_name"),
        F.concat(F.lit("open since "), F.to_date("o_orderdate").cast("string")).alias(
            "description"
        ),
        F.col("o_orderpriority").alias("tags"),
    )
    found = catalog.describe_tables(rows.catalog_tables(spark, sf_dir), updates)
    return found.select("table_name", "ai_description", "ai_tags")


def describe_columns(spark, sf_dir):
    """Descriptions for the customer columns of all orders."""
    orders = table(spark, sf_dir, "orders")
    updates = orders.select(
        rows.named("order", "o_orderkey").alias("table_name"),
        F.lit("o_custkey").alias("column_name"),
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("description"),
    )
    found = catalog.describe_columns(rows.catalog_columns(spark, sf_dir), updates)
    return found.select(*KEYS, "ai_description")


def tables_by_size(spark, sf_dir):
    return catalog.tables_by_size(rows.catalog_tables(spark, sf_dir))


def table_columns(spark, sf_dir):
    return catalog.columns_of(rows.catalog_columns(spark, sf_dir), "order_7")


def lineage_tables(spark, sf_dir):
    found = catalog.tables_for_lineage(rows.catalog_tables(spark, sf_dir))
    return found.withColumn("last_crawled_at", F.col("last_crawled_at").cast("string"))


def lineage_columns(spark, sf_dir):
    return catalog.columns_for_lineage(rows.catalog_columns(spark, sf_dir))


def lineage_relationships(spark, sf_dir):
    return catalog.relationships_for_lineage(rows.catalog_relationships(spark, sf_dir))


def coverage(spark, sf_dir):
    return catalog.coverage(rows.catalog_tables(spark, sf_dir))


def described_sample(spark, sf_dir):
    return describing.described_sample(rows.catalog_tables(spark, sf_dir))


def catalog_summary(spark, sf_dir):
    found = catalog.catalog_summary(
        rows.catalog_tables(spark, sf_dir),
        rows.catalog_columns(spark, sf_dir),
        _daily_logs(spark, sf_dir),
        F.lit("2024-01-31 23:50:30").cast("timestamp_ntz"),
        fixed_now(),
    )
    return found


# ---------------------------------------------------------------------------------------------
# Prompts and cached generation
# ---------------------------------------------------------------------------------------------


def _catalog_side(spark, sf_dir):
    """Tables with row counts, columns with null shares, and samples of the test tables."""
    reg = registry(spark, sf_dir)
    facts = facts_of(reg)
    tables = facts.select("table_name", "row_count")
    columns = stats.column_nulls(facts).select(*KEYS, "clean_type", "null_pct")
    return tables, columns, describing.sample_values(reg)


def prompt_table(spark, sf_dir):
    return prompts.table_prompts(*_catalog_side(spark, sf_dir))


def prompt_column(spark, sf_dir):
    reg = gappy_registry(spark, sf_dir)
    columns = stats.column_nulls(facts_of(reg)).select(*KEYS, "clean_type", "null_pct")
    return prompts.column_prompts(columns, describing.sample_values(reg))


def prompt_tags(spark, sf_dir):
    """Tag prompts for every table of the row catalog."""
    described = rows.catalog_tables(spark, sf_dir).select(
        "table_name", F.col("ai_description").alias("description")
    )
    return prompts.tag_prompts(described, rows.catalog_columns(spark, sf_dir))


def prompt_relationship(spark, sf_dir):
    found = rows.catalog_relationships(spark, sf_dir).distinct()
    return prompts.relationship_prompts(found)


def _document_prompts(spark, sf_dir) -> DataFrame:
    """Every document as a prompt; copies are the same prompt."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))


def _document_cache(spark, sf_dir) -> DataFrame:
    """Responses for the English documents, some of them empty."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'")
    response = F.when(F.col("source") == "src0", "").otherwise(F.col("source"))
    answered = english.groupBy(F.col("text").alias("prompt")).agg(
        F.min(response).alias("response")
    )
    return caching.cache_entries(answered, fixed_now().cast("timestamp"))


def cache_key(spark, sf_dir):
    found = _document_prompts(spark, sf_dir)
    return found.select("doc_id", caching.prompt_key(F.col("prompt")).alias("key"))


def cache_lookup(spark, sf_dir):
    found = caching.look_up(_document_prompts(spark, sf_dir), _document_cache(spark, sf_dir))
    return found.select("doc_id", "key", "response")


def cache_misses(spark, sf_dir):
    found = caching.misses(_document_prompts(spark, sf_dir), _document_cache(spark, sf_dir))
    return found.select("key", F.length("prompt").cast("bigint").alias("characters"))


def _answers(spark, sf_dir) -> DataFrame:
    """A response for every distinct document."""
    found = table(spark, sf_dir, "documents").groupBy(F.col("text").alias("prompt"))
    response = F.when(F.col("source") == "src0", "").otherwise(F.col("source"))
    return caching.cache_entries(found.agg(F.min(response).alias("response")), fixed_now().cast("timestamp"))


def _scratch_cache(spark) -> caching.ResponseCache:
    return caching.ResponseCache(spark, f"{scratch_root(spark)}/answers-{uuid.uuid4().hex}")


def cache_save(spark, sf_dir):
    """A cache of all documents after a second save, in which one source is answered anew.

    The prompts of all other documents are new ones.
    """
    again = F.when(F.col("source") == "src1", F.col("text")).otherwise(F.concat(F.lit("Again: "), "text"))
    new = table(spark, sf_dir, "documents").select(again.alias("prompt"), F.lit("new").alias("response"))
    cache = _scratch_cache(spark)
    cache.save(_answers(spark, sf_dir))
    cache.save(caching.cache_entries(new.distinct()))
    return cache.load().select("key", "response", "prompt_preview")


def cache_stats(spark, sf_dir):
    """Figures of a cache before anything is saved, with all documents, and cleared."""
    cache = _scratch_cache(spark)

    def figures(state):
        here = (F.col("cache_path") == cache.path).alias("located")
        found = cache.stats().select(F.lit(state).alias("state"), "total_cached", here, "exists")
        return materialize(found, "figures")

    states = [figures("new")]
    cache.save(_answers(spark, sf_dir))
    states.append(figures("saved"))
    cache.clear()
    return stats.union_all([*states, figures("cleared")])


def text_length_generator():
    """A stand-in for a model, whose answers SQL can give too."""

    def make():
        def respond(batch, lengths):
            return [f"  Text of {len(prompt)} characters \n" for prompt in batch]

        return respond

    return make


def generate_batch(spark, sf_dir):
    answered, _ = generation.answer_from(
        _document_prompts(spark, sf_dir),
        _document_cache(spark, sf_dir),
        text_length_generator(),
    )
    return answered.select("doc_id", "key", "response")


def _described(spark, sf_dir) -> describing.Descriptions:
    """Texts for the test tables; what they are made from is written aside first."""
    tables, columns, samples = (
        materialize(side, "catalog-side") for side in _catalog_side(spark, sf_dir)
    )
    return describing.describe(tables, columns, samples, _scratch_cache(spark), text_length_generator())


def generate_descriptions(spark, sf_dir):
    """Descriptions of the test tables and, from these, their tags."""
    return _described(spark, sf_dir).tables


def generate_column_descriptions(spark, sf_dir):
    return _described(spark, sf_dir).columns


# ---------------------------------------------------------------------------------------------
# Lineage over the row catalog
# ---------------------------------------------------------------------------------------------


def graph_nodes(spark, sf_dir):
    return rows.graph(spark, sf_dir).nodes.select(
        "label",
        "full_name",
        "name",
        "table_name",
        "row_count",
        "column_count",
        "quality_score",
        "quality_grade",
        "description",
        "tags",
        "data_type",
        "is_nullable",
        "is_primary_key",
        "is_foreign_key",
        "null_pct",
    )


def graph_edges(spark, sf_dir):
    return rows.graph(spark, sf_dir).all_edges()


def graph_keys(spark, sf_dir):
    """Nodes that share a name: the tables that two crawls saw, before they are merged."""
    crawls = [
        _customer_crawl(spark, sf_dir, f"o_orderdate < '{FIRST_UNTIL}'", "2024-01-01"),
        _customer_crawl(spark, sf_dir, f"o_orderdate >= '{SECOND_FROM}'", "2024-02-01"),
    ]
    return lineage.repeated_nodes(lineage.table_nodes(stats.union_all(crawls), rows.DATABASE))


def cleared_graph(spark, sf_dir):
    """Nodes and edges in a new store, after a graph is put there, and after it is cleared."""
    graph = rows.graph(spark, sf_dir)
    with scratch_store(spark) as store:

        def counted(state):
            found = [
                store.read(name).groupBy(F.lit(name).alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
                for name in ("lineage_nodes", "lineage_edges")
            ]
            return materialize(stats.union_all(found).withColumn("state", F.lit(state)), "counted")

        states = [counted("new")]
        store.put_graph(graph)
        states.append(counted("stored"))
        store.clear_graph()
        return stats.union_all([*states, counted("cleared")])


def graph_node_counts(spark, sf_dir):
    return lineage.node_counts(rows.graph(spark, sf_dir).nodes)


def graph_edge_counts(spark, sf_dir):
    return lineage.edge_counts(rows.graph(spark, sf_dir).edges)


def relationship_map(spark, sf_dir):
    return lineage.relationship_map(rows.catalog_relationships(spark, sf_dir))


def related_tables(spark, sf_dir):
    return traversal.related_tables(rows.graph(spark, sf_dir), "supplier_7")


def upstream(spark, sf_dir):
    return traversal.upstream(rows.graph(spark, sf_dir), "order_7")


def downstream(spark, sf_dir):
    return traversal.downstream(rows.graph(spark, sf_dir), "supplier_7")


def foreign_keys(spark, sf_dir):
    return traversal.foreign_keys(rows.graph(spark, sf_dir))


def hubs(spark, sf_dir):
    return traversal.hubs(rows.graph(spark, sf_dir))


PATH_ENDS = ("customer_3", "customer_9")


def _path(spark, sf_dir, edge_types) -> DataFrame:
    found = traversal.lineage_path(rows.graph(spark, sf_dir), *PATH_ENDS, edge_types)
    return found.select(
        F.array_join("path", " > ").alias("path"), F.col("hops").cast("bigint").alias("hops")
    )


def lineage_path_all(spark, sf_dir):
    return _path(spark, sf_dir, lineage.EDGE_TYPES)


def lineage_path_fk(spark, sf_dir):
    return _path(spark, sf_dir, (lineage.RELATED_TO,))


def search(spark, sf_dir):
    return traversal.search_tables(rows.graph(spark, sf_dir), "Ring")


def search_documents(spark, sf_dir):
    """The same search over whole documents."""
    found = table(spark, sf_dir, "documents")
    hit = traversal.matches_keyword("THE ", F.col("text"), F.col("source"))
    return found.where(hit).select("doc_id", "lang", "n_chars")


def database_lineage(spark, sf_dir):
    """Edges of the lineage of the test tables, with the row counts at both ends."""
    reg = registry(spark, sf_dir)
    facts = facts_of(reg)
    tables = catalog.fit(facts.select("table_name", "row_count", "column_count"), "catalog_tables")
    columns = catalog.fit(
        stats.column_nulls(facts).select(*KEYS, "clean_type", "null_pct"), "catalog_columns"
    )
    links = profiling.relationships(schema.parse_foreign_keys(reg.raw_foreign_keys()))
    graph = lineage.build_graph(tables, columns, links, "tests", rows.stamp())
    counted = graph.nodes.select("full_name", "row_count")
    source = counted.select(F.col("full_name").alias("src"), F.col("row_count").alias("source_rows"))
    target = counted.select(F.col("full_name").alias("dst"), F.col("row_count").alias("target_rows"))
    return (
        graph.edges.join(source, "src")
        .join(target, "dst")
        .select("type", "src", "source_rows", "dst", "target_rows", "rel_type", "via", "join_column")
    )


# ---------------------------------------------------------------------------------------------
# Whole runs over the test tables and one that cannot be read
# ---------------------------------------------------------------------------------------------


def _broken_registry(spark, sf_dir) -> Registry:
    sources = list(registry(spark, sf_dir).sources.values())
    missing = TableSource("missing", path=f"{sf_dir}/there_is_no_such_table.parquet")
    return Registry(spark, [*sources, missing], CONSTRAINTS)


def crawl_catalog(spark, sf_dir):
    """What a crawl leaves in the catalog, next to the row of its log."""
    with scratch_store(spark) as store:
        log = crawl(_broken_registry(spark, sf_dir), store, AS_OF).select(
            "status",
            "tables_crawled",
            "columns_crawled",
            F.substring_index("error_message", ":", 1).alias("failed"),
        )
        columns = store.read("catalog_columns").groupBy("table_name")
        columns = columns.agg(F.count(F.lit(1)).alias("columns"), F.sum("null_count").alias("nulls"))
        links = store.read("catalog_relationships").groupBy(F.col("source_table").alias("table_name"))
        links = links.agg(F.count(F.lit(1)).alias("relationships"))
        found = (
            store.read("catalog_tables")
            .join(columns, "table_name", "left")
            .join(links, "table_name", "left")
            .select(
                "table_name",
                "row_count",
                "column_count",
                "columns",
                "nulls",
                "primary_keys",
                "foreign_key_count",
                F.coalesce("relationships", F.lit(0)).cast("bigint").alias("relationships"),
                "quality_score",
                "quality_grade",
            )
        )
        run = log.first()
        return materialize(found.withColumns({c: F.lit(run[c]) for c in log.columns}), "crawled")


def describe_run(spark, sf_dir):
    """Descriptions and tags in the catalog after a run over all tables that were crawled."""
    reg = _broken_registry(spark, sf_dir)
    with scratch_store(spark) as store:
        crawled = crawl_sampled(reg, store, AS_OF)
        describing.describe_catalog(reg, store, _scratch_cache(spark), text_length_generator(), crawled)
        tables = store.read("catalog_tables").select(
            "table_name",
            F.lit("").alias("column_name"),
            F.col("ai_description").alias("description"),
            F.col("ai_tags").alias("tags"),
        )
        columns = store.read("catalog_columns").select(
            *KEYS, F.col("ai_description").alias("description"), F.lit(None).cast("string").alias("tags")
        )
        return materialize(tables.unionByName(columns), "described")


def full_refresh(spark, sf_dir):
    """The summary of a whole refresh, with the size of the graph it leaves."""
    with scratch_store(spark) as store:
        reg, cache = _broken_registry(spark, sf_dir), _scratch_cache(spark)
        summary = refreshing.refresh_catalog(reg, store, "tests", cache, text_length_generator(), AS_OF)
        graph = refreshing.stored_graph(store)
        found = side_by_side(
            summary.drop("duration_minutes"),
            graph.nodes.agg(F.count(F.lit(1)).alias("nodes")),
            graph.edges.agg(F.count(F.lit(1)).alias("edges")),
        )
        return materialize(found, "refreshed")


QUERIES = {
    f.__name__: f
    for f in (
        flagship_quality,
        gappy_quality,
        footer_quality,
        table_list,
        table_metadata,
        table_size,
        crawl_totals,
        crawl_log,
        crawl_runs,
        latest_crawl,
        crawl_durations,
        quality_rank,
        uniqueness,
        freshness,
        freshness_steps,
        completeness,
        validity_negative,
        validity_blank,
        validity_rating,
        validity_score,
        grade,
        column_nulls,
        column_minmax,
        column_distinct,
        column_topk,
        column_profile,
        gappy_profile,
        approx_distinct,
        incremental_profile,
        sample_values,
        type_normalize,
        type_params,
        parse_column,
        parse_fk,
        mark_keys,
        table_summary,
        catalog_upsert,
        catalog_replace,
        relationship_replace,
        describe_tables,
        describe_columns,
        tables_by_size,
        table_columns,
        lineage_tables,
        lineage_columns,
        lineage_relationships,
        coverage,
        described_sample,
        catalog_summary,
        prompt_table,
        prompt_column,
        prompt_tags,
        prompt_relationship,
        cache_key,
        cache_lookup,
        cache_misses,
        cache_save,
        cache_stats,
        generate_batch,
        generate_descriptions,
        generate_column_descriptions,
        graph_nodes,
        graph_edges,
        graph_keys,
        graph_node_counts,
        graph_edge_counts,
        relationship_map,
        related_tables,
        upstream,
        downstream,
        foreign_keys,
        hubs,
        lineage_path_all,
        lineage_path_fk,
        search,
        search_documents,
        database_lineage,
        cleared_graph,
        crawl_catalog,
        describe_run,
        full_refresh,
    )
}
