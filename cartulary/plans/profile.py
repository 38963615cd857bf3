"""Profiles of any set of tables: columns, statistics and quality in a few shared jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import vocabulary as V
from cartulary.functions.expressions import as_of_column
from cartulary.operators import quality, schema, stats
from cartulary.operators.increments import FileStates
from cartulary.session import materialize
from cartulary.sources.registry import Registry


@dataclass(frozen=True)
class Profile:
    """What a crawl knows about tables, columns and foreign keys.

    ``samples`` has the values that prompts may show, unless values were only estimated.
    """

    tables: DataFrame
    columns: DataFrame
    relationships: DataFrame
    samples: DataFrame | None = None


def table_plans(registry: Registry, names=None) -> list[stats.TablePlan]:
    plans, names = [], registry.names() if names is None else list(names)
    registry.preload(names)
    for name in names:
        columns = tuple(registry.column_specs(name))
        if not columns:
            raise ValueError(f"table {name} has no columns to profile")
        key = tuple(registry.primary_key(name))
        footers = registry.load_footers(name)
        plans.append(stats.TablePlan(name, registry.load(name), columns, key, footers))
    return plans


def quality_profile(registry: Registry, as_of=None, names=None) -> DataFrame:
    """Scores and grade per table: one scan for the counters and one for the keys."""
    plans = table_plans(registry, names)
    if not plans:
        none, unkeyed = _nothing(registry)
        return quality.score_tables(none, unkeyed, as_of_column(as_of))
    facts = stats.union_all([stats.table_facts(p, ranges=False) for p in plans])
    return quality.score_tables(facts, stats.repeated_keys(plans), as_of_column(as_of))


def _nothing(registry: Registry) -> tuple[DataFrame, DataFrame]:
    """Facts and repeated keys of no tables."""
    spark = registry.spark
    return spark.createDataFrame([], stats.FACTS), spark.createDataFrame([], stats.REPEATED)


def described_columns(registry: Registry, names=None) -> DataFrame:
    """Clean column descriptors with their keys marked."""
    names = registry.names() if names is None else list(names)
    return schema.mark_keys(
        schema.parse_columns(registry.raw_columns(names)),
        registry.primary_keys(names),
        schema.parse_foreign_keys(registry.raw_foreign_keys(names)),
    )


def column_profile(
    plans, facts: DataFrame, summary: DataFrame | None, described: DataFrame | None = None
) -> DataFrame:
    """All statistics per column, next to the descriptors where these are given.

    Every input has a row per column of the schemas. Without a summary of the values, distinct
    counts and most frequent values are those of the sketches in the facts.
    """
    keys = ["table_name", "column_name"]
    rows = stats.column_ranges(stats.column_nulls(facts))
    if summary is None:
        found = {"distinct_count": F.col("approx_distinct"), "values": F.col("approx_top")}
        rows = rows.withColumns(found)
    else:
        named = stats.name_columns(plans, summary).select(*keys, "distinct_count", "values")
        rows = rows.join(named, keys, "left")
    filled, is_text = F.col("row_count") > 0, F.col("clean_type").isin(*V.TEXT_LABELS)
    rows = rows.withColumns(
        {
            "distinct_count": F.when(filled, F.col("distinct_count")),
            "top_values": F.when(is_text, F.col("values")),
        }
    ).drop("values")
    if described is None:
        return rows
    extra = [c for c in described.columns if c not in ("ordinal", "clean_type")]
    return rows.join(described.select(extra), keys, "left")


def column_statistics(registry: Registry, names=None, sketches: bool = False) -> DataFrame:
    """The statistics of all columns, lazily.

    With ``sketches``, distinct counts and most frequent values are estimates from the pass that
    everything else comes from, and no values are shuffled.
    """
    plans = table_plans(registry, names)
    if not plans:
        return column_profile(plans, _nothing(registry)[0], None)
    facts = [stats.table_facts(p, approx_distinct=sketches, approx_top=sketches) for p in plans]
    facts, summary = stats.union_all(facts), None
    if not sketches:
        summary = stats.value_summary(plans, stats.value_frequencies(plans))
    return column_profile(plans, facts, summary)


def profile_tables(
    registry: Registry,
    as_of=None,
    names=None,
    sizes: bool = True,
    sketches: bool = False,
    states: FileStates | None = None,
) -> Profile:
    """Everything a crawl knows about the tables, of which there is at least one.

    Each table is scanned once for counts, ranges, freshness and rules. The values of all
    tables share one shuffle per kind of key, which serves distinct counts, most frequent
    values and one-column keys alike. Both passes run here, once; their results have a row per
    table or column and are written to the shared folder for all that is derived from them.

    With ``sketches``, distinct counts and most frequent values are estimated in the first pass.
    With ``states``, too, and of tables that lie in files only those are read that are new or
    have changed since their states were kept.
    """
    names = registry.names() if names is None else list(names)
    plans = table_plans(registry, names)
    manifest = registry.manifest(names) if sizes or states is not None else None
    estimated = sketches or states is not None
    facts = []
    for plan in plans:
        if states is not None and registry.has_files(plan.name):
            facts.append(states.facts(plan, manifest))
        else:
            facts.append(stats.table_facts(plan, approx_distinct=estimated, approx_top=estimated))
    facts, summary = materialize(stats.union_all(facts), "table-facts"), None
    if not estimated:
        frequencies = stats.value_frequencies(plans)
        summary = materialize(stats.value_summary(plans, frequencies), "value-summary")
    columns = column_profile(plans, facts, summary, described_columns(registry, names))
    if states is not None:
        repeated = states.repeated_keys(plans, manifest)
    else:
        repeated = stats.repeated_keys(plans, summary)
    tables = quality.score_tables(facts, repeated, as_of_column(as_of))
    foreign = schema.parse_foreign_keys(registry.raw_foreign_keys(names))
    tables = tables.join(F.broadcast(_key_summary(registry, names, foreign)), "table_name", "left")
    if sizes:
        found = registry.table_sizes(names, manifest)
        tables = tables.join(F.broadcast(found), "table_name", "left")
    samples = None if summary is None else stats.samples_of(plans, summary)
    return Profile(tables, columns, relationships(foreign), samples)


def together(profiles: list[Profile]) -> Profile:
    """Several profiles of different tables as one."""
    sampled = all(p.samples is not None for p in profiles)
    return Profile(
        stats.union_all([p.tables for p in profiles]),
        stats.union_all([p.columns for p in profiles]),
        stats.union_all([p.relationships for p in profiles]),
        stats.union_all([p.samples for p in profiles]) if sampled else None,
    )


def _key_summary(registry: Registry, names, foreign: DataFrame) -> DataFrame:
    """Primary-key columns and number of foreign keys; a row per table."""
    spark = registry.spark
    rows = [(n, ", ".join(registry.primary_key(n))) for n in names]
    keys = spark.createDataFrame(rows, "table_name string, primary_keys string")
    counts = foreign.groupBy("table_name").agg(F.count(F.lit(1)).alias("foreign_key_count"))
    return keys.join(counts, "table_name", "left").na.fill(0, ["foreign_key_count"])


def relationships(foreign: DataFrame) -> DataFrame:
    """Foreign keys as catalog relationships, without those that name no column or table."""
    return foreign.where("column is not null and column <> '' and references_table <> ''").select(
        F.col("table_name").alias("source_table"),
        F.col("column").alias("source_column"),
        F.col("references_table").alias("target_table"),
        F.col("references_column").alias("target_column"),
        F.lit("many_to_one").alias("relationship_type"),
    )
