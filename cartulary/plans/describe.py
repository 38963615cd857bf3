"""Descriptions and tags for a whole catalog, generated in batches through the cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.expressions import side_by_side
from cartulary.functions.vocabulary import DESCRIBED_SAMPLE
from cartulary.operators import catalog, prompts, stats
from cartulary.operators.generation import GeneratorFactory, answer_with, with_max_length
from cartulary.plans.crawl import Crawled
from cartulary.plans.profile import table_plans
from cartulary.session import materialize
from cartulary.sources.cache import ResponseCache
from cartulary.sources.registry import Registry
from cartulary.sources.store import CatalogStore


@dataclass(frozen=True)
class Descriptions:
    """What a run generated: rows to set on the catalog's tables and columns."""

    tables: DataFrame
    columns: DataFrame


def sample_values(registry: Registry, names=None) -> DataFrame:
    """(table_name, column_name, values) for the columns that may be shown in prompts."""
    return stats.sample_values(table_plans(registry, names))


def readable_samples(registry: Registry, names: list[str]) -> list[DataFrame]:
    """The samples of all tables that can be read, written aside; the others have none.

    Tables are sampled together or, if that fails, each half by itself, as in a crawl.
    """
    try:
        return [materialize(sample_values(registry, names), "samples")]
    except Exception:
        if len(names) == 1:
            return []
    middle = len(names) // 2
    first = readable_samples(registry, names[:middle])
    return first + readable_samples(registry, names[middle:])


def describe(
    tables: DataFrame,
    columns: DataFrame,
    samples: DataFrame,
    cache: ResponseCache,
    make_generator: GeneratorFactory,
) -> Descriptions:
    """Generates all texts in two batches: tables and columns, then tags.

    Tags come after descriptions because their prompts contain them. The results are written
    aside.
    """

    def ask(asked: DataFrame) -> DataFrame:
        return answer_with(asked, cache, make_generator)

    of_tables = with_max_length(prompts.table_prompts(tables, columns, samples), "table")
    of_columns = with_max_length(prompts.column_prompts(columns, samples), "column")
    both = of_tables.withColumn("is_table", F.lit(True)).unionByName(
        of_columns.withColumn("is_table", F.lit(False)), allowMissingColumns=True
    )
    found = ask(materialize(both, "asked")).select(
        "is_table", "table_name", "column_name", F.col("response").alias("description")
    )
    found = materialize(found, "descriptions")
    described = found.where("is_table").select("table_name", "description")
    tagged = with_max_length(prompts.tag_prompts(described, columns), "tags")
    tags = ask(tagged).select("table_name", F.col("response").alias("tags"))
    return Descriptions(
        materialize(described.join(tags, "table_name"), "table-descriptions"),
        found.where("not is_table").drop("is_table"),
    )


def describe_catalog(
    registry: Registry,
    store: CatalogStore,
    cache: ResponseCache,
    make_generator: GeneratorFactory,
    crawled: Crawled | None = None,
) -> DataFrame:
    """Describes everything in the catalog and returns how much that was.

    Samples are those of the crawl, where one is given; only tables that it has none of are read.
    A table that can no longer be read is described without samples.
    """
    tables, columns = store.read("catalog_tables"), store.read("catalog_columns")
    known = crawled.sampled if crawled else ()
    names = [name for name in registry.names() if name not in known]
    sampled = readable_samples(registry, names) if names else []
    if known:
        sampled.append(crawled.samples)
    none = registry.spark.createDataFrame([], stats.SAMPLES)
    samples = stats.union_all([none, *sampled])
    found = describe(tables, columns, samples, cache, make_generator)
    store.describe_tables(found.tables)
    store.describe_columns(found.columns)
    return description_summary(found, cache)


def description_summary(found: Descriptions, cache: ResponseCache) -> DataFrame:
    """Tables and columns described and responses cached, in one row."""
    return side_by_side(
        found.tables.agg(F.count(F.lit(1)).alias("tables_described")),
        found.columns.agg(F.count(F.lit(1)).alias("columns_described")),
        cache.stats().select("total_cached"),
    )


def described_sample(tables: DataFrame) -> DataFrame:
    return catalog.described_sample(tables, DESCRIBED_SAMPLE)
