"""A full refresh: crawl, describe, rebuild the lineage, sum up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from cartulary.functions.expressions import as_of_column
from cartulary.operators import catalog
from cartulary.operators.generation import GeneratorFactory
from cartulary.operators.lineage import Graph, build_graph
from cartulary.plans.crawl import crawl_sampled
from cartulary.plans.describe import describe_catalog
from cartulary.session import materialize
from cartulary.sources.cache import ResponseCache
from cartulary.sources.registry import Registry
from cartulary.sources.store import CatalogStore


def rebuild_lineage(store: CatalogStore, database: str, created_at: Column | None = None) -> Graph:
    """Makes the stored graph that of the current catalog; only parts that differ are written.

    The session's number of partitions goes by the tables that were crawled, the catalog has a row per
    column of them: a partition per core will do unless its own files ask for more.
    """
    graph = build_graph(
        store.read("catalog_tables"),
        store.read("catalog_columns"),
        store.read("catalog_relationships"),
        database,
        created_at,
        store.spark.sparkContext.defaultParallelism,
    )
    nodes = materialize(graph.nodes, "nodes")
    store.put_graph(Graph(nodes, materialize(graph.edges, "edges"), True))
    return store.graph()


def stored_graph(store: CatalogStore) -> Graph:
    return store.graph()


def summarize(store: CatalogStore, started_at: Column | None = None) -> DataFrame:
    return catalog.catalog_summary(
        store.read("catalog_tables"),
        store.read("catalog_columns"),
        store.read("crawl_logs"),
        started_at,
        as_of_column(None),
    )


def refresh_catalog(
    registry: Registry,
    store: CatalogStore,
    database: str,
    cache: ResponseCache | None = None,
    make_generator: GeneratorFactory | None = None,
    as_of=None,
) -> DataFrame:
    """All steps in order; descriptions are left as they are without a generator.

    A step that fails ends the run. Returns the summary row.
    """
    started = registry.spark.range(1).select(as_of_column(None).alias("at")).first()["at"]
    crawled = crawl_sampled(registry, store, as_of)
    if make_generator is not None:
        describe_catalog(registry, store, cache, make_generator, crawled)
    rebuild_lineage(store, database)
    return summarize(store, as_of_column(started))
