"""A crawl: profile the tables of a registry and merge the results into the catalog."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cartulary.functions.expressions import as_of_column
from cartulary.operators import catalog
from cartulary.operators.increments import FileStates
from cartulary.plans.profile import Profile, profile_tables, together
from cartulary.session import materialize
from cartulary.sources.registry import Registry
from cartulary.sources.store import CatalogStore

# Tables whose scans share one plan; more would make plans slow to optimize.
TABLES_TOGETHER = 64

OUTCOMES_SCHEMA = "table_name string, column_count int, error string"


@dataclass(frozen=True)
class Crawled:
    """The log row of a run and, for the tables named, the values it found that prompts may show."""

    log: DataFrame
    sampled: tuple[str, ...] = ()
    samples: DataFrame | None = None


def _message(error: Exception) -> str:
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def _run(registry: Registry, names, as_of, **options) -> Profile:
    found = profile_tables(registry, as_of, names, **options)
    return Profile(
        materialize(found.tables, "profile-tables"),
        materialize(found.columns, "profile-columns"),
        found.relationships,
        found.samples,
    )


def _run_halves(
    registry: Registry, names: list[str], as_of, errors: dict, **options
) -> list[Profile]:
    """Profiles the tables together, or, if that fails, each half by itself.

    One broken table among many costs a few more jobs over ever smaller halves, and everything
    but that table is still profiled in shared scans and shuffles.
    """
    try:
        return [_run(registry, names, as_of, **options)]
    except Exception as error:
        if len(names) == 1:
            errors[names[0]] = _message(error)
            return []
    middle = len(names) // 2
    first = _run_halves(registry, names[:middle], as_of, errors, **options)
    return first + _run_halves(registry, names[middle:], as_of, errors, **options)


def profile_all(registry: Registry, as_of=None, **options) -> tuple[list[Profile], list[tuple]]:
    """Profiles of all readable tables, and (table, columns, error) for every table.

    The options are those of ``profile_tables``.
    """
    counts, errors, readable = {}, {}, []
    registry.preload()
    for name in registry.names():
        try:
            counts[name] = len(registry.column_specs(name))
            if not counts[name]:
                raise ValueError("no columns to profile")
            readable.append(name)
        except Exception as error:
            errors[name] = _message(error)
    profiles = []
    for start in range(0, len(readable), TABLES_TOGETHER):
        batch = readable[start : start + TABLES_TOGETHER]
        profiles += _run_halves(registry, batch, as_of, errors, **options)
    outcomes = [
        (name, 0 if name in errors else counts[name], errors.get(name))
        for name in registry.names()
    ]
    return profiles, outcomes


def crawl(
    registry: Registry,
    store: CatalogStore,
    as_of=None,
    run_id: str | None = None,
    keep_ai=True,
    sketches: bool = False,
    states: FileStates | None = None,
) -> DataFrame:
    """Profiles every table, merges the results into the catalog and logs the run.

    ``sketches`` estimates distinct counts and most frequent values; ``states`` keeps the
    measures of files between crawls, so that only new and changed ones are read. Returns the log
    row of the run.
    """
    return crawl_sampled(registry, store, as_of, run_id, keep_ai, sketches, states).log


def crawl_sampled(
    registry: Registry,
    store: CatalogStore,
    as_of=None,
    run_id: str | None = None,
    keep_ai=True,
    sketches: bool = False,
    states: FileStates | None = None,
) -> Crawled:
    """A crawl that also returns samples of what it has read, so that prompts need no second read."""
    spark = registry.spark
    run_id = run_id or uuid.uuid4().hex
    store.setup()
    store.open_crawl(run_id, as_of_column(None))
    profiles, rows = profile_all(registry, as_of, sketches=sketches, states=states)
    stamp = as_of_column(as_of)
    outcomes = spark.createDataFrame(rows, OUTCOMES_SCHEMA)
    good = outcomes.where("error is null").select("table_name")
    sampled, samples = (), None
    if profiles:
        found = together(profiles)
        save(store, found, stamp, good, keep_ai)
        if found.samples is not None:
            sampled, samples = tuple(name for name, _, error in rows if error is None), found.samples
    log = store.close_crawl(run_id, outcomes, as_of_column(None))
    return Crawled(log, sampled, samples)


def save(store: CatalogStore, found: Profile, stamp, crawled: DataFrame, keep_ai=True) -> None:
    """Merges a profile into the catalog tables, of which it replaces those crawled."""
    store.upsert_tables(catalog.table_rows(found.tables, stamp))
    store.replace_columns(catalog.column_rows(found.columns, stamp), crawled, keep_ai)
    store.replace_relationships(catalog.relationship_rows(found.relationships, stamp), crawled)
