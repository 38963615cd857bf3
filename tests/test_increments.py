"""Crawls that read new and changed files only, and sketches that can be united."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartulary import Constraints, Registry, TableSource
from cartulary.operators import stats
from cartulary.operators.increments import FileStates
from cartulary.plans import profile as profiling
from cartulary.plans.crawl import crawl
from cartulary.sources.store import CatalogStore

AS_OF = "2024-02-01 00:00:00"
ESTIMATED = ["distinct_count", "top_values", "approx_distinct", "approx_top"]


def rows_of(spark, start, stop):
    return spark.range(start, stop).select(
        "id",
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("n"), F.col("id") % 7)).alias("name"),
        (F.col("id") - 10).cast("decimal(12,3)").alias("unit_price"),
        (F.col("id") % 9).cast("int").alias("rating"),
        (F.col("id") / 8).alias("share"),
        F.timestamp_seconds(1_706_000_000 + F.col("id")).alias("at"),
        F.array("id").alias("list"),
    )


def add_file(spark, folder, name, frame, tmp_path):
    """One Parquet file of the given name."""
    aside = tmp_path / f"aside-{name}"
    frame.coalesce(1).write.parquet(str(aside))
    folder.mkdir(exist_ok=True)
    next(aside.glob("part-*.parquet")).rename(folder / f"{name}.parquet")


def registry(spark, folder):
    keys = Constraints({"t": ("id",)}, (), {"t": ("name",)})
    return Registry(spark, [TableSource("t", path=str(folder))], keys)


def profiles(reg, states):
    """The same figures from states and from a full profile."""
    kept = profiling.profile_tables(reg, AS_OF, states=states)
    full = profiling.profile_tables(reg, AS_OF)
    tables = [sorted(map(str, p.tables.drop("columns").collect())) for p in (kept, full)]
    columns = [sorted(map(str, p.columns.drop(*ESTIMATED).collect())) for p in (kept, full)]
    exact = {r["column_name"]: r for r in full.columns.collect()}
    for r in kept.columns.collect():
        assert abs(r["distinct_count"] - exact[r["column_name"]]["distinct_count"]) <= 0.05 * r["distinct_count"] + 1
        assert r["top_values"] == exact[r["column_name"]]["top_values"]
    return tables, columns


def spoil(path):
    """Makes a file unreadable without a change of its size or time."""
    was = os.stat(path)
    path.write_bytes(b"x" * was.st_size)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    crc = path.with_name(f".{path.name}.crc")
    if crc.exists():
        crc.unlink()


def test_a_second_crawl_reads_the_new_file_only(spark, tmp_path):
    folder = tmp_path / "t"
    add_file(spark, folder, "a", rows_of(spark, 0, 500), tmp_path)
    add_file(spark, folder, "b", rows_of(spark, 400, 900), tmp_path)
    states = FileStates(spark, str(tmp_path / "states"))
    for found in profiles(registry(spark, folder), states):
        assert found[0] == found[1]
    add_file(spark, folder, "c", rows_of(spark, 900, 1000), tmp_path)
    reg = registry(spark, folder)
    for found in profiles(reg, states):
        assert found[0] == found[1]
    # The old files cannot be read any more, and need not be.
    expected = profiling.profile_tables(reg, AS_OF, states=states).columns.drop(*ESTIMATED).collect()
    for name in ("a", "b", "c"):
        spoil(folder / f"{name}.parquet")
    reg = Registry(spark, [TableSource("t", path=str(folder), schema=reg.load("t").schema)])
    add_file(spark, folder, "d", rows_of(spark, 0, 0), tmp_path)
    plan = profiling.table_plans(Registry(spark, [TableSource("t", path=str(folder), schema=reg.load("t").schema)], Constraints({"t": ("id",)}, (), {"t": ("name",)})))[0]
    again = stats.column_nulls(states.facts(plan, reg.manifest()))
    assert {(r["column_name"], r["null_count"], r["row_count"]) for r in again.collect()} == {
        (r["column_name"], r["null_count"], r["row_count"]) for r in expected
    }
    with pytest.raises(Exception):
        profiling.column_statistics(reg).collect()


def test_changed_and_vanished_files(spark, tmp_path):
    folder = tmp_path / "t"
    for k, name in enumerate("abc"):
        add_file(spark, folder, name, rows_of(spark, 100 * k, 100 * k + 150), tmp_path)
    states = FileStates(spark, str(tmp_path / "states"))
    profiles(registry(spark, folder), states)
    (folder / "a.parquet").unlink()
    (folder / "b.parquet").unlink()
    add_file(spark, folder, "b", rows_of(spark, 5000, 5060), tmp_path / "..")
    for found in profiles(registry(spark, folder), states):
        assert found[0] == found[1]


def test_another_schema_starts_anew_and_an_empty_table_has_facts(spark, tmp_path):
    folder = tmp_path / "t"
    add_file(spark, folder, "a", rows_of(spark, 0, 50), tmp_path)
    states = FileStates(spark, str(tmp_path / "states"))
    profiles(registry(spark, folder), states)
    (folder / "a.parquet").unlink()
    add_file(spark, folder, "b", rows_of(spark, 0, 0).withColumn("more", F.lit(1)), tmp_path)
    kept = profiling.profile_tables(registry(spark, folder), AS_OF, states=states)
    full = profiling.profile_tables(registry(spark, folder), AS_OF)
    assert str(kept.tables.drop("columns").collect()) == str(full.tables.drop("columns").collect())
    assert {r["null_count"] for r in kept.columns.collect()} == {0}


def test_crawls_with_states_and_tables_without_files(spark, rows, tmp_path):
    folder = tmp_path / "t"
    add_file(spark, folder, "a", rows_of(spark, 0, 60), tmp_path)
    states = FileStates(spark, str(tmp_path / "states"))
    store = CatalogStore(spark, "incremental_crawl")
    try:
        for count in (60, 90):
            sources = [
                TableSource("t", path=str(folder)),
                TableSource("u", frame=spark.range(count)),
            ]
            reg = Registry(spark, sources, Constraints({"t": ("id",), "u": ("id",)}))
            assert crawl(reg, store, AS_OF, states=states).first()["status"] == "success"
            found = sorted(rows(store.read("catalog_tables"), "table_name", "row_count", "uniqueness"))
            assert found == [("t", count, 100.0), ("u", count, 100.0)]
            add_file(spark, folder, f"b{count}", rows_of(spark, count, 90), tmp_path)
        assert store.read("catalog_tables").where("table_size_bytes > 0").count() == 1
    finally:
        store.drop()


def test_sketches_of_a_profile(spark, rows):
    frame = spark.range(20_000).select(
        (F.col("id") % 5000).alias("many"),
        F.concat(F.lit("v"), F.least(F.col("id") % 100, F.lit(40))).alias("text"),
        F.when(F.col("id") < 0, "x").alias("none"),
        F.repeat(F.lit("long "), (F.col("id") % 3 * 100).cast("int")).alias("long"),
    )
    reg = Registry(spark, [TableSource("t", frame=frame)])
    found = {r["column_name"]: r for r in profiling.column_statistics(reg, sketches=True).collect()}
    assert abs(found["many"]["distinct_count"] - 5000) < 250
    assert found["text"]["distinct_count"] == 41 and found["none"]["distinct_count"] == 0
    assert found["text"]["top_values"] == ["v40", "v0", "v1"]
    assert found["none"]["top_values"] in (None, [])
    assert found["long"]["distinct_count"] == 3 and len(found["long"]["top_values"]) == 2
    plan = profiling.column_statistics(reg, sketches=True)._jdf.queryExecution().executedPlan().toString()
    assert "unpivot" not in plan and "Expand" not in plan


def test_sizes_and_files_of_a_manifest(spark, rows, tmp_path):
    folder = tmp_path / "t"
    for name in ("a", "b"):
        add_file(spark, folder, name, rows_of(spark, 0, 50), tmp_path)
    reg = Registry(spark, [TableSource("t", path=str(folder)), TableSource("u", frame=spark.range(2))])
    found = reg.manifest()
    assert sorted(Path(r["file"]).name for r in found.collect()) == ["a.parquet", "b.parquet"]
    total = sum(f.stat().st_size for f in folder.glob("*.parquet"))
    assert sorted(rows(reg.table_sizes())) == [("t", total), ("u", 0)]
    assert rows(reg.table_sizes([])) == []


def test_a_registry_without_tables(spark, rows):
    reg = Registry(spark, [])
    assert profiling.quality_profile(reg, AS_OF).collect() == []
    assert profiling.column_statistics(reg).collect() == []
    assert reg.table_sizes().collect() == [] and reg.names() == []
    store = CatalogStore(spark, "empty_crawl")
    try:
        log = crawl(reg, store, AS_OF)
        assert rows(log, "status", "tables_crawled") == [("success", 0)]
        assert store.read("catalog_tables").count() == 0
    finally:
        store.drop()
