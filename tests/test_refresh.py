import re
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from cartulary import Constraints, ForeignKey, Registry, TableSource
from cartulary.plans import refresh as refreshing
from cartulary.plans import describe as describing
from cartulary.plans.crawl import crawl, crawl_sampled
from cartulary.plans.profile import column_statistics
from cartulary.sources.cache import ResponseCache
from cartulary.sources.store import CatalogStore
from cartulary.operators import lineage
from cartulary.operators import traversal as ask

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture
def store(spark, request):
    name = "c_" + request.node.name.replace("[", "_").replace("]", "")
    yield CatalogStore(spark, name)
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@pytest.fixture
def folder(spark, tmp_path):
    users = spark.createDataFrame(
        [(i, f"user {i % 3}") for i in range(10)], "user_id int, full_name string"
    )
    orders = spark.createDataFrame(
        [(i, i % 10, "open" if i % 4 else None) for i in range(40)],
        "order_id int, user_id int, status string",
    )
    users.write.parquet(str(tmp_path / "users.parquet"))
    orders.write.option("header", True).csv(str(tmp_path / "orders.csv"))
    return tmp_path


CONSTRAINTS = Constraints(
    {"users": ("user_id",), "orders": ("order_id",)},
    (ForeignKey("orders", ("user_id",), "users", ("user_id",)),),
    {"users": ("full_name",)},
)


def sources(folder, *more):
    orders = TableSource(
        "orders",
        path=str(folder / "orders.csv"),
        format="csv",
        options={"header": "true"},
        schema="order_id int, user_id int, status string",
    )
    return [TableSource("users", path=str(folder / "users.parquet")), orders, *more]


def template():
    def make():
        def respond(batch, lengths):
            return [f"{len(p)} in {n}" for p, n in zip(batch, lengths)]

        return respond

    return make


def test_whole_run(spark, rows, store, folder, tmp_path):
    reg = Registry(spark, sources(folder), CONSTRAINTS)
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    summary = refreshing.refresh_catalog(reg, store, "shop", cache, template(), AS_OF)
    found = summary.first().asDict()
    assert found.pop("duration_minutes") >= 0
    assert found == {
        "table_count": 2,
        "avg_quality": pytest.approx(94.64, abs=2),
        "described_count": 2,
        "column_count": 5,
        "status": "success",
        "tables_crawled": 2,
        "columns_crawled": 5,
    }
    tables = {r["table_name"]: r for r in store.read("catalog_tables").collect()}
    users = tables["users"]
    assert (users["row_count"], users["column_count"], users["primary_keys"]) == (10, 2, "user_id")
    size = sum(p.stat().st_size for p in (folder / "users.parquet").glob("*.parquet"))
    assert users["table_size_bytes"] == size
    assert tables["orders"]["foreign_key_count"] == 1
    assert users["ai_description"].endswith("in 100") and users["ai_tags"].endswith("in 50")
    columns = store.read("catalog_columns").where("column_name = 'status'").first()
    assert (columns["null_count"], columns["null_pct"]) == (10, 25.0)
    assert columns["ai_description"].endswith("in 80")
    graph = refreshing.stored_graph(store)
    assert rows(ask.upstream(graph, "orders"), "upstream_table") == [("users",)]
    # A second run keeps what was described and adds no tables.
    refreshing.refresh_catalog(reg, store, "shop", as_of=AS_OF)
    again = {r["table_name"]: r for r in store.read("catalog_tables").collect()}
    assert again["users"]["ai_description"] == users["ai_description"]
    assert store.read("catalog_columns").where("ai_description is not null").count() == 5
    assert store.read("crawl_logs").count() == 2
    assert refreshing.stored_graph(store).nodes.count() == 8
    store.clear_graph()
    assert refreshing.stored_graph(store).nodes.count() == 0


def test_one_broken_table_does_not_hide_the_others(spark, rows, store, folder):
    broken = spark.range(5).select(
        F.when(F.col("id") != 3, F.col("id"))
        .otherwise(F.raise_error(F.lit("bad block")))
        .alias("n")
    )
    more = [
        TableSource("broken", frame=broken),
        TableSource("missing", path=str(folder / "nowhere")),
        TableSource("crawl_logs", path=str(folder / "users.parquet")),
    ]
    reg = Registry(spark, sources(folder, *more), CONSTRAINTS)
    assert rows(reg.list_tables().orderBy("table_name")) == [
        ("broken",), ("missing",), ("orders",), ("users",),
    ]
    log = crawl(reg, store, AS_OF).first()
    assert (log["status"], log["tables_crawled"], log["columns_crawled"]) == ("partial", 2, 5)
    lines = log["error_message"].splitlines()
    assert len(lines) == 2
    assert lines[0].startswith("broken: ") and "bad block" in lines[0]
    assert lines[1].startswith("missing: ")
    assert store.read("catalog_tables").count() == 2


def test_vanished_tables_stay_and_changed_columns_go(spark, rows, store, folder):
    crawl(Registry(spark, sources(folder), CONSTRAINTS), store, AS_OF)
    users = spark.createDataFrame([(1, 2)], "user_id int, age int")
    crawl(Registry(spark, [TableSource("users", frame=users)], CONSTRAINTS), store, AS_OF)
    assert sorted(rows(store.read("catalog_tables"), "table_name", "row_count")) == [
        ("orders", 40), ("users", 1),
    ]
    columns = store.read("catalog_columns").where("table_name = 'users'")
    assert sorted(rows(columns, "column_name")) == [("age",), ("user_id",)]
    assert store.read("catalog_relationships").count() == 1


def test_tables_of_a_database(spark, rows, store):
    store.setup()
    name = store.database
    spark.sql(f"CREATE TABLE {name}.people (id INT, code VARCHAR(5), note STRING) USING parquet")
    spark.sql(f"INSERT INTO {name}.people VALUES (1, 'a', NULL), (2, 'b', 'x')")
    reg = Registry.from_database(spark, name)
    assert reg.names()[-1] == "people"
    specs = reg.column_specs("people")
    assert [(c.raw_type, c.label) for c in specs][0] == ("int", "integer")
    assert reg.table_sizes(["people"]).first()["table_size_bytes"] > 0


def test_staged_tables_are_read_once(spark, rows, folder):
    reads = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    counted = spark.range(20).repartition(2).mapInPandas(note, "id long")
    reg = Registry(spark, [TableSource("t", frame=counted, staged=True)], CONSTRAINTS)
    found = column_statistics(reg).first()
    assert (found["row_count"], found["distinct_count"]) == (20, 20)
    assert reads.value == 20


def test_sizes_of_tables_without_files(spark, rows):
    reg = Registry(spark, [TableSource("t", frame=spark.range(3))])
    assert rows(reg.table_sizes()) == [("t", 0)]


def test_edge_counts_survive_the_store(spark, rows, store, folder):
    crawl(Registry(spark, sources(folder), CONSTRAINTS), store, AS_OF)
    graph = refreshing.rebuild_lineage(store, "shop")
    assert rows(lineage.edge_counts(graph.edges)) == [
        ("HAS_COLUMN", 5), ("CONTAINS", 2), ("REFERENCES", 1), ("RELATED_TO", 1),
    ]


def test_a_broken_table_does_not_stop_the_descriptions(spark, rows, store, folder, tmp_path):
    missing = TableSource("missing", path=str(folder / "nowhere"))
    reg = Registry(spark, sources(folder, missing), CONSTRAINTS)
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    summary = refreshing.refresh_catalog(reg, store, "shop", cache, template(), AS_OF).first()
    assert (summary["status"], summary["described_count"]) == ("partial", 2)
    assert refreshing.stored_graph(store).nodes.where("label = 'Column'").count() == 5


def test_descriptions_after_a_crawl_read_no_table_again(spark, rows, store, folder, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    pairs = spark.createDataFrame([(i % 4, f"v{i % 5}") for i in range(20)] + [(None, None)], "n int, v string")
    more = [
        TableSource("noted", frame=pairs.mapInPandas(note, pairs.schema)),
        TableSource("bare", frame=pairs.where("n > 9")),
        TableSource("missing", path=str(folder / "nowhere")),
    ]
    reg = Registry(spark, sources(folder, *more), CONSTRAINTS)
    crawled = crawl_sampled(reg, store, AS_OF)
    assert crawled.log.first()["status"] == "partial"
    assert sorted(crawled.sampled) == ["bare", "noted", "orders", "users"]
    before, cache = reads.value, ResponseCache(spark, str(tmp_path / "cache"))
    describing.describe_catalog(reg, store, cache, template(), crawled)
    assert reads.value == before > 0
    own = describing.sample_values(reg, crawled.sampled)
    assert sorted(rows(crawled.samples)) == sorted(rows(own))
    assert ("noted", "v", ["v0", "v1", "v2"]) in rows(own)
    # Without the crawl the prompts are the same, so the cache has all answers.
    answers = cache.load().count()
    describing.describe_catalog(reg, store, cache, template())
    assert cache.load().count() == answers


def test_a_small_catalog_takes_few_partitions(spark, rows, store, folder, monkeypatch):
    crawl(Registry(spark, sources(folder), CONSTRAINTS), store, AS_OF)
    plans, kept = [], refreshing.materialize

    def note(frame, *rest):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return kept(frame, *rest)

    monkeypatch.setattr(refreshing, "materialize", note)
    session_number = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        graph = refreshing.rebuild_lineage(store, "shop")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", session_number)
    asked = set(re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", "".join(plans)))
    assert asked == {str(cores)} and cores < 77
    assert (graph.nodes.count(), graph.edges.count()) == (8, 9)


def test_estimated_values_are_no_samples(spark, rows, store, folder):
    crawled = crawl_sampled(Registry(spark, sources(folder), CONSTRAINTS), store, AS_OF, sketches=True)
    assert (crawled.sampled, crawled.samples) == ((), None)


def test_size_of_a_table_with_a_space_in_a_partition(spark, rows, store):
    store.setup()
    rows_by_text = spark.sql("select id, if(id < 5, 'a b', 'c%') as p from range(10)")
    rows_by_text.write.partitionBy("p").saveAsTable(f"{store.database}.spaced")
    reg = Registry(spark, [TableSource("spaced", table=f"{store.database}.spaced")])
    size = reg.table_sizes().first()["table_size_bytes"]
    described = spark.sql(f"describe formatted {store.database}.spaced").collect()
    folder = next(r["data_type"] for r in described if r["col_name"] == "Location")
    files = Path(unquote(urlparse(folder).path)).rglob("*.parquet")
    assert size == sum(f.stat().st_size for f in files) > 0
