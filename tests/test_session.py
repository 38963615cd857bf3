import os

import pytest

from cartulary import session
from cartulary.sources import jdbc


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    class conf:
        @staticmethod
        def get(name, default):
            return default

    sparkContext = FakeContext()


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        session.scratch_root(FakeSession())


def test_written_tables_can_be_dropped(spark, rows, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    found = session.materialize(spark.range(3), "three")
    assert sorted(rows(found)) == [(0,), (1,), (2,)]
    path = session._written[0]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(path)
    assert session.drop_written(spark) == 1
    assert not os.path.exists(path)


def test_only_small_tables_are_marked_for_broadcast(spark):
    def plan(limit):
        small = session.written_small(spark.range(10), "ten", limit)
        joined = spark.range(100).join(small.hint("merge") if limit < 10 else small, "id")
        return joined._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(10)
    assert "SortMergeJoin" in plan(9)


def test_options_of_a_table_read_in_ranges():
    source = jdbc.table_source(
        "orders",
        {"url": "jdbc:postgresql://host/db", "user": "u"},
        split={"column": "order_id", "lower": 1, "upper": 1000, "partitions": 8},
        declared={"status": ("character varying(30)", None)},
    )
    assert source.format == "jdbc" and source.path is None
    assert source.options == {
        "url": "jdbc:postgresql://host/db",
        "user": "u",
        "dbtable": '"public"."orders"',
        "partitionColumn": "order_id",
        "lowerBound": "1",
        "upperBound": "1000",
        "numPartitions": "8",
    }
    assert source.declared["status"][0] == "character varying(30)"


def key(number, kind, table, column, place, target=None, target_column=None):
    return {
        "constraint_id": number,
        "constraint_type": kind,
        "table_name": table,
        "column_name": column,
        "ordinal_position": place,
        "referred_table": target,
        "referred_column": target_column,
    }


def column(table, name, kind, length=None, digits=None, decimals=None, nullable="YES"):
    return {
        "table_name": table,
        "column_name": name,
        "data_type": kind,
        "text_length": length,
        "digits": digits,
        "decimals": decimals,
        "is_nullable": nullable,
    }


def test_declared_keys():
    """The constraints of lines and notes may have the same name; their numbers differ."""
    keys = [
        key(5, "FOREIGN KEY", "lines", "part", 2, "parts", "part"),
        key(5, "FOREIGN KEY", "lines", "supplier", 1, "parts", "supplier"),
        key(2, "PRIMARY KEY", "parts", "supplier", 2),
        key(2, "PRIMARY KEY", "parts", "part", 1),
        key(1, "PRIMARY KEY", "lines", "id", 1),
        key(9, "FOREIGN KEY", "notes", "line", 1, "lines", "id"),
    ]
    columns = [column("lines", "id", "integer", nullable="NO"), column("lines", "part", "integer")]
    found = jdbc.constraints_from(keys, columns)
    assert found.primary_keys == {"parts": ("part", "supplier"), "lines": ("id",)}
    assert found.not_null == {"lines": ("id",)}
    assert [(f.table, f.columns, f.references, f.referred_columns) for f in found.foreign_keys] == [
        ("lines", ("supplier", "part"), "parts", ("supplier", "part")),
        ("notes", ("line",), "lines", ("id",)),
    ]


def test_declared_types():
    text = jdbc.declared_type(column("t", "c", "character varying", 150))
    assert text == "character varying(150)"
    assert jdbc.declared_type(column("t", "c", "numeric", None, 10, 2)) == "numeric(10,2)"
    assert jdbc.declared_type(column("t", "c", "integer")) == "integer"


@pytest.mark.parametrize(
    "starts, expected",
    [
        ([1, 500, 1000], ['"k" < 500 OR "k" IS NULL', '"k" >= 500 AND "k" < 1000', '"k" >= 1000']),
        ([-9, -5, 0], ['"k" < -5 OR "k" IS NULL', '"k" >= -5 AND "k" < 0', '"k" >= 0']),
        ([1, 7, 7, 7, 9], ['"k" < 7 OR "k" IS NULL', '"k" >= 7 AND "k" < 9', '"k" >= 9']),
        ([3, 3, 3], []),
        ([3], []),
        ([], []),
        (["a", "it's", "z"], ['"k" < \'it\'\'s\' OR "k" IS NULL', '"k" >= \'it\'\'s\' AND "k" < \'z\'', '"k" >= \'z\'']),
    ],
)
def test_ranges_of_keys(starts, expected):
    assert jdbc.range_predicates("k", starts) == expected


@pytest.mark.parametrize("kind", ["even", "skewed", "text"])
def test_ranges_hold_equally_many_rows_and_every_row_once(kind):
    duckdb = pytest.importorskip("duckdb")
    key = {
        "even": "i - 5000",
        "skewed": "CASE WHEN i % 3 = 0 THEN 7 ELSE CAST(pow(1.001, i) AS BIGINT) END",
        "text": "CASE WHEN i % 10 = 0 THEN NULL ELSE 'it''s ' || (i * 7919 % 10000) END",
    }[kind]
    connection = duckdb.connect()
    connection.execute(f'CREATE TABLE "t" AS SELECT {key} AS "a""k" FROM range(10000) r(i)')
    table = jdbc.name_in_sql("t")
    found = connection.execute(jdbc.starts_query(table, 'a"k', 1000)).fetchall()
    ranges = jdbc.range_predicates('a"k', [r[0] for r in found])
    counts = [connection.execute(f"SELECT count(*) FROM {table} WHERE {p}").fetchone()[0] for p in ranges]
    connection.close()
    assert sum(counts) == 10_000 and len(counts) >= 6
    hot = 3334 if kind == "skewed" else 0
    assert max(counts) <= 2000 + hot


def test_sampled_starts_and_names_with_quotes():
    query = jdbc.starts_query(jdbc.name_in_sql("pu\"blic", "t"), "id", 1_000_000, 0.5)
    assert "/ 5000.0)" in query and 'FROM "pu""blic"."t" TABLESAMPLE SYSTEM (0.5)' in query
    assert jdbc.text_in_sql("o'hara") == "'o''hara'"


def test_a_table_is_read_by_its_ranges(monkeypatch):
    calls = []

    class Reader:
        def jdbc(self, url, name, **options):
            calls.append((url, name, options))
            return "rows"

    class Session:
        read = Reader()

    monkeypatch.setattr(jdbc, "balanced_ranges", lambda spark, options, table, key: ["a", "b"])
    source = jdbc.table_source("orders", {"url": "jdbc:x", "user": "u"}, key="id")
    assert source.load(Session()) == "rows" and source.staged
    assert calls == [("jdbc:x", '"public"."orders"', {"predicates": ["a", "b"], "properties": {"user": "u"}})]
