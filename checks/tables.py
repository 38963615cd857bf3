"""The test tables: their columns, keys and derived variants."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartulary import Constraints, ForeignKey, Registry, TableSource

AS_OF = "2024-02-01 00:00:00"

# Columns of the test tables with their labels, in table order.
COLUMNS = {
    "region": "r_regionkey:integer r_name:string",
    "nation": "n_nationkey:integer n_name:string n_regionkey:integer",
    "customer": "c_custkey:integer c_name:string c_nationkey:integer c_acctbal:float "
    "c_mktsegment:string",
    "supplier": "s_suppkey:integer s_name:string s_nationkey:integer s_acctbal:float",
    "part": "p_partkey:integer p_name:string p_brand:string p_type:string p_size:integer "
    "p_retailprice:float",
    "orders": "o_orderkey:integer o_custkey:integer o_orderstatus:string o_totalprice:float "
    "o_orderdate:timestamp o_orderpriority:string",
    "lineitem": "l_orderkey:integer l_partkey:integer l_suppkey:integer l_linenumber:integer "
    "l_quantity:float l_extendedprice:float l_discount:float l_tax:float l_returnflag:string "
    "l_linestatus:string l_shipdate:timestamp",
    "events": "event_id:integer ts:timestamp user_id:integer event_type:string value:float "
    "props:string",
    "documents": "doc_id:integer text:string lang:string source:string n_chars:integer",
    "embeddings": "vec_id:integer embedding:array label:integer",
    "pages": "page_id:integer url:string html:string",
    "benchmark": "item_id:integer text:string",
    "labels": "doc_id:integer quality:integer toxic:integer",
    "conversations": "conv_id:integer turn:integer role:string text:string",
}
TABLES = {
    name: [tuple(column.split(":")) for column in columns.split()]
    for name, columns in COLUMNS.items()
}
PRIMARY_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"),
}
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
)
CONSTRAINTS = Constraints(
    PRIMARY_KEYS, tuple(ForeignKey(t, (c,), r, (k,)) for t, c, r, k in FOREIGN_KEYS)
)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry.from_folder(spark, sf_dir, list(TABLES), CONSTRAINTS)


def footer_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """The same tables with their counts taken from file footers."""
    sources = [
        TableSource(name, path=f"{sf_dir}/{name}.parquet", footer_counts=True) for name in TABLES
    ]
    return Registry(spark, sources, CONSTRAINTS)


def gappy_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """Whole tables with nulls, blanks, ratings and negative amounts, which the data lacks.

    Each variant is a SELECT that Spark and the checking SQL share.
    """
    sources = []
    for name, (origin, select) in GAPPY.items():
        frame = table(spark, sf_dir, origin).selectExpr(*select)
        sources.append(TableSource(name, frame=frame))
    return Registry(spark, sources, Constraints(GAPPY_KEYS, (), GAPPY_REQUIRED))


GAPPY = {
    "gappy_orders": (
        "orders",
        (
            "o_orderkey",
            "nullif(o_orderpriority, '5-LOW') AS o_orderpriority",
            "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice",
            "CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS o_orderdate",
        ),
    ),
    "gappy_events": (
        "events",
        (
            "nullif(user_id, 7) AS user_id",
            "CASE WHEN event_type <> 'error' THEN value END AS value",
            "CASE WHEN event_type IN ('click', 'view') THEN event_type END AS event_type",
        ),
    ),
    "signed_customer": (
        "customer",
        ("c_custkey", "c_acctbal AS balance_total", "c_name", "c_mktsegment"),
    ),
    "signed_supplier": ("supplier", ("s_suppkey", "s_acctbal AS s_amount")),
    "blank_turns": (
        "conversations",
        (
            "conv_id",
            "turn",
            "CASE WHEN role = 'system' THEN '  ' ELSE role END AS role",
            "text",
        ),
    ),
    "rated_parts": (
        "part",
        ("p_partkey", "p_size AS size_rating", "p_retailprice - 925 AS price_gap"),
    ),
    "rated_lines": ("lineitem", ("l_orderkey", "l_linenumber AS line_rating", "l_quantity")),
}
GAPPY_KEYS = {
    "gappy_orders": ("o_orderkey",),
    "gappy_events": ("user_id",),
    "signed_customer": ("c_mktsegment", "c_name"),
    "blank_turns": ("conv_id",),
    "rated_lines": ("l_orderkey", "line_rating"),
}
GAPPY_REQUIRED = {"signed_customer": ("c_name",), "blank_turns": ("role", "text")}
GAPPY_COLUMNS = {
    "gappy_orders": (
        ("o_orderkey", "integer"),
        ("o_orderpriority", "string"),
        ("o_totalprice", "float"),
        ("o_orderdate", "timestamp"),
    ),
    "gappy_events": (("user_id", "integer"), ("value", "float"), ("event_type", "string")),
    "signed_customer": (
        ("c_custkey", "integer"),
        ("balance_total", "float"),
        ("c_name", "string"),
        ("c_mktsegment", "string"),
    ),
    "signed_supplier": (("s_suppkey", "integer"), ("s_amount", "float")),
    "blank_turns": (
        ("conv_id", "integer"),
        ("turn", "integer"),
        ("role", "string"),
        ("text", "string"),
    ),
    "rated_parts": (
        ("p_partkey", "integer"),
        ("size_rating", "integer"),
        ("price_gap", "float"),
    ),
    "rated_lines": (
        ("l_orderkey", "integer"),
        ("line_rating", "integer"),
        ("l_quantity", "float"),
    ),
}
