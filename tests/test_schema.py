import pytest
from pyspark.sql import types as T

from cartulary.functions.types import label_of
from cartulary.operators import schema
from cartulary.sources.registry import PRIMARY_KEYS, RAW_COLUMNS, RAW_FOREIGN_KEYS

TYPES = [
    # raw, cleaned, label, length, precision, scale
    ("character varying(150)", "character varying(150)", "string", 150, None, None),
    ("integer", "integer", "integer", None, None, None),
    ("numeric(10,2)", "numeric(10,2)", "decimal", None, 10, 2),
    ("timestamp without time zone", "timestamp without time zone", "timestamp", None, None, None),
    ("timestamp(6) with time zone", "timestamp(6) with time zone", "timestamp", 6, None, None),
    ("boolean", "boolean", "boolean", None, None, None),
    ("text", "text", "text", None, None, None),
    ("bigint", "bigint", "integer", None, None, None),
    ("integer[]", "integer[]", "unknown", None, None, None),
    ("numeric(10)", "numeric(10)", "decimal", 10, None, None),
    ("interval", "interval", "unknown", None, None, None),
    ("\t VARCHAR(5) \n", "varchar(5)", "string", 5, None, None),
    ("double precision", "double precision", "float", None, None, None),
    ("time with time zone", "time with time zone", "time", None, None, None),
    ("jsonb", "jsonb", "json", None, None, None),
    ("uuid", "uuid", "uuid", None, None, None),
    ("bytea", "bytea", "binary", None, None, None),
    ("array", "array", "array", None, None, None),
    ("numeric(x)", "numeric(x)", "decimal", None, None, None),
    ("numeric(a, 2)", "numeric(a, 2)", "decimal", None, None, 2),
    ("varchar(5", "varchar(5", "string", None, None, None),
    ("array<decimal(10,2)>", "array<decimal(10,2)>", "array", None, None, None),
    ("map<string,int>", "map<string,int>", "unknown", None, None, None),
    ("", "", "unknown", None, None, None),
    (None, "", "unknown", None, None, None),
]


def test_types(spark, rows):
    raw = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TYPES)], "i int, type string")
    found = rows(
        schema.parse_types(raw).orderBy("i"),
        "raw_type", "clean_type", "max_length", "precision", "scale",
    )
    assert found == [t[1:] for t in TYPES]


@pytest.mark.parametrize(
    "dtype, label",
    [
        (T.ByteType(), "integer"),
        (T.LongType(), "integer"),
        (T.DecimalType(10, 2), "decimal"),
        (T.FloatType(), "float"),
        (T.DoubleType(), "float"),
        (T.StringType(), "string"),
        (T.VarcharType(5), "string"),
        (T.BooleanType(), "boolean"),
        (T.TimestampType(), "timestamp"),
        (T.TimestampNTZType(), "timestamp"),
        (T.DateType(), "date"),
        (T.BinaryType(), "binary"),
        (T.ArrayType(T.DecimalType(10, 2)), "array"),
        (T.MapType(T.StringType(), T.IntegerType()), "unknown"),
        (T.StructType([T.StructField("a", T.IntegerType())]), "unknown"),
    ],
)
def test_known_types_get_the_label_of_their_name(dtype, label):
    assert label_of(dtype) == label


def test_columns(spark, rows):
    raw = spark.createDataFrame(
        [
            ("t", 1, "a", "integer", None, None),
            ("t", 2, "b", "varchar(5)", False, ""),
            ("t", 3, "c", "text", True, "now()"),
        ],
        RAW_COLUMNS,
    )
    found = rows(
        schema.parse_columns(raw).orderBy("ordinal"),
        "column_name", "max_length", "is_nullable", "has_default", "default_value",
        "is_primary_key", "is_foreign_key", "references_table",
    )
    assert found == [
        ("a", None, True, False, None, False, False, None),
        ("b", 5, False, True, None, False, False, None),
        ("c", None, True, True, "now()", False, False, None),
    ]


def test_foreign_keys_count_their_first_pair(spark, rows):
    raw = spark.createDataFrame(
        [
            ("t", 1, ["a", "b"], "u", ["x", "y"]),
            ("t", 2, [], None, []),
            ("t", 3, None, "u", None),
        ],
        RAW_FOREIGN_KEYS,
    )
    found = rows(schema.parse_foreign_keys(raw).orderBy("fk_ordinal"))
    assert found == [("t", 1, "a", "u", "x"), ("t", 2, None, "", None), ("t", 3, None, "u", None)]


def test_keys_are_marked_and_the_last_foreign_key_counts(spark, rows):
    raw = spark.createDataFrame(
        [("t", i, n, "integer", i > 1, None) for i, n in enumerate("abc", 1)], RAW_COLUMNS
    )
    keys = spark.createDataFrame([("t", "a", 1), ("other", "b", 1)], PRIMARY_KEYS)
    foreign = schema.parse_foreign_keys(
        spark.createDataFrame(
            [("t", 1, ["b"], "u", ["x"]), ("t", 2, ["b"], "v", ["y"]), ("z", 3, ["c"], "w", ["q"])],
            RAW_FOREIGN_KEYS,
        )
    )
    marked = schema.mark_keys(schema.parse_columns(raw), keys, foreign)
    found = rows(
        marked.orderBy("ordinal"),
        "column_name", "is_primary_key", "is_foreign_key", "references_table", "references_column",
    )
    assert found == [
        ("a", True, False, None, None),
        ("b", False, True, "v", "y"),
        ("c", False, False, None, None),
    ]
    assert rows(schema.summarize_tables(marked)) == [("t", 3, ["a"], ["b", "c"], ["a"])]
