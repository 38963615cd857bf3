from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions import expressions as E


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=50, max_size=200))
def test_doubles_read_like_plain_numbers(spark, numbers):
    numbers = [n for n in numbers if n != 0 and abs(n) > 1e-300]
    frame = spark.createDataFrame([(n,) for n in numbers], "n double")
    found = frame.select("n", E.double_text(F.col("n")).alias("t")).collect()
    for row in found:
        assert float(row.t) == row.n
        size = abs(row.n)
        assert ("e" in row.t) == (size < 1e-4 or size >= 1e16)


def test_text_forms(spark):
    cases = [0.0, 1.0, -2.5, 1e10, 1e15, 1e16, 1.5e-5, 0.0001, 123456789.125, 1e100, 1.25e-7]
    frame = spark.createDataFrame([(n,) for n in cases], "n double")
    found = [r[0] for r in frame.select(E.double_text(F.col("n"))).collect()]
    assert found == [repr(n) for n in cases]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "n double")
    assert [r[0] for r in odd.select(E.double_text(F.col("n"))).collect()] == ["nan", "inf", "-inf"]
    flag = spark.createDataFrame([(True,), (False,)], "b boolean")
    found = flag.select(E.value_text(F.col("b"), T.BooleanType())).collect()
    assert [r[0] for r in found] == ["True", "False"]


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(1, 10**9), st.integers(1, 10**9)).map(lambda p: tuple(sorted(p))),
        min_size=20,
        max_size=100,
    )
)
def test_percent_rounds_true_ties_up(spark, pairs):
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = frame.select(E.percent(F.col("a"), F.col("b"))).collect()
    for (part, whole), row in zip(pairs, found):
        exact = (Decimal(part) * 100 / Decimal(whole)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert row[0] == float(exact)


def test_days_are_rounded_down(spark):
    cases = [
        ("2024-01-30 23:57:12.194062", "2024-02-01 00:00:00", 1),
        ("2024-01-31 00:00:00", "2024-02-01 00:00:00", 1),
        ("2024-01-31 00:00:00.000001", "2024-02-01 00:00:00", 0),
        ("2024-02-01 00:00:01", "2024-02-01 00:00:00", -1),
        ("2024-02-02 00:00:00", "2024-02-01 00:00:00", -1),
        ("2024-02-02 00:00:01", "2024-02-01 00:00:00", -2),
    ]
    frame = spark.createDataFrame(cases, "a string, b string, d int")
    days = E.elapsed_days(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"))
    assert [r[0] for r in frame.select(days).collect()] == [c[2] for c in cases]


def test_zoned_times_count_in_utc(spark):
    stamp = datetime(2024, 1, 31, 23, 30, tzinfo=timezone.utc)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        frame = spark.range(1).select(F.lit("2024-02-01 05:00:00").cast("timestamp").alias("t"))
        found = frame.select(
            E.utc_naive(F.col("t"), T.TimestampType()).cast("string"),
            E.as_of_column(stamp).cast("string"),
        ).first()
        assert tuple(found) == ("2024-01-31 23:30:00", "2024-01-31 23:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_defaults(spark):
    frame = spark.createDataFrame(
        [(None, None, None), ("", 0, False), ("x", 3, True)], "s string, n long, b boolean"
    )
    found = frame.select(
        E.or_default(F.col("s"), "none"),
        E.or_default(F.col("n"), 0),
        E.or_default(F.col("b"), True),
        E.present(F.col("s"), F.lit("y")),
    ).collect()
    assert [tuple(r) for r in found] == [
        ("none", 0, True, False),
        ("none", 0, False, False),
        ("x", 3, True, True),
    ]


def test_fill_reads_null_as_none(spark):
    frame = spark.createDataFrame([("a", None)], "x string, y string")
    text = E.fill("{x} and {y}\n'{z}'", x=F.col("x"), y=F.col("y"))
    assert frame.select(text).first()[0] == "a and None\n'{z}'"
