import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartulary import Constraints, Registry, TableSource
from cartulary.operators import stats
from cartulary.plans import profile as profiling


def registry(spark, constraints=None, **frames):
    sources = [TableSource(n, frame=f) for n, f in frames.items()]
    return Registry(spark, sources, constraints)


def by_column(df, *columns):
    return {r["column_name"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_counts_and_ranges(spark):
    frame = spark.createDataFrame(
        [(1, 2.5, "b", True), (None, -0.0, "b", None), (3, None, None, False), (3, 0.0, "", True)],
        "n int, x double, s string, b boolean",
    )
    found = by_column(
        profiling.column_statistics(registry(spark, t=frame)),
        "null_count", "null_pct", "filled_pct", "distinct_count",
        "min_value", "max_value", "avg_value", "top_values",
    )
    assert found == {
        "n": (1, 25.0, 75.0, 2, "1", "3", "2.33", None),
        "x": (1, 25.0, 75.0, 2, "0.0", "2.5", "0.83", None),
        "s": (1, 25.0, 75.0, 2, None, None, None, ["b", ""]),
        "b": (1, 25.0, 75.0, 2, None, None, None, None),
    }


def test_empty_table_has_null_counts_only(spark):
    frame = spark.createDataFrame([], "n int, s string")
    found = by_column(
        profiling.column_statistics(registry(spark, t=frame)),
        "null_count", "null_pct", "filled_pct", "distinct_count", "min_value", "top_values",
    )
    assert found == {"n": (0, 0.0, None, None, None, None), "s": (0, 0.0, None, None, None, None)}


def test_all_null_columns(spark):
    frame = spark.createDataFrame([(None, None)] * 3, "n int, s string")
    found = by_column(
        profiling.column_statistics(registry(spark, t=frame)),
        "null_count", "null_pct", "filled_pct", "distinct_count", "min_value", "top_values",
    )
    assert found == {"n": (3, 100.0, 0.0, 0, None, None), "s": (3, 100.0, 0.0, 0, None, None)}


def test_names_with_odd_characters(spark):
    names = "`a.b` int, `c ``d` string, `it's` int, `a\\b` date, `total count` double"
    frame = spark.createDataFrame([(1, "x", 2, None, -1.0)], names)
    found = by_column(
        profiling.column_statistics(registry(spark, **{"my table": frame})), "distinct_count"
    )
    assert found == {
        "a.b": (1,), "c `d": (1,), "it's": (1,), "a\\b": (0,), "total count": (1,),
    }
    plan = profiling.table_plans(registry(spark, t=frame))[0]
    assert stats.table_facts(plan).select("freshness_column").first()[0] == "a\\b"
    assert stats.table_facts(plan).select(F.inline("checks")).first()["issues"] == 1


def test_every_type_is_counted(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES
        (1Y, 2S, 3L, 1.5F, 1.25BD, DATE'2024-01-01', TIMESTAMP'2024-01-01 10:00:00',
         TIMESTAMP_NTZ'2024-01-01 10:00:00', X'00ff', array(1, 2), map('a', 1), struct(1 AS q),
         parse_json('{"a": 1}'), INTERVAL '1' DAY),
        (1Y, 2S, 3L, 1.5F, 1.25BD, DATE'2024-01-01', TIMESTAMP'2024-01-01 10:00:00',
         TIMESTAMP_NTZ'2024-01-01 10:00:00', X'00ff', array(1, 2), map('a', 1), struct(1 AS q),
         parse_json('{"a": 1}'), INTERVAL '1' DAY),
        (2Y, 3S, 4L, 2.5F, 2.25BD, DATE'2024-01-02', TIMESTAMP'2024-01-01 10:00:01',
         TIMESTAMP_NTZ'2024-01-01 10:00:01', X'01ff', array(2, 1), map('b', 1), struct(2 AS q),
         parse_json('{"a": 2}'), INTERVAL '2' DAY)
        AS t(by, sh, lo, fl, de, da, ts, tn, bi, ar, ma, st, va, iv)"""
    )
    reg = registry(spark, t=frame)
    found = by_column(profiling.column_statistics(reg), "distinct_count", "min_value")
    assert {c: v[0] for c, v in found.items()} == dict.fromkeys(frame.columns, 2)
    facts = stats.table_facts(profiling.table_plans(reg)[0], approx_distinct=True)
    sketched = by_column(stats.column_nulls(facts), "approx_distinct")
    assert sketched == dict.fromkeys(frame.columns, (2,))
    assert {c: v[1] for c, v in found.items() if v[1]} == {
        "by": "1", "sh": "2", "lo": "3", "fl": "1.5", "de": "1.25",
    }


def test_most_frequent_values_with_ties(spark, rows):
    words = ["b"] * 3 + ["a"] * 3 + ["d"] * 2 + ["c"] * 2 + ["e"] + [None] * 9
    frame = spark.createDataFrame([(w,) for w in words], "s string")
    plans = profiling.table_plans(registry(spark, t=frame))
    found = stats.top_values(plans, stats.value_frequencies(plans))
    assert sorted(rows(found, "rank", "value", "freq")) == [(1, "a", 3), (2, "b", 3), (3, "c", 2)]


def test_long_texts_travel_as_digests(spark, rows):
    long = ["x" * 100, "y" * 5000, "z" * 70]
    texts = [long[0]] * 4 + [long[1]] * 3 + ["short"] * 3 + [long[2]] * 2
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    plans = profiling.table_plans(registry(spark, t=frame))
    frequencies = stats.value_frequencies(plans)
    found = stats.top_values(plans, frequencies)
    assert sorted(rows(found, "rank", "value", "freq")) == [
        (1, long[0], 4), (2, "short", 3), (3, long[1], 3),
    ]
    assert rows(stats.distinct_counts(frequencies), "distinct_count") == [(4,)]
    widest = frequencies["text"].agg(F.max(F.length("value")), F.max(F.length("digest"))).first()
    assert tuple(widest) == (5, 16)


def test_long_texts_rank_by_value_like_short_ones(spark, rows):
    heads = ["h" * 90 + c for c in "dcba"]
    for texts in (["a" * 100, "m", "n", "o"], [*heads, "h" * 40, "i"], ["b", "a" * 64, "a" * 65, "a" * 66]):
        frame = spark.createDataFrame([(t,) for t in texts], "s string")
        plans = profiling.table_plans(registry(spark, t=frame))
        found = stats.top_values(plans, stats.value_frequencies(plans))
        assert [r[1] for r in sorted(rows(found, "rank", "value"))] == sorted(texts)[:3]


def test_a_value_in_a_third_of_the_rows(spark):
    frame = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
        F.concat(F.lit("v"), F.col("id") % 7).alias("s"),
    )
    reg = registry(spark, Constraints({"t": ("k",)}), t=frame)
    plans = profiling.table_plans(reg)
    found = by_column(profiling.column_statistics(reg), "distinct_count", "top_values")
    counted = Counter(f"v{i % 7}" for i in range(90_000))
    best = sorted(counted, key=lambda v: (-counted[v], v))[:3]
    assert found == {"k": (60_001, None), "s": (7, best)}
    assert stats.repeated_keys(plans).first()["duplicate_count"] == 1


def test_repeated_keys_are_groups(spark, rows):
    frame = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (None, 1), (None, 1)], "a int, b int"
    )
    keys = Constraints({"one": ("a",), "two": ("a", "b")})
    reg = registry(spark, keys, one=frame, two=frame, none=frame)
    plans = profiling.table_plans(reg)
    expected = [("one", 3), ("two", 3)]
    assert sorted(rows(stats.repeated_keys(plans))) == expected
    summary = stats.value_summary(plans, stats.value_frequencies(plans))
    assert sorted(rows(stats.repeated_keys(plans, summary))) == expected


def test_samples_leave_out_keys_dates_and_secrets(spark):
    frame = spark.createDataFrame(
        [(1, 2, "x", True, 5, "h", 1.5)] * 2,
        "user_id int, n int, name string, ok boolean, created_at int, token_hash string, x double",
    )
    plans = profiling.table_plans(registry(spark, t=frame))
    found = by_column(stats.sample_values(plans), "values")
    assert found == {"n": (["2"],), "name": (["x"],), "ok": (["True"],)}


def test_sketches_come_from_the_same_pass(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 10).alias("d"))
    plan = profiling.table_plans(registry(spark, t=frame))[0]
    found = by_column(
        stats.column_nulls(stats.table_facts(plan, approx_distinct=True)), "approx_distinct"
    )
    assert found["d"][0] == 10 and abs(found["id"][0] - 1000) < 100


def test_counts_from_file_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.range(1000).select(
        "id",
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("n"), "id")).alias("note"),
        F.when(F.col("id") % 5 > 0, F.col("id") - 10).alias("count"),
        F.timestamp_seconds("id").alias("at"),
    )
    frame.repartition(3).write.parquet(path)
    plain = Registry(spark, [TableSource("t", path=path)])
    quick = Registry(spark, [TableSource("t", path=path, footer_counts=True)])
    assert spark.conf.get("spark.sql.sources.useV1SourceList")
    expected, found = (
        sorted(map(str, profiling.column_statistics(reg).collect())) for reg in (plain, quick)
    )
    assert found == expected
    as_of = "2024-02-01"
    assert (
        profiling.quality_profile(quick, as_of).collect()
        == profiling.quality_profile(plain, as_of).collect()
    )
    plan = profiling.table_plans(quick)[0]
    text = stats.table_facts(plan, ranges=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), COUNT(note)" in text
    assert "ReadSchema: struct<count:bigint,at:timestamp>" in text
    nested = frame.select("id", F.array("id").alias("ids"))
    nested.write.parquet(str(tmp_path / "n"))
    deep = Registry(spark, [TableSource("n", path=str(tmp_path / "n"), footer_counts=True)])
    assert deep.load_footers("n") is None


def test_a_table_without_columns_is_refused(spark):
    with pytest.raises(ValueError):
        profiling.table_plans(registry(spark, t=spark.range(3).drop("id")))


def test_keys_are_found_in_any_case_or_missed_loudly(spark, rows):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    source = TableSource("t", frame=frame)
    reg = Registry(spark, [source], Constraints({"t": ("ID",)}))
    assert rows(stats.repeated_keys(profiling.table_plans(reg))) == [("t", 1)]
    assert rows(reg.primary_keys(), "table_name")[0] == ("t",)
    with pytest.raises(ValueError, match="nothing"):
        profiling.table_plans(Registry(spark, [source], Constraints({"t": ("nothing",)})))


def test_nested_values_keep_microseconds_and_know_one_zero(spark):
    frame = spark.sql(
        "select named_struct('t', timestamp'2024-01-01 00:00:00.000001', 'it''s', 1) as s,"
        " array(0.0D, 1.5D) as a, map('k', array(0.0F)) as m, array(named_struct('d', 0.0D)) as n"
        " union all "
        "select named_struct('t', timestamp'2024-01-01 00:00:00.000002', 'it''s', 1),"
        " array(-0.0D, 1.5D), map('k', array(-0.0F)), array(named_struct('d', -0.0D))"
    )
    found = by_column(profiling.column_statistics(registry(spark, t=frame)), "distinct_count")
    assert found == {"s": (2,), "a": (1,), "m": (1,), "n": (1,)}


def shuffled_rows(df):
    """Rows that each shuffle of a plan sent when it ran."""
    df.collect()
    waiting, found = [df._jdf.queryExecution().executedPlan()], []
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def expected_tops(words, limit=3):
    counted = {}
    for w in words:
        if w is not None:
            counted[w] = counted.get(w, 0) + 1
    best = sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:limit]
    return [(n, w, f) for n, (w, f) in enumerate(best, 1)]


def test_unique_texts_with_one_beginning_stay_where_they_are(spark, rows):
    url = "https://example.org/a/folder/with/a/rather/long/name/that/all/texts/share/"
    words = [f"{url}{i * 7919 % 20000:06}" for i in range(20_000)]
    frame = spark.createDataFrame([(w,) for w in words], "s string").repartition(8)
    plans = profiling.table_plans(registry(spark, t=frame))
    found = stats.top_values(plans, stats.value_frequencies(plans))
    sent = shuffled_rows(found)
    assert sorted(rows(found, "rank", "value", "freq")) == expected_tops(words)
    # The input's own shuffle and that of the frequencies; all others send a few rows per task.
    assert sum(n > 100 for n in sent) <= 2 + sum(n == 20_000 for n in sent)
    assert all(n <= 3 * 16 or n == 20_000 for n in sent)


@pytest.mark.parametrize("case", range(12))
def test_top_texts_of_any_frequencies_and_lengths(spark, rows, case):
    r = random.Random(case)
    heads = ["h" * 40, "h" * 31 + "i", "k" * 70]
    pool = [None, "", "a", "h" * 32, "h" * 33]
    pool += [r.choice(heads) + str(r.randint(0, 60)) + "x" * r.choice([0, 5, 50]) for _ in range(40)]
    if case % 3 == 0:  # all occur once
        words = list(dict.fromkeys(pool))
    elif case % 3 == 1:  # all occur twice
        words = list(dict.fromkeys(pool)) * 2
    else:
        words = r.choices(pool, k=r.randint(1, 150))
    r.shuffle(words)
    frame = spark.createDataFrame([(w, w) for w in words], "s string, t string").repartition(3)
    plans = profiling.table_plans(registry(spark, t=frame))
    found = stats.top_values(plans, stats.value_frequencies(plans))
    for column in (0, 1):
        mine = found.where(F.col("column_id") == column)
        assert sorted(rows(mine, "rank", "value", "freq")) == expected_tops(words)
