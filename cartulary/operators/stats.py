"""Column statistics: one scan for counts and ranges, one shuffle for distinct and top values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartulary.functions import vocabulary as V
from cartulary.functions.expressions import (
    name_has,
    percent,
    quoted,
    round2,
    side_by_side,
    text_literal,
    tick,
    utc_naive,
    value_text,
)
from cartulary.sources.registry import ColumnSpec

MEASURES = (
    "array<struct<ordinal:int,column_name:string,clean_type:string,null_count:bigint,"
    "min_value:string,max_value:string,min_number:double,max_number:double,avg_number:double,"
    "approx_distinct:bigint,approx_top:array<string>>>"
)
CHECKS = "array<struct<ordinal:int,column_name:string,rule:string,issues:bigint>>"

FACTS = (
    f"table_name string, row_count bigint, column_count int, columns {MEASURES}, "
    f"freshness_column string, latest timestamp_ntz, checks {CHECKS}"
)

# Longer texts travel as digests with their first characters; ranks do not depend on either.
LONG_TEXT_BYTES = 64
HEAD_CHARS = 32
# Sketches: buckets of distinct counts (2 to this power, an error of 1.6 %), and most frequent
# values that are tracked, by their first characters.
SKETCH_BITS = 12
TRACKED, TRACKED_CHARS, COMPARED = 1000, 64, 100
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


@dataclass(frozen=True)
class TablePlan:
    """A table with the column descriptors its statistics are planned from.

    ``footers`` is the same table, read in a way that takes counts from file footers.
    """

    name: str
    frame: DataFrame
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    footers: DataFrame | None = None


REPEATED = "table_name string, duplicate_count bigint"
SAMPLES = "table_name string, column_name string, values array<string>"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def is_numeric(column: ColumnSpec) -> bool:
    return column.label in V.NUMERIC_LABELS and isinstance(column.dtype, T.NumericType)


# ---------------------------------------------------------------------------------------------
# Counts, ranges and rule violations: one aggregate per table
# ---------------------------------------------------------------------------------------------


def rules_for(columns) -> list[tuple[ColumnSpec, str, str]]:
    """The validity rules that apply, each with the SQL condition of a violation."""
    low, high = V.RATING_RANGE
    rules = []
    for c in columns:
        value = tick(c.name)
        if is_numeric(c) and name_has(c.name, V.NON_NEGATIVE_WORDS):
            rules.append((c, "negative", f"{value} < 0"))
        if c.label in V.TEXT_LABELS and not c.nullable:
            rules.append((c, "blank", f"trim({value}) = ''"))
        if c.label == "integer" and name_has(c.name, (V.RATING_WORD,)):
            rules.append((c, "rating", f"{value} NOT BETWEEN {low} AND {high}"))
    return rules


def freshness_column(columns) -> ColumnSpec | None:
    """The first date or timestamp column in table order."""
    return next((c for c in columns if c.label in V.FRESHNESS_LABELS), None)


def table_facts(
    plan: TablePlan, ranges: bool = True, approx_distinct: bool = False, approx_top: bool = False
) -> DataFrame:
    """One row holding everything a single pass over the table can tell.

    All counters share one aggregate, so the table is scanned once and each task sends a single
    row to the final step. ``approx_distinct`` and ``approx_top`` add sketches of distinct counts
    and most frequent values to the same pass. Where file footers hold the counts, only the other
    figures need a scan, and only of their columns.

    The expressions are SQL texts because a wide table has very many of them, and each text is
    handed to Spark at once.
    """
    stamp = freshness_column(plan.columns)
    counts, others = ["count(1) AS n"], []
    for i, c in enumerate(plan.columns):
        value = tick(c.name)
        counts.append(f"count({value}) AS filled{i}")
        if approx_distinct:
            others.append(f"hll_sketch_estimate({distinct_sketch(plan, c)}) AS approx{i}")
        if approx_top and tracks_top(plan, c):
            others.append(f"approx_top_k_estimate({top_sketch(c)}, {COMPARED}) AS top{i}")
        if ranges and is_numeric(c):
            others += [f"{f}({value}) AS {f}{i}" for f in ("min", "max", "avg")]
    if stamp is not None:
        others.append(f"max({tick(stamp.name)}) AS latest")
    broken = rules_for(plan.columns)
    others += [f"count_if({condition}) AS issues{i}" for i, (_, _, condition) in enumerate(broken)]
    if plan.footers is None:
        row = plan.frame.selectExpr(*counts, *others)
    else:
        row = plan.footers.selectExpr(*counts)
        row = side_by_side(row, plan.frame.selectExpr(*others)) if others else row
    return shape_facts(plan, row, ranges, approx_distinct, approx_top)


def shape_facts(
    plan: TablePlan,
    row: DataFrame,
    ranges: bool = True,
    approx_distinct: bool = False,
    approx_top: bool = False,
) -> DataFrame:
    """The facts of a table from one row of its measures, numbered by column and rule."""
    stamp, columns = freshness_column(plan.columns), []
    for i, c in enumerate(plan.columns):
        ranged = ranges and is_numeric(c)
        low, high, mean = (f"min{i}", f"max{i}", f"avg{i}") if ranged else ("NULL",) * 3
        approx = f"CASE WHEN n > 0 THEN coalesce(approx{i}, 0) END" if approx_distinct else "NULL"
        top = _tracked_list(f"top{i}") if approx_top and tracks_top(plan, c) else "NULL"
        columns.append(
            f"named_struct('ordinal', {c.ordinal}, 'column_name', {text_literal(c.name)}, "
            f"'clean_type', {text_literal(c.label)}, 'null_count', n - filled{i}, "
            f"'min_value', CAST({low} AS STRING), 'max_value', CAST({high} AS STRING), "
            f"'min_number', CAST({low} AS DOUBLE), 'max_number', CAST({high} AS DOUBLE), "
            f"'avg_number', CAST({mean} AS DOUBLE), 'approx_distinct', CAST({approx} AS BIGINT), "
            f"'approx_top', CAST({top} AS ARRAY<STRING>))"
        )
    checks = ", ".join(
        f"named_struct('ordinal', {c.ordinal}, 'column_name', {text_literal(c.name)}, "
        f"'rule', '{rule}', 'issues', issues{i})"
        for i, (c, rule, _) in enumerate(rules_for(plan.columns))
    )
    latest = utc_naive(F.col("latest"), stamp.dtype) if stamp else F.lit(None)
    return row.select(
        F.lit(plan.name).alias("table_name"),
        F.col("n").alias("row_count"),
        F.lit(len(plan.columns)).alias("column_count"),
        F.expr(f"array({', '.join(columns)})").alias("columns"),
        F.lit(stamp.name if stamp else None).cast("string").alias("freshness_column"),
        latest.cast("timestamp_ntz").alias("latest"),
        F.expr(f"array({checks})").cast(CHECKS).alias("checks"),
    )


def distinct_sketch(plan: TablePlan, column: ColumnSpec) -> str:
    """SQL text of the aggregate that holds the state of a distinct count; states can be united."""
    utc = _utc_session([plan])
    key = key_of(column.name, column.dtype, utc)
    if key_kind(column.dtype, utc) == "real":
        key = f"CAST({key} + 0.0D AS STRING)"
    if key_kind(column.dtype, utc) == "text":
        key = f"concat('=', {key})"  # empty texts are left out of sketches
    return f"hll_sketch_agg({key}, {SKETCH_BITS})"


def tracks_top(plan: TablePlan, column: ColumnSpec) -> bool:
    return has_top_values(plan, column) and isinstance(column.dtype, T.StringType)


def top_sketch(column: ColumnSpec) -> str:
    """SQL text of the aggregate that holds the most frequent values; states can be combined.

    Longer texts count by their first characters.
    """
    value = f"substring(CAST({tick(column.name)} AS STRING), 1, {TRACKED_CHARS})"
    return f"approx_top_k_accumulate({value}, {TRACKED})"


def _tracked_list(tops: str) -> str:
    """SQL text of the first values of an estimate, by frequency and then by value."""
    known = f"filter({tops}, x -> x.item IS NOT NULL)"
    ordered = (
        f"array_sort({known}, (a, b) -> CASE WHEN a.count > b.count THEN -1 "
        "WHEN a.count < b.count THEN 1 WHEN a.item < b.item THEN -1 "
        "WHEN a.item > b.item THEN 1 ELSE 0 END)"
    )
    return f"transform(slice({ordered}, 1, {V.TOP_VALUES}), x -> x.item)"


def column_ranges(rows: DataFrame) -> DataFrame:
    """Adds the rounded mean and the text forms of smallest, largest and mean value."""
    is_real = F.col("clean_type") == "float"

    def text(kept: str, number: str) -> Column:
        return F.when(is_real, value_text(F.col(number), T.DoubleType())).otherwise(F.col(kept))

    rounded = rows.withColumn("avg_number", round2(F.col("avg_number")))
    return rounded.withColumns(
        {
            "min_value": text("min_value", "min_number"),
            "max_value": text("max_value", "max_number"),
            "avg_value": value_text(F.col("avg_number"), T.DoubleType()),
        }
    )


def column_nulls(facts: DataFrame) -> DataFrame:
    """Null counts and percentages per column; nothing but zeros for an empty table."""
    rows = facts.select("table_name", "row_count", F.inline("columns"))
    null_pct = percent(F.col("null_count"), F.col("row_count"))
    filled_pct = round2(F.lit(100) - null_pct.cast("decimal(5,2)"))
    return rows.withColumns(
        {"null_pct": F.coalesce(null_pct, F.lit(0.0)), "filled_pct": filled_pct}
    )


# ---------------------------------------------------------------------------------------------
# Distinct counts, most frequent values and repeated keys: one shuffle of (column, value)
# ---------------------------------------------------------------------------------------------


# Times in nested values keep their microseconds.
JSON_TIMES = (
    "map('timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSSXXX', "
    "'timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
)


def _has_real(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_real(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_real(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.MapType):
        return _has_real(dtype.keyType) or _has_real(dtype.valueType)
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _one_zero(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL text of a value whose negative zeros, at any depth, are plain zeros."""
    if not _has_real(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        item = f"x{depth}"
        return f"transform({value}, {item} -> {_one_zero(item, dtype.elementType, depth + 1)})"
    if isinstance(dtype, T.MapType):
        key, item = f"k{depth}", f"x{depth}"
        keys = _one_zero(key, dtype.keyType, depth + 1)
        items = _one_zero(item, dtype.valueType, depth + 1)
        keyed = f"transform_keys({value}, ({key}, {item}) -> {keys})"
        return f"transform_values({keyed}, ({key}, {item}) -> {items})"
    if isinstance(dtype, T.StructType):
        fields = ", ".join(
            f"{text_literal(f.name)}, {_one_zero(f'{value}.{tick(f.name)}', f.dataType, depth)}"
            for f in dtype.fields
        )
        return f"if({value} IS NULL, NULL, named_struct({fields}))"
    return f"({value} + CAST(0 AS {dtype.simpleString()}))"


def _comparable(name: str, dtype: T.DataType) -> str:
    """SQL text of a column: nested and binary values as text, everything else as it is."""
    value = tick(name)
    if isinstance(dtype, T.MapType):
        return f"to_json(array_sort(map_entries({_one_zero(value, dtype)})), {JSON_TIMES})"
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return f"to_json({_one_zero(value, dtype)}, {JSON_TIMES})"
    if isinstance(dtype, T.BinaryType):
        return f"hex({value})"
    if isinstance(dtype, T.VariantType) or not isinstance(dtype, T.AtomicType):
        return f"CAST({value} AS STRING)"
    return value


def key_kind(dtype: T.DataType, utc: bool) -> str:
    """Whether values of a type are grouped as whole numbers, real numbers or text."""
    whole = (T.BooleanType, T.IntegralType, T.DateType, T.TimestampType)
    if isinstance(dtype, whole) or (isinstance(dtype, T.TimestampNTZType) and utc):
        return "whole"
    return "real" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "text"


def key_of(name: str, dtype: T.DataType, utc: bool) -> str:
    """SQL text of the key a value is grouped by: equal keys mean equal values and vice versa."""
    kind, value = key_kind(dtype, utc), tick(name)
    if kind == "real":
        return f"CAST({value} AS DOUBLE)"
    if kind == "text":
        return f"CAST({_comparable(name, dtype)} AS STRING)"
    if isinstance(dtype, T.DateType):
        return f"CAST(unix_date({value}) AS BIGINT)"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"unix_micros(CAST({value} AS TIMESTAMP))"
    return f"CAST({value} AS BIGINT)"


def numbered(plans) -> list[tuple[TablePlan, list[tuple[int, ColumnSpec]]]]:
    """The tables with a number for every column, in a fixed order over all tables."""
    out, start = [], 0
    for plan in plans:
        out.append((plan, list(enumerate(plan.columns, start))))
        start += len(plan.columns)
    return out


def _utc_session(plans) -> bool:
    return plans[0].frame.sparkSession.conf.get("spark.sql.session.timeZone") in UTC_NAMES


def _number(name: str) -> Column:
    """Never null, or joins on it would add filters that keep Spark from sharing a shuffle."""
    return F.coalesce(F.col(name).cast("int"), F.lit(-1))


def value_frequencies(plans, wanted=None) -> dict[str, DataFrame]:
    """How often each value occurs in each column, as (column_id, value, freq) per kind of key.

    The columns of all tables go through one shuffle per kind of key. Each task counts its own
    values before it sends them, so a value that fills a third of a table costs one row per
    task. Texts beyond a fixed size travel as digests, so long documents are never shuffled.
    Nulls are a value of their own here. ``wanted(plan, column)`` leaves columns out.
    """
    utc = _utc_session(plans)
    stacked: dict[str, list[DataFrame]] = {}
    for plan, columns in numbered(plans):
        keys: dict[str, list[str]] = {}
        for cid, c in columns:
            if wanted is None or wanted(plan, c):
                key = key_of(c.name, c.dtype, utc)
                keys.setdefault(key_kind(c.dtype, utc), []).append(f"{key} AS `{cid}`")
        for kind, selected in keys.items():
            source = plan.frame.selectExpr(*selected)
            rows = source.unpivot([], source.columns, "column_id", "value")
            stacked.setdefault(kind, []).append(rows)
    counted = {}
    for kind, frames in stacked.items():
        rows = union_all(frames).withColumn("column_id", _number("column_id"))
        if kind == "text":
            long = F.octet_length("value") > LONG_TEXT_BYTES
            rows = rows.select(
                "column_id",
                F.when(~long, F.col("value")).alias("value"),
                F.when(long, _digest("value")).alias("digest"),
                F.when(long, F.substring("value", 1, HEAD_CHARS)).alias("head"),
            )
        counted[kind] = rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("freq"))
    return counted


def _digest(name: str) -> Column:
    return F.unhex(F.md5(name))


def _no_value(frame: DataFrame) -> Column:
    test = F.col("value").isNull()
    return test & F.col("digest").isNull() if "digest" in frame.columns else test


def distinct_counts(frequencies: dict[str, DataFrame]) -> DataFrame:
    """Per column_id the number of distinct values and of values that occur more than once.

    A repeated null counts as repeated, but not as a value.
    """
    parts = [
        frame.groupBy("column_id").agg(
            F.count_if(~_no_value(frame)).alias("distinct_count"),
            F.count_if(F.col("freq") > 1).alias("repeated_count"),
        )
        for frame in frequencies.values()
    ]
    return union_all(parts)


def top_values(plans, frequencies: dict[str, DataFrame], limit: int = V.TOP_VALUES) -> DataFrame:
    """The most frequent values per column as (column_id, rank, value, freq).

    Equal frequencies rank by value. Every task keeps only its best few per column before the
    final ranking, so no task sees all values of a column.

    Nulls are ranked last and dropped after the ranking: a filter before it would reach below
    the shuffle and keep it from being shared with the distinct counts.
    """
    parts = []
    for kind, frame in frequencies.items():
        if kind == "text":
            parts.append(_top_texts(plans, frame, limit))
            continue
        order = [F.asc(_no_value(frame)), F.desc("freq"), F.asc_nulls_last("value")]
        place = F.row_number().over(Window.partitionBy("column_id").orderBy(*order))
        ranked = frame.withColumn("rank", place)
        ranked = ranked.where((F.col("rank") <= limit) & ~_no_value(frame))
        text = value_text(F.col("value"), T.DoubleType()) if kind == "real" else _whole_text(plans)
        parts.append(ranked.select("column_id", "rank", text.alias("value"), "freq"))
    return union_all(parts)


def _best(texts: DataFrame, limit: int) -> DataFrame:
    """The first few (column_id, value, freq) of each column; each task cuts its own first."""
    place = Window.partitionBy("column_id").orderBy(F.desc("freq"), F.asc("value"))
    ranked = texts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)
    return ranked.select("column_id", "rank", "value", "freq")


def _top_texts(plans, frame: DataFrame, limit: int) -> DataFrame:
    """Most frequent texts of any length, in two steps.

    The first step ranks by frequency and first characters and finds, for each column, both at the
    last place wanted. Less than ``limit`` texts are before that place, and those that tie with
    it are settled by the whole text: where it is at hand, by a lookup of digests, or, if texts at
    that place occur once, in the table itself, where each task keeps the smallest few. So a column
    of unique texts with the same beginning sends a few rows per task.
    """
    head = F.coalesce("head", F.substring("value", 1, HEAD_CHARS))
    order = [F.asc(_no_value(frame)), F.desc("freq"), F.asc_nulls_last(head)]
    place = F.row_number().over(Window.partitionBy("column_id").orderBy(*order))
    last = frame.withColumn("rank", place).where((F.col("rank") == limit) & ~_no_value(frame))
    cut = F.broadcast(
        last.select(
            F.col("column_id").alias("cut_id"),
            F.col("freq").alias("cut_freq"),
            head.alias("cut_head"),
        )
    )
    freq, cut_freq, cut_head = F.col("freq"), F.col("cut_freq"), F.col("cut_head")
    before = cut_freq.isNull() | (freq > cut_freq) | ((freq == cut_freq) & (head < cut_head))
    tied = (freq == cut_freq) & (head == cut_head)
    placed = frame.join(cut, F.col("column_id") == F.col("cut_id"), "left")

    def chosen(kept: Column) -> DataFrame:
        # A number is never below zero; with it, no part of this is pushed below the shuffle.
        return placed.where((F.monotonically_increasing_id() < 0) | (~_no_value(frame) & kept))

    at_hand = chosen(F.col("value").isNotNull() & (before | tied)).select("column_id", "value", "freq")
    long = F.col("digest").isNotNull()
    looked_up = chosen(long & (before | (tied & (freq > 1)))).select("column_id", "digest", "freq")
    parts = [_best(at_hand, limit)]
    texts = _long_texts(plans)
    if texts is not None:
        found = texts.withColumn("digest", _digest("text")).join(looked_up, ["column_id", "digest"]).distinct()
        parts.append(_best(found.withColumnRenamed("text", "value"), limit))
        # Few rows per column on the other side of both joins, and no two alike. They are no semi and
        # anti joins because Spark would do these once for each table.
        above = chosen(long & before).select(
            F.col("column_id").alias("above_id"), F.col("digest").alias("above_digest")
        )
        same = (F.col("column_id") == F.col("cut_id")) & (F.substring("text", 1, HEAD_CHARS) == cut_head)
        unique = texts.join(F.broadcast(cut.where("cut_freq = 1")), same)
        known = (F.col("column_id") == F.col("above_id")) & (_digest("text") == F.col("above_digest"))
        unique = unique.join(F.broadcast(above), known, "left").where("above_id is null")
        unique = unique.select("column_id", F.col("text").alias("value"), F.lit(1).cast("bigint").alias("freq"))
        parts.append(_best(unique, limit))
    return _best(union_all(parts).drop("rank"), limit)


def _whole_text(plans) -> Column:
    """Whole-number keys back as the text of the type they came from."""
    value, text = F.col("value"), F.col("value").cast("string")
    forms = {
        T.BooleanType: value_text(value == 1, T.BooleanType()),
        T.DateType: F.date_from_unix_date(value.cast("int")).cast("string"),
        T.TimestampType: F.timestamp_micros(value).cast("string"),
        T.TimestampNTZType: F.timestamp_micros(value).cast("string"),
    }
    columns = [pair for _, pairs in numbered(plans) for pair in pairs]
    for dtype, form in forms.items():
        ids = [cid for cid, c in columns if type(c.dtype) is dtype]
        if ids:
            text = F.when(F.col("column_id").isin(ids), form).otherwise(text)
    return text


def _long_texts(plans) -> DataFrame | None:
    """(column_id, text) of every long text; None if no column has text."""
    sources = []
    for plan, columns in numbered(plans):
        texts = [(cid, c) for cid, c in columns if isinstance(c.dtype, T.StringType)]
        if texts:
            named = plan.frame.select([quoted(c.name).alias(str(cid)) for cid, c in texts])
            sources.append(named.unpivot([], named.columns, "column_id", "text"))
    if not sources:
        return None
    long = union_all(sources).where(F.octet_length("text") > LONG_TEXT_BYTES)
    return long.select(_number("column_id").alias("column_id"), "text")


def name_columns(plans, frame: DataFrame, wanted=None) -> DataFrame:
    """Replaces column_id by table_name and column_name; ``wanted`` leaves columns out.

    The lookup has a row per column of the schemas, never of the data, and is broadcast.
    """
    rows = [
        (cid, plan.name, c.ordinal, c.name)
        for plan, columns in numbered(plans)
        for cid, c in columns
        if wanted is None or wanted(plan, c)
    ]
    schema = "column_id int, table_name string, ordinal int, column_name string"
    lookup = plans[0].frame.sparkSession.createDataFrame(rows, schema)
    return frame.join(F.broadcast(lookup), "column_id").drop("column_id")


def has_top_values(plan: TablePlan, column: ColumnSpec) -> bool:
    """The columns whose most frequent values belong to their profile."""
    return column.label in V.TEXT_LABELS


def has_samples(plan: TablePlan, column: ColumnSpec) -> bool:
    """The columns whose most frequent values may be shown in prompts."""
    return column.label in V.SAMPLED_LABELS and not name_has(column.name, V.UNSAMPLED_WORDS)


def value_lists(tops: DataFrame) -> DataFrame:
    """Per column_id the list of its most frequent values in order; a few entries each."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return tops.groupBy("column_id").agg(
        F.transform(in_order, lambda v: v["value"]).alias("values")
    )


def value_summary(plans, frequencies: dict[str, DataFrame]) -> DataFrame:
    """Per column_id distinct_count, repeated_count and the most frequent values.

    Both sides read the same shuffled frequencies, which Spark then exchanges only once.
    """
    tops = value_lists(top_values(plans, frequencies))
    return distinct_counts(frequencies).join(tops, "column_id", "left")


def sample_values(plans) -> DataFrame:
    """(table_name, column_name, values) for the columns that may be shown in prompts."""
    frequencies = value_frequencies(plans, has_samples)
    if not frequencies:
        return plans[0].frame.sparkSession.createDataFrame([], SAMPLES)
    return samples_of(plans, value_lists(top_values(plans, frequencies)))


def samples_of(plans, summary: DataFrame) -> DataFrame:
    """The samples among the values that a summary has of the columns of the same tables."""
    named = name_columns(plans, summary.where("values is not null"), has_samples)
    return named.select("table_name", "column_name", "values")


def has_one_column_key(plan: TablePlan, column: ColumnSpec) -> bool:
    return plan.primary_key == (column.name,)


def repeated_keys(plans, summary: DataFrame | None = None) -> DataFrame:
    """Per table with a key the number of key values that occur more than once.

    One-column keys are columns like any other: all tables share a shuffle of (column, value),
    or none at all where the value summary of a profile is at hand. Only keys of several
    columns are grouped table by table.
    """
    name, repeated = F.col("table_name"), F.col("repeated_count").alias("duplicate_count")
    parts = []
    if any(has_one_column_key(plan, c) for plan in plans for c in plan.columns):
        if summary is None:
            summary = distinct_counts(value_frequencies(plans, has_one_column_key))
        named = name_columns(plans, summary, has_one_column_key)
        parts.append(named.select(name, repeated))
    for plan in plans:
        if len(plan.primary_key) > 1:
            groups = plan.frame.groupBy([quoted(k) for k in plan.primary_key])
            counted = groups.agg(F.count(F.lit(1)).alias("n"))
            twice = F.count_if(F.col("n") > 1).alias("duplicate_count")
            label = F.lit(plan.name).alias("table_name")
            parts.append(counted.agg(twice).select(label, "duplicate_count"))
    if not parts:
        return plans[0].frame.sparkSession.createDataFrame([], REPEATED)
    return union_all(parts)
