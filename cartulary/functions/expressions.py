"""Small column expressions: quoting, rounding, text forms, defaults."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tick(name: str) -> str:
    """A column name for SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """A column by its exact name."""
    return F.col(tick(name))


def text_literal(text: str) -> str:
    """A text for SQL text, whatever characters it holds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def or_default(value: Column, default) -> Column:
    """``default`` where the value is null, empty text or zero; a boolean only where null."""
    if isinstance(default, bool):
        return F.coalesce(value, F.lit(default))
    empty = F.lit("" if isinstance(default, str) else type(default)(0))
    return F.coalesce(F.nullif(value, empty), F.lit(default))


def present(*values: Column) -> Column:
    """True where every text is neither null nor empty."""
    test = F.lit(True)
    for value in values:
        test = test & F.coalesce(value != "", F.lit(False))
    return test


def contains_any(text: Column, words) -> Column:
    """True where the lower-cased text holds one of the words."""
    lowered = F.lower(text)
    test = F.lit(False)
    for word in words:
        test = test | lowered.contains(word)
    return test


def name_has(name: str, words) -> bool:
    """The same test for a column name that is known while the plan is built."""
    lowered = name.lower()
    return any(word in lowered for word in words)


def ratio(part: Column, whole: Column, factor: int = 1) -> Column:
    """part * factor / whole in exact decimals, so that a later round sees true ties.

    Null where the whole is zero.
    """
    divisor = F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return part.cast("decimal(20,2)") * F.lit(factor) / divisor


def round2(value: Column) -> Column:
    """Two decimals, halves away from zero, as a double."""
    return F.round(value, 2).cast("double")


def percent(part: Column, whole: Column) -> Column:
    return round2(ratio(part, whole, 100))


def as_of_column(as_of: datetime | str | Column | None) -> Column:
    """The reference time of a run as a zone-less UTC timestamp; the clock where none is given."""
    if as_of is None:
        return utc_naive(F.current_timestamp(), T.TimestampType())
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime) and as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(str(as_of)).cast("timestamp_ntz")


def utc_naive(value: Column, dtype: T.DataType) -> Column:
    """A date or timestamp as a zone-less UTC timestamp; zone-less input counts as UTC."""
    if isinstance(dtype, T.TimestampType):
        return F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz")
        )
    return value.cast("timestamp_ntz")


def elapsed_days(latest: Column, as_of: Column) -> Column:
    """Whole days from ``latest`` to ``as_of``, rounded down also when negative."""
    days = F.datediff(F.to_date(as_of), F.to_date(latest))
    overshoot = (latest + F.make_dt_interval(days)) > as_of
    return days - overshoot.cast("int")


def double_text(value: Column) -> Column:
    """A double as the shortest plain text: ``10000000000.0``, and ``1e+16`` from there on."""
    java = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(value.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    digits = F.abs(exponent).cast("string")
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, "-").otherwise("+"),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(java == "Infinity", "inf")
        .when(java == "-Infinity", "-inf")
        .when(value == 0, "0.0")
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def value_text(value: Column, dtype: T.DataType) -> Column:
    """A value as text: ``True``/``False`` for booleans, plain digits for numbers."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(dtype, T.FloatType):
        return double_text(value.cast("string").cast("double"))
    if isinstance(dtype, T.DoubleType):
        return double_text(value)
    return value.cast("string")


def fill(template: str, **values: Column) -> Column:
    """A prompt with its named places filled by columns; a null value reads as ``None``."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1]
        if piece.startswith("{") and name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Frames of at most one row each as one row; their columns must differ."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
