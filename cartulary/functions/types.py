"""Raw type names to labels, as an expression over rows and as a lookup for known schemas."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.expressions import strip
from cartulary.functions.vocabulary import SPARK_TYPE_LABELS, TYPE_LABELS, UNKNOWN_LABEL

LABEL_OF = TYPE_LABELS | SPARK_TYPE_LABELS


def type_label(raw: Column) -> Column:
    """Label of a raw type: the name before any parameters, looked up, else unknown."""
    base = strip(F.regexp_extract(F.lower(raw), r"^[^(<]*", 0))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABEL_OF.items())])
    return F.coalesce(F.try_element_at(known, base), F.lit(UNKNOWN_LABEL))


def type_parameters(raw: Column) -> tuple[Column, Column, Column]:
    """(max_length, precision, scale) of a raw type.

    ``(p,s)`` fills precision and scale, one whole number fills the length, anything else
    gives nulls.
    """
    inner = strip(F.regexp_extract(raw, r"^[^(<]*\(([^)]*)\)", 1))
    pieces = F.split(inner, ",")
    is_pair = inner.contains(",")

    def number(position: int) -> Column:
        return F.when(is_pair, strip(F.get(pieces, F.lit(position))).try_cast("int"))

    length = F.when(inner.rlike(r"^\d+$"), inner.try_cast("int"))
    return length, number(0), number(1)


def label_of(dtype: T.DataType, raw: str | None = None) -> str:
    """Label of a column whose schema is at hand; ``raw`` is its declared name, if any."""
    name = (raw or dtype.simpleString()).lower()
    for mark in "(<":
        name = name.split(mark, 1)[0]
    return LABEL_OF.get(name.strip(), UNKNOWN_LABEL)
