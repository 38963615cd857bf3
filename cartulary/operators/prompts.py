"""Prompts for tables, columns, tags and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions import vocabulary as V
from cartulary.functions.expressions import fill
from cartulary.session import spread


def first_columns(columns: DataFrame, limit: int) -> DataFrame:
    """The first few columns of every table by name, as (table_name, place, column_name).

    Columns are dealt out by table once, before they are ranked.
    """
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("column_name"))
    return (
        spread(columns.select("table_name", "column_name"), "table_name")
        .withColumn("place", place)
        .where(F.col("place") <= limit)
    )


def _column_lists(columns: DataFrame, samples: DataFrame | None, limit: int) -> DataFrame:
    """Per table the first columns in order, with their samples; at most ``limit`` entries."""
    listed = first_columns(columns, limit)
    if samples is None:
        listed = listed.withColumn("values", F.array().cast("array<string>"))
    else:
        listed = listed.join(samples, ["table_name", "column_name"], "left")
    entry = F.struct("place", "column_name", "values")
    return listed.groupBy("table_name").agg(F.array_sort(F.collect_list(entry)).alias("listed"))


def _names(limit: int):
    return F.array_join(F.transform(F.slice("listed", 1, limit), lambda c: c["column_name"]), ", ")


def _sample_lines():
    """A line per sampled column: the first few that have values, a few values each."""
    sampled = F.filter(
        "listed", lambda c: (c["place"] <= V.PROMPT_SAMPLED_FIRST) & (F.size(c["values"]) > 0)
    )
    lines = F.transform(
        F.slice(sampled, 1, V.PROMPT_SAMPLE_COLUMNS),
        lambda c: F.concat(
            F.lit("\n- "),
            c["column_name"],
            F.lit(": "),
            F.array_join(F.slice(c["values"], 1, V.TOP_VALUES), ", "),
        ),
    )
    return F.array_join(lines, "")


def _or_not_available(text):
    return F.when(text == "", V.NOT_AVAILABLE).otherwise(F.coalesce(text, F.lit(V.NOT_AVAILABLE)))


def table_prompts(tables: DataFrame, columns: DataFrame, samples: DataFrame) -> DataFrame:
    """(table_name, prompt) for every table, from names, row counts and sample values."""
    lists = _column_lists(columns, samples, V.PROMPT_COLUMNS)
    prompt = fill(
        V.TABLE_PROMPT,
        table=F.col("table_name"),
        columns=F.coalesce(_names(V.PROMPT_COLUMNS), F.lit("")),
        rows=F.col("row_count"),
        samples=_or_not_available(_sample_lines()),
    )
    joined = tables.select("table_name", "row_count").join(lists, "table_name", "left")
    return joined.select("table_name", prompt.alias("prompt"))


def column_prompts(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """(table_name, column_name, prompt) for every column."""
    values = F.array_join(F.slice("values", 1, V.PROMPT_COLUMN_SAMPLES), ", ")
    prompt = fill(
        V.COLUMN_PROMPT,
        table=F.col("table_name"),
        column=F.col("column_name"),
        type=F.col("clean_type"),
        nullable=F.when(F.col("null_pct") > 0, "Yes").otherwise("No"),
        samples=_or_not_available(values),
    )
    joined = columns.select("table_name", "column_name", "clean_type", "null_pct").join(
        samples, ["table_name", "column_name"], "left"
    )
    return joined.select("table_name", "column_name", prompt.alias("prompt"))


def tag_prompts(described: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, prompt) for every table in (table_name, description)."""
    lists = _column_lists(columns, None, V.TAG_COLUMNS)
    prompt = fill(
        V.TAGS_PROMPT,
        table=F.col("table_name"),
        columns=F.coalesce(_names(V.TAG_COLUMNS), F.lit("")),
        description=F.col("description"),
    )
    joined = described.select("table_name", "description").join(lists, "table_name", "left")
    return joined.select("table_name", prompt.alias("prompt"))


def relationship_prompts(relationships: DataFrame) -> DataFrame:
    """The names of each relationship with the prompt that asks to explain it."""
    names = ["source_table", "source_column", "target_table", "target_column"]
    prompt = fill(V.RELATIONSHIP_PROMPT, **{n: F.col(n) for n in names})
    return relationships.select(*names, prompt.alias("prompt"))
