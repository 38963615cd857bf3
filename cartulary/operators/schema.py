"""Column and key descriptors: from what a schema says to one clean row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.expressions import strip
from cartulary.functions.types import type_label, type_parameters


def parse_types(raw: DataFrame, column: str = "type") -> DataFrame:
    """Adds raw_type, clean_type, max_length, precision and scale for the type in ``column``."""
    cleaned = raw.withColumn("raw_type", strip(F.lower(F.coalesce(F.col(column), F.lit("")))))
    length, precision, scale = type_parameters(F.col("raw_type"))
    return cleaned.withColumns(
        {
            "clean_type": type_label(F.col("raw_type")),
            "max_length": length,
            "precision": precision,
            "scale": scale,
        }
    )


def parse_columns(raw: DataFrame) -> DataFrame:
    """Clean descriptors from (table_name, ordinal, name, type, nullable, default)."""
    typed = parse_types(raw)
    default = F.col("default")
    return typed.select(
        "table_name",
        "ordinal",
        F.col("name").alias("column_name"),
        "clean_type",
        "max_length",
        "precision",
        "scale",
        "raw_type",
        F.coalesce("nullable", F.lit(True)).alias("is_nullable"),
        default.isNotNull().alias("has_default"),
        F.nullif(default, F.lit("")).alias("default_value"),
        F.lit(False).alias("is_primary_key"),
        F.lit(False).alias("is_foreign_key"),
        F.lit(None).cast("string").alias("references_table"),
        F.lit(None).cast("string").alias("references_column"),
    )


def parse_foreign_keys(raw: DataFrame) -> DataFrame:
    """One row per declared key; of a composite key only the first column pair counts."""
    return raw.select(
        "table_name",
        "fk_ordinal",
        F.get("constrained_columns", F.lit(0)).alias("column"),
        F.coalesce("referred_table", F.lit("")).alias("references_table"),
        F.get("referred_columns", F.lit(0)).alias("references_column"),
    )


def mark_keys(columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Flags key columns; where several foreign keys share a column the last one counts."""
    pk = primary_keys.select(
        "table_name", "column_name", F.lit(True).alias("_pk")
    ).distinct()
    fk = (
        foreign_keys.where("column is not null")
        .groupBy("table_name", F.col("column").alias("column_name"))
        .agg(
            F.max_by(F.struct("references_table", "references_column"), "fk_ordinal").alias("_fk")
        )
    )
    keys = ["table_name", "column_name"]
    return (
        columns.join(pk, keys, "left")
        .join(fk, keys, "left")
        .withColumns(
            {
                "is_primary_key": F.col("is_primary_key") | F.col("_pk").isNotNull(),
                "is_foreign_key": F.col("_fk").isNotNull(),
                "references_table": F.col("_fk.references_table"),
                "references_column": F.col("_fk.references_column"),
            }
        )
        .select(columns.columns)
    )


def summarize_tables(columns: DataFrame) -> DataFrame:
    """Per table the number of columns and the names of key, nullable and required ones."""

    def names(test):
        kept = F.collect_list(F.when(test, F.struct("ordinal", "column_name")))
        return F.transform(F.array_sort(kept), lambda c: c["column_name"])

    return columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        names(F.col("is_primary_key")).alias("primary_key_cols"),
        names(F.col("is_nullable")).alias("nullable_cols"),
        names(~F.col("is_nullable")).alias("required_cols"),
    )
