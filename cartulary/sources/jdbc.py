"""Relational databases as a source, read through Spark's JDBC reader."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from cartulary.sources.registry import Constraints, ForeignKey, Registry, TableSource

# Rows of a table that one task reads, and the share of a large table that its ranges come from.
ROWS_PER_TASK = 1_000_000
SAMPLE_PERCENT = 1.0

TABLES_QUERY = (
    "SELECT table_name FROM information_schema.tables "
    "WHERE table_schema = {schema} AND table_type = 'BASE TABLE'"
)
COLUMNS_QUERY = (
    "SELECT table_name, column_name, data_type, character_maximum_length AS text_length, "
    "CASE WHEN data_type = 'numeric' THEN numeric_precision END AS digits, "
    "CASE WHEN data_type = 'numeric' THEN numeric_scale END AS decimals, "
    "is_nullable, column_default FROM information_schema.columns "
    "WHERE table_schema = {schema}"
)
# A row per column of a constraint. Names of constraints are unique within a table only, so they
# are told apart by number; the information schema does not say which table a key refers to.
KEYS_QUERY = (
    "SELECT CAST(c.oid AS BIGINT) AS constraint_id, "
    "CASE c.contype WHEN 'p' THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS constraint_type, "
    "t.relname AS table_name, a.attname AS column_name, k.place AS ordinal_position, "
    "r.relname AS referred_table, ra.attname AS referred_column "
    "FROM pg_constraint c "
    "JOIN pg_class t ON t.oid = c.conrelid "
    "JOIN pg_namespace n ON n.oid = t.relnamespace "
    "CROSS JOIN LATERAL unnest(c.conkey) WITH ORDINALITY AS k(number, place) "
    "JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.number "
    "LEFT JOIN pg_class r ON r.oid = c.confrelid "
    "LEFT JOIN pg_attribute ra ON ra.attrelid = r.oid AND ra.attnum = c.confkey[k.place] "
    "WHERE n.nspname = {schema} AND c.contype IN ('p', 'f')"
)
SIZES_QUERY = (
    "SELECT c.relname AS table_name, "
    "COALESCE(pg_total_relation_size(c.oid), 0) AS table_size_bytes "
    "FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace "
    "WHERE n.nspname = {schema} AND c.relkind IN ('r', 'p')"
)
# The first key of every so many rows, in order: ranges between them hold equally many.
STARTS_QUERY = (
    "SELECT min(k) AS start FROM (SELECT {key} AS k, "
    "FLOOR((row_number() OVER (ORDER BY {key}) - 1) / {step}.0) AS part "
    "FROM {table}{sample} WHERE {key} IS NOT NULL) numbered GROUP BY part ORDER BY 1"
)


def name_in_sql(*names: str) -> str:
    """A name of the database, whatever characters it holds."""
    return ".".join('"' + n.replace('"', '""') + '"' for n in names)


def text_in_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def value_in_sql(value) -> str:
    """A key as the database writes it: numbers as they are, everything else in quotes."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return text_in_sql(str(value))


def read_query(spark: SparkSession, options: dict, query: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def declared_type(row) -> str:
    """Type name with its parameters, from a row of the columns query."""
    if row["text_length"] is not None:
        return f"{row['data_type']}({row['text_length']})"
    if row["digits"] is not None:
        return f"{row['data_type']}({row['digits']},{row['decimals']})"
    return row["data_type"]


def table_source(
    name: str,
    options: dict,
    schema: str = "public",
    split: dict | None = None,
    declared: dict | None = None,
    key: str | None = None,
) -> TableSource:
    """A table read over JDBC, in ranges of a column by many tasks at a time.

    ``split`` names a partition column with its bounds and the number of partitions. Without it,
    the ranges of ``key`` are asked of the database when the table is first read. The table is
    staged, so the database is read once.
    """
    settings = {**options, "dbtable": name_in_sql(schema, name)}
    ranges = None
    if split:
        settings.update(
            partitionColumn=split["column"],
            lowerBound=str(split["lower"]),
            upperBound=str(split["upper"]),
            numPartitions=str(split["partitions"]),
        )
    elif key:

        def ranges(spark: SparkSession) -> list[str]:
            return balanced_ranges(spark, options, settings["dbtable"], key)

    return TableSource(
        name, format="jdbc", options=settings, declared=declared or {}, staged=True, ranges=ranges
    )


def starts_query(
    table: str, key: str, rows: int = ROWS_PER_TASK, percent: float | None = None
) -> str:
    """The query for the keys that ranges of about so many rows start at.

    With ``percent``, from a sample of the table's pages.
    """
    step = max(1, round(rows * (1 if percent is None else percent / 100)))
    sample = "" if percent is None else f" TABLESAMPLE SYSTEM ({percent})"
    return STARTS_QUERY.format(key=name_in_sql(key), step=step, table=table, sample=sample)


def range_predicates(key: str, starts: list) -> list[str]:
    """Conditions that each row meets one of: ranges between keys, nulls with the first.

    ``starts`` are the keys that ranges start at, in the order of the database. What is below the
    least of them belongs to the first range, too, so they may come from a sample. A key that fills
    several ranges starts one only.
    """
    column, inner = name_in_sql(key), []
    for start in starts[1:]:
        text = value_in_sql(start)
        if text not in inner and text != value_in_sql(starts[0]):
            inner.append(text)
    if not inner:
        return []
    first = f"{column} < {inner[0]} OR {column} IS NULL"
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(inner[:-1], inner[1:], strict=True)]
    return [first, *between, f"{column} >= {inner[-1]}"]


def balanced_ranges(
    spark: SparkSession,
    options: dict,
    table: str,
    key: str,
    rows: int = ROWS_PER_TASK,
    percent: float = SAMPLE_PERCENT,
) -> list[str]:
    """Conditions for reading a table in ranges of about equally many rows, however keys are spread.

    The database numbers a sample of the keys and returns one of each range. A sample without
    any keys means a table too small to be read in ranges.
    """
    found = read_query(spark, options, starts_query(table, key, rows, percent)).collect()
    return range_predicates(key, [r["start"] for r in found])


def constraints_from(keys: list, columns: list) -> Constraints:
    """Constraints from the rows of the key and column queries."""
    by_constraint: dict = {}
    for row in sorted(keys, key=lambda r: (r["table_name"], r["constraint_id"], r["ordinal_position"])):
        by_constraint.setdefault(row["constraint_id"], []).append(row)
    primary, foreign = {}, []
    for rows in by_constraint.values():
        table, own = rows[0]["table_name"], tuple(r["column_name"] for r in rows)
        if rows[0]["constraint_type"] == "PRIMARY KEY":
            primary[table] = own
        else:
            referred = tuple(r["referred_column"] for r in rows if r["referred_column"])
            foreign.append(ForeignKey(table, own, rows[0]["referred_table"] or "", referred))
    not_null: dict = {}
    for row in columns:
        if row["is_nullable"] == "NO":
            not_null.setdefault(row["table_name"], []).append(row["column_name"])
    return Constraints(primary, tuple(foreign), {t: tuple(c) for t, c in not_null.items()})


def database_registry(
    spark: SparkSession, url: str, schema: str = "public", splits: dict | None = None, **options
) -> Registry:
    """All base tables of a database schema with the keys it declares.

    Only the schema is read here, a row per table, column or key. Tables are read in ranges of
    the first column of their primary key unless ``splits`` says otherwise.
    """
    settings, named = {"url": url, **options}, {"schema": text_in_sql(schema)}
    tables = read_query(spark, settings, TABLES_QUERY.format(**named))
    keys = read_query(spark, settings, KEYS_QUERY.format(**named)).collect()
    columns = read_query(spark, settings, COLUMNS_QUERY.format(**named)).collect()
    constraints = constraints_from(keys, columns)
    declared: dict = {}
    for row in columns:
        described = (declared_type(row), row["column_default"])
        declared.setdefault(row["table_name"], {})[row["column_name"]] = described
    sources = [
        table_source(
            name,
            settings,
            schema,
            (splits or {}).get(name),
            declared.get(name),
            next(iter(constraints.primary_key(name)), None),
        )
        for name in (row["table_name"] for row in tables.collect())
    ]
    return Registry(spark, sources, constraints)


def table_sizes(spark: SparkSession, url: str, schema: str = "public", **options) -> DataFrame:
    """Bytes per table as the database reports them, indexes included; PostgreSQL only."""
    query = SIZES_QUERY.format(schema=text_in_sql(schema))
    return read_query(spark, {"url": url, **options}, query)
