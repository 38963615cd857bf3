"""The tables to catalog, their declared keys, and what their schemas say.

Files carry types but no keys, so keys are declared next to the tables. Everything here is
schema metadata: a row per column or key, never a row of data.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.types import label_of
from cartulary.functions.vocabulary import CATALOG_TABLES
from cartulary.session import materialize

RAW_COLUMNS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("default", T.StringType()),
    ]
)
RAW_FOREIGN_KEYS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("fk_ordinal", T.IntegerType()),
        T.StructField("constrained_columns", T.ArrayType(T.StringType())),
        T.StructField("referred_table", T.StringType()),
        T.StructField("referred_columns", T.ArrayType(T.StringType())),
    ]
)
PRIMARY_KEYS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
    ]
)
MANIFEST = "table_name string, file string, bytes long, modified timestamp"
TABLE_NAMES = T.StructType([T.StructField("table_name", T.StringType())])


# Schemas looked up at the same time; each lookup opens one file.
SCHEMA_LOOKUPS = 16

# Formats whose counts can come from file footers, with the setting that allows it, and the
# setting that decides which reader a format gets: only the newer one looks at footers.
FOOTER_SETTINGS = {
    "parquet": "spark.sql.parquet.aggregatePushdown",
    "orc": "spark.sql.orc.aggregatePushdown",
}
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
V1_SOURCES = "spark.sql.sources.useV1SourceList"


@dataclass(frozen=True)
class TableSource:
    """How to read one table: a registered table, or files of a format with options.

    ``declared`` maps a column to the type name and default its source declares, for sources
    whose own type names Spark does not keep. A ``staged`` table is copied to the shared folder
    when it is first used: a profile reads each column of a columnar table twice, but a database
    or text files would be read from end to end every time.

    ``footer_counts`` takes row and null counts of Parquet or ORC files from their footers, so
    that columns without other statistics are not read for them. The files must hold statistics,
    as those written by Spark do.

    ``ranges`` gives the conditions that the tasks read a database table by, one each.
    """

    name: str
    path: str | None = None
    format: str = "parquet"
    table: str | None = None
    options: dict = field(default_factory=dict)
    schema: T.StructType | None = None
    frame: DataFrame | None = None
    declared: dict = field(default_factory=dict)
    staged: bool = False
    footer_counts: bool = False
    ranges: Callable[[SparkSession], list[str]] | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        if self.table:
            return spark.table(self.table)
        if self.ranges is not None:
            conditions = self.ranges(spark)
            if conditions:
                others = {k: v for k, v in self.options.items() if k not in ("url", "dbtable")}
                url, name = self.options["url"], self.options["dbtable"]
                return spark.read.jdbc(url, name, predicates=conditions, properties=others)
        reader = spark.read.format(self.format).options(**self.options)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        return reader.load(self.path) if self.path else reader.load()


@dataclass(frozen=True)
class ForeignKey:
    table: str
    columns: tuple[str, ...]
    references: str
    referred_columns: tuple[str, ...]


@dataclass(frozen=True)
class Constraints:
    """Declared keys: primary-key columns and required columns per table, and foreign keys."""

    primary_keys: dict = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: dict = field(default_factory=dict)

    def primary_key(self, table: str) -> list[str]:
        return list(self.primary_keys.get(table, ()))

    def is_required(self, table: str, column: str) -> bool:
        return column in self.not_null.get(table, ())


@dataclass(frozen=True)
class ColumnSpec:
    """One column as the planner of a profile sees it."""

    ordinal: int
    name: str
    dtype: T.DataType
    raw_type: str
    label: str
    nullable: bool
    default: str | None


class Registry:
    """A named set of tables with their constraints."""

    def __init__(self, spark: SparkSession, sources, constraints: Constraints | None = None):
        self.spark = spark
        self.sources = {s.name: s for s in sources}
        self.constraints = constraints or Constraints()
        self._loaded: dict[str, DataFrame] = {}

    @classmethod
    def from_folder(cls, spark, folder, names, constraints=None, format="parquet", suffix=None):
        """One file or folder per table below ``folder``."""
        suffix = f".{format}" if suffix is None else suffix
        sources = [TableSource(n, path=f"{folder}/{n}{suffix}", format=format) for n in names]
        return cls(spark, sources, constraints)

    @classmethod
    def from_database(cls, spark, database=None, constraints=None):
        """Every table of a session-catalog database."""
        listed = spark.catalog.listTables(database)
        sources = [
            TableSource(t.name, table=f"`{database}`.`{t.name}`" if database else f"`{t.name}`")
            for t in listed
            if not t.isTemporary
        ]
        return cls(spark, sources, constraints)

    def names(self) -> list[str]:
        """Tables to crawl: all but the catalog's own."""
        return sorted(n for n in self.sources if n not in CATALOG_TABLES)

    def load(self, name: str) -> DataFrame:
        """The table; its schema is looked up once, on first use."""
        if name not in self._loaded:
            source = self.sources[name]
            frame = source.load(self.spark)
            self._loaded[name] = materialize(frame, "staged") if source.staged else frame
        return self._loaded[name]

    def preload(self, names=None) -> None:
        """Looks up the schemas of many tables at once; a table that fails will do so on use."""

        def attempt(name: str) -> None:
            try:
                self.load(name)
            except Exception:
                pass

        with ThreadPoolExecutor(SCHEMA_LOOKUPS) as pool:
            list(pool.map(attempt, self._chosen(names)))

    def load_footers(self, name: str) -> DataFrame | None:
        """The table in a form whose counts Spark takes from file footers, if it has one.

        Only for flat tables: the counts of nested columns are not those of their rows.
        """
        source = self.sources[name]
        setting = FOOTER_SETTINGS.get(source.format)
        flat = all(isinstance(f.dataType, T.AtomicType) for f in self.load(name).schema.fields)
        if not (source.footer_counts and source.path and setting and flat):
            return None
        self.spark.conf.set(setting, "true")
        kept = self.spark.conf.get(V1_SOURCES)
        self.spark.conf.set(V1_SOURCES, "")
        try:
            return source.load(self.spark)
        finally:
            self.spark.conf.set(V1_SOURCES, kept)

    def list_tables(self) -> DataFrame:
        """The tables to crawl as rows."""
        rows = [(n,) for n in self.sources]
        own = self.spark.createDataFrame([(n,) for n in CATALOG_TABLES], TABLE_NAMES)
        listed = self.spark.createDataFrame(rows, TABLE_NAMES)
        return listed.join(own, "table_name", "left_anti")

    def column_specs(self, name: str) -> list[ColumnSpec]:
        """The columns of a table in order, with the type name it was declared with."""
        specs = []
        for ordinal, f in enumerate(self.load(name).schema.fields, 1):
            kept = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
            declared = self.sources[name].declared
            raw, default = declared.get(f.name, (kept, f.metadata.get("CURRENT_DEFAULT")))
            required = self.constraints.is_required(name, f.name)
            specs.append(
                ColumnSpec(
                    ordinal,
                    f.name,
                    f.dataType,
                    raw,
                    label_of(f.dataType, raw),
                    f.nullable and not required,
                    default,
                )
            )
        return specs

    def raw_columns(self, names=None) -> DataFrame:
        """What the schemas say, one row per column."""
        rows = [
            (name, c.ordinal, c.name, c.raw_type, c.nullable, c.default)
            for name in self._chosen(names)
            for c in self.column_specs(name)
        ]
        return self.spark.createDataFrame(rows, RAW_COLUMNS)

    def raw_foreign_keys(self, names=None) -> DataFrame:
        wanted = set(self._chosen(names))
        rows, seen = [], {}
        for fk in self.constraints.foreign_keys:
            if fk.table in wanted:
                seen[fk.table] = seen.get(fk.table, 0) + 1
                referred = list(fk.referred_columns)
                rows.append((fk.table, seen[fk.table], list(fk.columns), fk.references, referred))
        return self.spark.createDataFrame(rows, RAW_FOREIGN_KEYS)

    def primary_key(self, name: str) -> list[str]:
        """The key columns of a table as its schema spells them; one that is absent is an error.

        Names are compared as Spark does: in any case unless ``spark.sql.caseSensitive`` is set.
        """
        columns = [c.name for c in self.column_specs(name)]
        strict = self.spark.conf.get("spark.sql.caseSensitive") == "true"
        found = []
        for key in self.constraints.primary_key(name):
            like = [c for c in columns if not strict and c.lower() == key.lower()]
            if key in columns:
                found.append(key)
            elif len(like) == 1:
                found.append(like[0])
            else:
                raise ValueError(f"table {name} has no single key column {key}")
        return found

    def primary_keys(self, names=None) -> DataFrame:
        rows = [
            (name, column, position)
            for name in self._chosen(names)
            for position, column in enumerate(self.primary_key(name), 1)
        ]
        return self.spark.createDataFrame(rows, PRIMARY_KEYS)

    def has_files(self, name: str) -> bool:
        """Whether a table is read from files that its rows can be told by."""
        source = self.sources[name]
        return bool(source.path) and source.frame is None and not source.staged

    def manifest(self, names=None) -> DataFrame:
        """(table_name, file, bytes, modified) of the tables' files, written aside.

        Folders are listed by Spark, in tasks where there are many, and no file is opened. Tables
        that have no files of their own have no rows.
        """
        frames = [self.spark.createDataFrame([], MANIFEST)]
        for name in self._chosen(names):
            source = self.sources[name]
            path = self._location(source.table) if source.table else source.path
            if path:
                reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                frames.append(self._files(name, reader.load(path)))
            elif source.table:
                files = self._files_of_rows(name)
                frames += [files] if files is not None else []
        # A file is a row here, whatever its size: as many tasks as cores are enough.
        kept = self.spark.conf.get(SPLIT_BYTES)
        self.spark.conf.set(SPLIT_BYTES, "1t")
        try:
            return materialize(reduce(DataFrame.unionByName, frames), "manifest")
        finally:
            self.spark.conf.set(SPLIT_BYTES, kept)

    def _files(self, name: str, frame: DataFrame) -> DataFrame:
        return frame.select(
            F.lit(name).alias("table_name"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )

    def _location(self, table: str) -> str | None:
        """The folder of a session table; None for a view."""
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
        # Columns come first and may have any name.
        found = [r["data_type"] for r in described.collect() if r["col_name"] == "Location"]
        return found[-1] if found and ":" in found[-1] else None

    def _files_of_rows(self, name: str) -> DataFrame | None:
        """The files that the rows of a view come from; None where there are no files."""
        try:
            return self._files(name, self.load(name)).distinct()
        except AnalysisException:
            return None

    def table_sizes(self, names=None, manifest: DataFrame | None = None) -> DataFrame:
        """Bytes on disk per table; 0 where a source has no files of its own."""
        names = self._chosen(names)
        manifest = self.manifest(names) if manifest is None else manifest
        known = manifest.groupBy("table_name").agg(F.sum("bytes").alias("found"))
        listed = self.spark.createDataFrame([(n,) for n in names], TABLE_NAMES)
        total = F.coalesce("found", F.lit(0)).cast("long").alias("table_size_bytes")
        return listed.join(known, "table_name", "left").select("table_name", total)

    def _chosen(self, names) -> list[str]:
        return self.names() if names is None else list(names)
