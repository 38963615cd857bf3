"""Facts per file, kept between crawls: only new and changed files are read again.

The measures of a table are kept for each of its files in a form that can be united: counts, sums,
least and greatest values, and the states of sketches. The facts of a table are those of the
files it has now. Files that vanished, or that changed since, have no part in them.
"""

from __future__ import annotations

import hashlib
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.expressions import tick
from cartulary.operators import stats
from cartulary.operators.stats import TablePlan
from cartulary.session import children, materialize

# What tells a file that was read from what is there now.
FILE = ["file", "bytes", "modified"]


def measures(plan: TablePlan) -> list[tuple[str, str, str]]:
    """(name, SQL over the rows of a file, SQL over the files) of each measure of a table."""
    found = [("n", "count(1)", "sum(n)")]
    for i, c in enumerate(plan.columns):
        value = tick(c.name)
        found.append((f"filled{i}", f"count({value})", f"sum(filled{i})"))
        sketch = stats.distinct_sketch(plan, c)
        found.append((f"sketch{i}", sketch, f"hll_union_agg(sketch{i})"))
        if stats.tracks_top(plan, c):
            combined = f"approx_top_k_combine(tops{i}, {stats.TRACKED})"
            found.append((f"tops{i}", stats.top_sketch(c), combined))
        if stats.is_numeric(c):
            # The sums that a mean is made of: exact for decimals, in doubles for all others.
            exact = c.dtype.typeName() == "decimal"
            total = f"sum({value})" if exact else f"sum(CAST({value} AS DOUBLE))"
            found += [(f"{f}{i}", f"{f}({value})", f"{f}({f}{i})") for f in ("min", "max")]
            found.append((f"sum{i}", total, f"sum(sum{i})"))
    stamp = stats.freshness_column(plan.columns)
    if stamp is not None:
        found.append(("latest", f"max({tick(stamp.name)})", "max(latest)"))
    for i, (_, _, broken) in enumerate(stats.rules_for(plan.columns)):
        found.append((f"issues{i}", f"count_if({broken})", f"sum(issues{i})"))
    return found


def _facts(plan: TablePlan, states: DataFrame) -> DataFrame:
    """The facts of a table from the states of its files."""
    row = states.selectExpr(*(f"{merged} AS {name}" for name, _, merged in measures(plan)))
    names = [name for name, _, _ in measures(plan)]
    counts = [n for n in names if n == "n" or n.startswith(("filled", "issues"))]
    made = [f"coalesce({n}, 0) AS {n}" if n in counts else n for n in names]
    for i, c in enumerate(plan.columns):
        made.append(f"hll_sketch_estimate(sketch{i}) AS approx{i}")
        if f"tops{i}" in names:
            made.append(f"approx_top_k_estimate(tops{i}, {stats.COMPARED}) AS top{i}")
        if f"sum{i}" in names:
            made.append(f"try_divide(sum{i}, filled{i}) AS avg{i}")
    return stats.shape_facts(plan, row.selectExpr(*made), True, True, True)


class FileStates:
    """A folder with the measures of files and the repeated keys of tables.

    Each table has a folder per signature of its plan (columns, types, rules), so a table whose
    schema changes starts anew. Crawls only add to it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, plan: TablePlan, part: str) -> str:
        told = repr((measures(plan), [(c.name, c.raw_type) for c in plan.columns], plan.primary_key))
        signature = hashlib.md5(told.encode()).hexdigest()
        return f"{self.path}/{quote(plan.name, safe='')}/{signature}/{part}"

    def _read(self, folder: str) -> DataFrame | None:
        if not any(name.startswith("part-") for name in children(self.spark, folder)):
            return None
        return self.spark.read.parquet(folder)

    def facts(self, plan: TablePlan, manifest: DataFrame) -> DataFrame:
        """The facts of a table whose files the manifest lists; reads those it does not know.

        What reaches the driver are the names of the files to read, which Spark's own list of a
        table's files holds, too.
        """
        folder = self._folder(plan, "files")
        here = manifest.where(F.col("table_name") == plan.name).select(FILE)
        known = self._read(folder)
        new = here if known is None else here.join(known.select(FILE), FILE, "left_anti")
        names = [r["file"] for r in new.select("file").collect()]
        if names:
            file, rows = F.col("_metadata.file_path"), plan.frame
            if known is not None:
                rows = rows.where(file.isin(names))
            sums = [F.expr(sql).alias(name) for name, sql, _ in measures(plan)]
            counted = rows.groupBy(file.alias("file")).agg(*sums)
            # A file without rows gets a row, too, or it would be read each time.
            new.join(counted, "file", "left").write.mode("append").parquet(folder)
        known = self._read(folder)
        if known is not None:
            # Two crawls at a time may both have read a file. Files without rows add nothing.
            current = known.join(here, FILE, "left_semi").dropDuplicates(["file"]).where("n > 0")
            if not current.isEmpty():
                return _facts(plan, current)
        # No file has rows, so there is nothing to read.
        return stats.table_facts(plan, approx_distinct=True, approx_top=True)

    def repeated_keys(self, plans: list[TablePlan], manifest: DataFrame) -> DataFrame:
        """Repeated keys of each table; only tables whose files changed are read, and their keys only."""
        keyed = [p for p in plans if p.primary_key]
        prints = F.sum(F.xxhash64(*FILE).cast("decimal(38,0)")).cast("string").alias("print")
        found = manifest.groupBy("table_name").agg(F.count(F.lit(1)).alias("files"), prints).collect()
        prints = {r["table_name"]: f"{r['files']}/{r['print']}" for r in found}
        parts, changed = [], []
        for plan in keyed:
            known = self._read(self._folder(plan, "keys")) if plan.name in prints else None
            if known is not None:
                known = known.where(F.col("print") == prints[plan.name])
            if known is None or known.isEmpty():
                changed.append(plan)
            else:
                parts.append(known.select("table_name", "duplicate_count").limit(1))
        if changed:
            fresh = materialize(stats.repeated_keys(changed), "repeated")
            for plan in changed:
                if plan.name in prints:
                    row = fresh.where(F.col("table_name") == plan.name)
                    row = row.withColumn("print", F.lit(prints[plan.name]))
                    row.write.mode("append").parquet(self._folder(plan, "keys"))
            parts.append(fresh)
        if not parts:
            return self.spark.createDataFrame([], stats.REPEATED)
        return stats.union_all(parts)
