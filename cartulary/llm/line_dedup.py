"""Dropping lines that many documents share, with Spark expressions only.

Documents are exploded into lines, lines are compared by a normalised key, and the text of a
document is put together again from the stretches between the positions that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import WHITE, written

#: Columns that the operator adds.
COUNTS = ("n_lines", "n_dropped")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space (ASCII) at its ends and with A-Z in lower case.

    ``lower`` is the faster way where every character is a byte; elsewhere it would also touch
    letters outside A-Z.
    """
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(
        F.octet_length(bare) == F.char_length(bare), F.lower(bare)
    ).otherwise(F.translate(bare, UPPER, LOWER))


def _keyed(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """A row per line that is long enough: document, position, and 96 bits of its key's hash."""
    lines = docs.select(
        F.struct(F.col(id_column)).alias("doc"),
        F.xxhash64(F.col(text_column)).alias("body"),
        F.posexplode(_lines(F.col(text_column))).alias("pos", "line"),
    )
    # A key has no more characters than its line has bytes.
    keys = lines.where(F.octet_length("line") >= min_chars).select(
        "doc", "body", "pos", line_key(F.col("line")).alias("key")
    )
    return keys.where(F.char_length("key") >= min_chars).select(
        "doc", "body", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g")
    )


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer if documents have a column of that name themselves."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_shared_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_documents: int = 3,
    min_chars: int = 20,
) -> DataFrame:
    """All columns of ``docs``, its text without shared lines, and ``n_lines``, ``n_dropped``.

    A line's key that has ``min_chars`` characters and stands in ``min_documents`` documents
    loses all its lines, except those in the holder with the largest id. Shorter lines always
    stay. A null or empty text is one empty line. Rows that repeat an id count as one holder; a
    null id is a holder of its own, below all others. Columns of ``docs`` named like the two new
    ones are replaced. An empty table gives an empty table.

    A key in a third of all documents costs one row per task: holders are counted from partial
    counts, and the join that marks positions has unique keys on one side, so Spark splits it.
    """
    keyed = _keyed(docs, id_column, text_column, min_chars)
    holders = keyed.groupBy("h", "g").agg(
        F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")
    )
    shared = written(
        holders.where(F.col("n") >= min_documents).select("h", "g", "keeper"), "shared-lines"
    )
    gone = (
        keyed.join(shared, ["h", "g"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc", "body")
        .agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
        .select(F.col("doc")[id_column].alias("__id"), F.col("body").alias("__body"), "__gone")
    )
    kept = docs.drop(*COUNTS)
    lines = _free(kept, "__lines")
    marked = kept.join(
        gone,
        docs[id_column].eqNullSafe(gone["__id"])
        & (F.xxhash64(docs[text_column]) == gone["__body"]),
        "left",
    )
    # A column of its own, or a text would be split again for each line that it loses.
    marked = marked.withColumn(lines, _lines(F.col(text_column)))
    lines = F.col(lines)
    starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda p: p + 1))
    stops = F.concat(F.col("__gone"), F.array(F.size(lines)))
    stretches = F.flatten(
        F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    )
    return marked.select(
        *[
            F.when(F.col("__gone").isNull(), F.coalesce(F.col(c), F.lit("")))
            .otherwise(F.array_join(stretches, "\n"))
            .alias(c)
            if c == text_column
            else F.col(c)
            for c in docs.columns
            if c not in COUNTS
        ],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
