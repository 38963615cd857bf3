"""A training corpus from documents, in five stages.

Each stage takes (session, documents, folder of the tables) and returns a DataFrame that is
written and read again as the documents of the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import bpe, decontamination, jaccard, language, line_dedup
from cartulary.llm.common import WHITE, table, written
from cartulary.llm.queries import BYTE_BPE, MULTILINGUAL
from cartulary.session import discarding, drop_one, newest

# Documents whose likeliest language has a lower probability go.
MIN_LANGUAGE_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer if documents have a column of that name (in any case) themselves."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a language: without letters, or between languages, they go."""
    with discarding(spark):
        model = language.fit(docs.where(language.is_training(F.col("doc_id"))), MULTILINGUAL)
    lang, score = _free(docs, "lang_pred"), _free(docs, "score")
    found = language.identify(docs, model, lang_column=lang, score_column=score)
    kept = (F.col(lang) != language.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)
    return found.where(kept).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that three or more share.

    ``n_chars``, if there is such a column, is the length of what is left.
    """
    aside = {c: _free(docs, c) for c in docs.columns if c in line_dedup.COUNTS}
    kept = line_dedup.drop_shared_lines(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    own = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return kept.select(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates, that with the least id.

    Only the ids of rows that go meet the documents, which are read where they lie. Rows without an
    id, or with one that others have, are told apart by numbers of their own. So a group keeps one
    row, too, if rows repeat its least id (the first by a hash of the text) or have no id (one stays
    if all are without), and rows that repeat an id with another text are judged one by one. Texts
    without words are near nothing: of these go only rows that repeat both an id and its text;
    without an id all stay.
    """
    with discarding(spark) as keep:
        counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        odd = counted.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"))
        odd = written(odd, "odd-ids")
        if odd.isEmpty():
            rows, key = docs, "doc_id"
            classes = jaccard.near_duplicates(docs)
            gone = classes.where("class_id != doc_id").select("doc_id")
        else:
            odd, key = keep(odd), _free(docs, "row")
            rows = _told_apart(docs, odd, key, keep)
            gone = _others_of_a_group(rows, key)
        gone = keep(written(gone, "gone"))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def _told_apart(docs: DataFrame, odd: DataFrame, key: str, keep) -> DataFrame:
    """Documents with a row number each: the id, where it is one row's alone.

    The other rows are written aside with numbers above all ids, or below if there is no room.
    """
    same = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    if (most or 0) < 1 << 62:
        number = number + F.lit((most or 0) + 1)
    else:
        number = F.lit((least or 0) - 1) - number
    numbered = docs.join(odd, same, "left_semi").withColumn(key, number)
    numbered = keep(written(numbered, "numbered"))
    alone = docs.join(odd, same, "left_anti").withColumn(key, F.col("doc_id").cast("long"))
    return alone.unionByName(numbered)


def _others_of_a_group(rows: DataFrame, key: str) -> DataFrame:
    """The numbers of all rows but the first of each group."""
    classes = jaccard.near_duplicates(rows, key).select(F.col(key).alias("row"), "class_id")
    text = F.coalesce("text", F.lit(""))
    alone = (F.btrim(text, F.lit(WHITE)) == "") & F.col("doc_id").isNotNull()
    about = rows.select(
        F.col(key).alias("row"),
        "doc_id",
        F.xxhash64("text").alias("hash"),
        F.when(alone, F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256))).alias("alone"),
    )
    group = F.when(F.col("alone").isNull(), F.col("class_id")).alias("class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash", "row"))
    firsts = classes.join(about, "row").groupBy(group, "alone").agg(first.alias("first"))
    firsts = written(firsts.select("first.row"), "firsts")
    return about.select("row").join(firsts, "row", "left_anti").withColumnRenamed("row", key)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    with discarding(spark) as keep:
        found = decontamination.find_items(docs, table(spark, folder, "benchmark"))
        gone = keep(written(found.select("doc_id").distinct(), "contaminated"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "text"), BYTE_BPE)
    return coded.select("doc_id", "ids", *bpe.digests(coded))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("bpe", encode),
]

#: SQL can express neither the language model nor the fingerprints and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents in ``folder``; the rows of the last.

    Of what is written on the way only the input of the last stage stays.
    """
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        with discarding(spark) as keep:
            docs = keep(written(stage(spark, docs, folder), name))
        if before:
            drop_one(spark, before)
        before = newest()
    return STAGES[-1][1](spark, docs, folder)
