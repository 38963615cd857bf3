"""A query per operator: its whole table, production settings, its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import (
    bpe,
    chat,
    decontamination,
    extraction,
    hard_negatives,
    infilling,
    jaccard,
    language,
    line_dedup,
    recompression,
    simhash,
    warc,
    winnowing,
)
from cartulary.llm.common import table

#: Folder of the public vocabularies; the same on every machine.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
MULTILINGUAL = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def _sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = extraction.extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))
    return texts.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return recompression.drop_repeats(table(spark, folder, "documents")).drop("kept")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(language.is_training(F.col("doc_id"))), MULTILINGUAL)
    found = language.identify(docs.select("doc_id", "text"), model)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, BYTE_BPE)
    return coded.select("doc_id", *bpe.digests(coded))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    followed = winnowing.with_next(table(spark, folder, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    printed = winnowing.fingerprints(
        followed.select("doc_id", "text", edited.alias("edited"), "next_text"),
        {"text": "fingerprint", "edited": "edited_fingerprint"},
        {"near_edited": ("text", "edited"), "near_next": ("text", "next_text")},
    )
    return printed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        _sha256(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


#: The conversation that every run formats besides the table's.
CONTROL_TURNS = tuple((-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant")))


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, given.schema)
    chats = chat.format_chats(given.unionByName(extra))
    read = chats.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        _sha256(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(warc.record_rows(table(spark, folder, "pages")))
    return warc.read_records(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_items(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op11_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = infilling.fill_in_middle(table(spark, folder, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        _sha256(F.col("output")).alias("output_sha256"),
        _sha256(infilling.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(given.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negative_mining": op13_hard_negative_mining,
}
