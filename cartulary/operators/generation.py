"""Cached batch generation: each prompt that the cache lacks is answered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.vocabulary import MAX_LENGTHS
from cartulary.session import materialize, written_small
from cartulary.sources.cache import (
    ResponseCache,
    cache_entries,
    look_up,
    merge_entries,
    misses,
    prompt_key,
)

PROMPTS_PER_TASK = 1_000

# Called once per task; returns the function that answers a batch of prompts, given their
# maximum lengths.
GeneratorFactory = Callable[[], Callable[[list[str], list[int]], list[str]]]


def generate(
    missing: DataFrame, make_generator: GeneratorFactory, partitions: int | None = None
) -> DataFrame:
    """(prompt, response) for every prompt; responses lose white space at both ends.

    Answers are slow next to everything else here. So the prompts are written aside and counted,
    then spread over all cores, in tasks small enough that a lost one does not cost much. The
    generator is made once per task, in the task.
    """
    default_length = MAX_LENGTHS["default"]

    def answer(batches):
        respond = make_generator()
        for batch in batches:
            lengths = batch["max_length"].fillna(default_length).astype(int)
            texts = respond(batch["prompt"].tolist(), lengths.tolist())
            yield batch[["prompt"]].assign(response=[(text or "").strip() for text in texts])

    asked = materialize(missing.select("key", "prompt", "max_length"), "prompts")
    total, cores = asked.count(), missing.sparkSession.sparkContext.defaultParallelism
    count = partitions or max(1, min(total, cores), -(-total // PROMPTS_PER_TASK))
    spread = asked.repartition(count, "key")
    return spread.mapInPandas(answer, "prompt string, response string")


def answer_from(
    prompts: DataFrame, cache: DataFrame, make_generator: GeneratorFactory, cached_at=None
) -> tuple[DataFrame, DataFrame]:
    """(prompts with key and response, the cache with the new entries).

    The new entries are written aside before anything joins them, so that the generator runs
    once for each of them however often the results are read.
    """
    answered = generate(misses(prompts, cache), make_generator)
    entries = materialize(cache_entries(answered, cached_at), "responses")
    merged = merge_entries(cache, entries)
    return look_up(prompts, merged), merged


def answer_with(
    prompts: DataFrame, cache: ResponseCache, make_generator: GeneratorFactory
) -> DataFrame:
    """Prompts with key and response; new responses are saved to the cache first.

    The cache is asked once, for the keys at hand. Of prompts that it knows no text moves. What
    a failed run had answered is not asked again, task by task.
    """
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    known = cache.answers(keyed).where("response <> ''").select("key", "response")
    known = materialize(known, "known")
    missing = misses(keyed.join(_unknown(keyed, known), "key", "left_semi").drop("key"), known)
    saved = cache.save_by_task(cache_entries(generate(missing, make_generator)))
    return look_up(prompts, known.unionByName(saved.select("key", "response")))


def _unknown(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """The keys that have no answer yet, counted so that a few of them go to the prompts."""
    keys = keyed.select("key").distinct().join(known.select("key"), "key", "left_anti")
    return written_small(keys, "unknown")


def with_max_length(prompts: DataFrame, kind: str) -> DataFrame:
    return prompts.withColumn("max_length", F.lit(MAX_LENGTHS[kind]))
