"""Generated responses kept by the digest of their prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.vocabulary import PREVIEW_CHARS
from cartulary.session import children, delete, exists, make_folder, materialize, stamped_name

CACHE_SCHEMA = "key string, response string, cached_at timestamp, prompt_preview string"
# Spark does not list folders of such names, so unfinished answers are not read as entries.
JOURNAL = "_journal"


def prompt_key(prompt):
    """MD5 of the prompt's UTF-8 bytes as hex."""
    return F.md5(prompt)


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CACHE_SCHEMA)


def cache_entries(answered: DataFrame, cached_at=None) -> DataFrame:
    """Entries from (prompt, response); the preview ends in dots whatever its length."""
    return answered.select(
        prompt_key(F.col("prompt")).alias("key"),
        "response",
        (F.current_timestamp() if cached_at is None else cached_at).alias("cached_at"),
        F.concat(F.substring("prompt", 1, PREVIEW_CHARS), F.lit("...")).alias("prompt_preview"),
    )


def merge_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries with new ones put in their place by key."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def look_up(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts with the response the cache holds for them, null where it holds none."""
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    return keyed.join(cache.select("key", "response"), "key", "left")


def misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Each prompt once that still needs a response; an empty response does not count as one.

    Copies of a prompt collapse before the shuffle, so a prompt that a third of the rows share
    is sent once per task. That shuffle by key is the only one a prompt's text passes: the keys
    of the cache come to it.
    """
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    limit = F.col("max_length") if "max_length" in prompts.columns else F.lit(None).cast("int")
    once = keyed.groupBy("key").agg(
        F.min("prompt").alias("prompt"), F.max(limit).alias("max_length")
    )
    answered = cache.where("response <> ''").select("key")
    return once.join(answered, "key", "left_anti")


def cache_size(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count_distinct("key").alias("total_cached"))


def newest(entries: DataFrame) -> DataFrame:
    """Of several entries for a key the one saved last."""
    entry = F.struct("cached_at", "response", "prompt_preview")
    latest = entries.groupBy("key").agg(F.max(entry).alias("entry"))
    return latest.select("key", "entry.response", "entry.cached_at", "entry.prompt_preview")


class ResponseCache:
    """A folder of entries that runs add to, in buckets of the first digits of the key.

    Each save is a batch: a file per bucket, sorted by key, with a Bloom filter of its keys where
    the format has them (Parquet). So a lookup opens the buckets of its keys only, saving costs as
    much as there is to save, and writers do not disturb each other. Of several entries for a key
    the latest counts; where a bucket has more than one batch they are compared when it is read.

    Answers go to a journal first, task by task as they are finished. If a run fails, the next one
    finds there what was answered. ``digits`` has to stay the same for a folder.
    """

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet", digits: int = 1):
        self.spark = spark
        self.path = path.rstrip("/")
        self.format = format
        self.digits = digits

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def _bucket(self) -> Column:
        return F.substring("key", 1, self.digits)

    def batches(self, buckets: set[str] | None = None) -> dict[str, list[str]]:
        """The batches of each bucket, from the names of the folders."""
        named = (n.removeprefix("bucket=") for n in children(self.spark, self.path) if n.startswith("bucket="))
        found = {}
        for bucket in named:
            if buckets is None or bucket in buckets:
                held = children(self.spark, f"{self.path}/bucket={bucket}")
                found[bucket] = [n.removeprefix("batch=") for n in held if n.startswith("batch=")]
        return {bucket: held for bucket, held in found.items() if held}

    def _rows(self, held: dict[str, list[str]]) -> DataFrame:
        """Entries in the given batches of buckets, which are all that is listed and opened."""
        if not held:
            return empty_cache(self.spark)
        folders = [f"{self.path}/bucket={b}/batch={n}" for b, names in held.items() for n in names]
        return self.spark.read.format(self.format).schema(CACHE_SCHEMA).load(folders)

    def load(self) -> DataFrame:
        """The current entries; none where nothing was saved yet.

        Only buckets with several batches are compared, the others are read as they lie.
        """
        return self._current(self.batches())

    def _current(self, held: dict[str, list[str]]) -> DataFrame:
        single = {b: names for b, names in held.items() if len(names) == 1}
        several = {b: names for b, names in held.items() if len(names) > 1}
        rows = self._rows(single)
        return rows.unionByName(newest(self._rows(several))) if several else rows

    def answers(self, keys: DataFrame) -> DataFrame:
        """The entries for the keys in column ``key``, among them those of runs that failed.

        What reaches the driver are the buckets of the keys. Entries of other keys are dropped
        before any are compared.
        """
        keys = keys.select("key").distinct()
        buckets = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        rows = self._rows(self.batches(buckets))
        left = self.journal()
        if left is not None:
            rows = rows.unionByName(left)
        return newest(rows.join(keys, "key", "left_semi"))

    def save(self, entries: DataFrame) -> DataFrame:
        """Adds entries as a batch; returns what was saved."""
        batch = stamped_name()
        placed = entries.select(*empty_cache(self.spark).columns, self._bucket().alias("bucket"))
        placed = placed.withColumn("batch", F.lit(batch)).repartition("bucket")
        writer = placed.sortWithinPartitions("bucket", "key").write.format(self.format)
        writer = writer.partitionBy("bucket", "batch").mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.option("parquet.bloom.filter.enabled#key", "true").save(self.path)
        saved = {b: [batch] for b, names in self.batches().items() if batch in names}
        return self._rows(saved)

    def _journals(self) -> list[str]:
        folder = f"{self.path}/{JOURNAL}"
        return [f"{folder}/{name}" for name in children(self.spark, folder)]

    def journal(self) -> DataFrame | None:
        """The answers of runs that have not been saved: failed ones, or still at work."""
        found = [f for f in self._journals() if any(n.startswith("part-") for n in children(self.spark, f))]
        return self.spark.read.schema(CACHE_SCHEMA).parquet(*found) if found else None

    def save_by_task(self, entries: DataFrame) -> DataFrame:
        """Saves entries that are slow to compute; what tasks have finished outlives a failure.

        A task's file appears when the task ends, not when the job does. The whole is then saved as
        a batch and the journal deleted.
        """
        folder = f"{self.path}/{JOURNAL}/{stamped_name()}"
        writer = entries.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.parquet(folder)
        saved = self.save(self.spark.read.schema(CACHE_SCHEMA).parquet(folder))
        delete(self.spark, folder)
        return saved

    def compact(self) -> None:
        """Merges the batches of each bucket into one, and what failed runs have left.

        For times without other runs: their journals would go, and readers may have to start again.
        """
        journals = self._journals()
        left = self.journal()
        if left is not None:
            self.save(left)
        several = {b: names for b, names in self.batches().items() if len(names) > 1}
        if several:
            self.save(materialize(self._current(several), "cache"))
        for bucket, names in several.items():
            for name in names:
                delete(self.spark, f"{self.path}/bucket={bucket}/batch={name}")
        for folder in journals:
            delete(self.spark, folder)

    def clear(self) -> None:
        """Deletes all entries; the folder stays."""
        delete(self.spark, self.path)
        make_folder(self.spark, self.path)

    def stats(self) -> DataFrame:
        """Number of entries, location, and whether anything was ever saved."""
        return cache_size(self.load()).select(
            "total_cached",
            F.lit(self.path).alias("cache_path"),
            F.lit(self.exists()).alias("exists"),
        )
