"""What the operators share: slices of bounded size, words, hashes, scratch tables."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cartulary.session import materialize

# Text that one step in Python holds at a time. A single longer text makes a slice of its own.
SLICE_BYTES = 4 << 20

WHITE = " \t\n\v\f\r"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The driver's garbage is collected afterwards: that is when Spark drops the shuffle files of
    jobs nothing refers to any more, so a chain of steps needs the disk of its largest step only.
    """
    staged = materialize(df, label)
    del df
    gc.collect()
    staged.sparkSession.sparkContext._jvm.System.gc()
    return staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, another one for each salt."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN * np.uint64(2 * salt + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def offsets(counts: list[int] | np.ndarray) -> np.ndarray:
    """Where each of several adjacent runs starts, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int64)


def spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of the given lengths."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each document, and how many each document has.

    ``bounds`` are the documents' offsets in ``words``. A document of fewer words, but at least
    one, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.repeat(bounds[:-1], number) + spread(number)
    ends = np.repeat(bounds[1:], number)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < ends
        word = np.where(inside, words[np.minimum(first + k, max(len(words) - 1, 0))], np.uint64(0))
        out = mix(out ^ word, k + 1)
    return out, number


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's longs, bit by bit."""
    return pa.array(x.view(np.int64))
