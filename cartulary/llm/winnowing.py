"""Document fingerprints by winnowing.

Every ``gram`` characters are hashed; of each ``window`` adjacent hashes the smallest is kept, the
rightmost of equal ones, with its position. Two texts that share a passage of at least
``gram + window - 1`` characters therefore share a fingerprint at the same place of it: 15 with the
settings below. So a text of 29 characters or more shares one with any text that keeps its first half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import mix, offsets, slices

GRAM, WINDOW = 8, 8
# Text that is hashed at a time; a character takes some 60 bytes of memory meanwhile.
HASHED_BYTES = 1 << 20

# The base of the rolling hash and its inverse modulo 2^64 (fixed values).
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        return np.cumprod(steps, dtype=np.uint64)


def gram_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """32-bit hashes of the stretches from ``starts`` to ``stops`` of a row of code points."""
    n = len(points) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n, np.uint64)
        np.cumsum(mix(points.astype(np.uint64)) * _powers(_BASE, n)[:-1], out=sums[1:])
        rolled = (sums[stops] - sums[starts]) * _powers(_BACK, n)[starts]
    return mix(rolled) >> np.uint64(32)


def winnow(
    texts: list[str], gram: int = GRAM, window: int = WINDOW
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and positions of each text's fingerprints.

    A text shorter than ``gram`` has one, of all its characters; an empty text has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = offsets(sizes)
    grams = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    at = offsets(grams)
    total = int(at[-1])
    if not total:
        return [(np.zeros(0, np.uint32), np.zeros(0, np.uint32)) for _ in texts]
    first = np.arange(total) + np.repeat(bounds[:-1] - at[:-1], grams)
    last = np.minimum(first + gram, np.repeat(bounds[1:], grams))
    # Hash above, place below and counted down: the least is the rightmost smallest hash.
    ranked = gram_hashes(points, first, last) << np.uint64(32)
    ranked |= np.uint64(total) - np.arange(total, dtype=np.uint64)
    least, reach = ranked.copy(), 1
    while 2 * reach <= window:
        least[: total - reach] = np.minimum(least[: total - reach], least[reach:])
        reach *= 2
    rest = window - reach
    if rest and total > rest:
        least[: total - rest] = np.minimum(least[: total - rest], least[rest:])
    out = []
    for k in range(len(texts)):
        a, b = int(at[k]), int(at[k + 1])
        if b - a >= window:
            found = least[a : b - window + 1]
        else:
            found = ranked[a:b].min(keepdims=True) if b > a else ranked[a:b]
        found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
        places = total - (found & np.uint64(0xFFFFFFFF)).astype(np.int64) - a
        out.append(((found >> np.uint64(32)).astype(np.uint32), places.astype(np.uint32)))
    return out


def _printed(hashes: np.ndarray, places: np.ndarray) -> str:
    """Sixteen hexadecimal digits per fingerprint: eight of the hash, eight of the position."""
    return np.stack([hashes, places], axis=1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes among all hashes of two fingerprints, 0 to 1; 1 if both are empty."""
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def fingerprints(
    docs: DataFrame,
    columns: dict[str, str],
    alike: dict[str, tuple[str, str]] | None = None,
    gram: int = GRAM,
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with the fingerprint of each text column named in ``columns``.

    ``columns`` maps a text column to the column its fingerprint goes to, a text of sixteen
    hexadecimal digits per kept hash: eight of the hash, eight of its position. ``alike`` maps
    further columns to pairs of text columns, whose fingerprints' likeness goes there. Columns of
    those names are replaced, all others stay. A null text is empty and has an empty fingerprint.
    Memory is bounded by a slice of texts; no row moves.
    """
    alike = alike or {}
    kept = docs.drop(*columns.values(), *alike)
    fields = [T.StructField(name, T.StringType()) for name in columns.values()]
    fields += [T.StructField(name, T.DoubleType()) for name in alike]
    schema = T.StructType([*kept.schema.fields, *fields])
    sources = list(dict.fromkeys([*columns, *(c for pair in alike.values() for c in pair)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, sources[0], HASHED_BYTES):
            found = {}
            for source in sources:
                found[source] = winnow([t or "" for t in part.column(source).to_pylist()], gram, window)
            for source, target in columns.items():
                printed = pa.array([_printed(*f) for f in found[source]], pa.string())
                part = part.append_column(pa.field(target, pa.string()), printed)
            for target, (a, b) in alike.items():
                pairs = zip(found[a], found[b], strict=True)
                near = pa.array([likeness(x, y) for (x, _), (y, _) in pairs], pa.float64())
                part = part.append_column(pa.field(target, pa.float64()), near)
            yield part

    return kept.mapInArrow(run, schema)


def with_next(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    next_column: str = "next_text",
    parts: int | None = None,
) -> DataFrame:
    """The id and text of each row, and the text of the next row in ascending order of ids.

    The last row is followed by the first. Rows that repeat an id are ordered by text; null ids
    come first. Null texts become empty. Ids are whole numbers.

    Rows are dealt by ranges of ids, so texts move once. The first row of each range also goes to
    the range before it. What the driver holds is a bound and a least id per range.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    number = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(lowest)).alias("_key"),
        F.col(id_column).alias(id_column),
        F.coalesce(F.col(text_column), F.lit("")).alias(text_column),
    )
    shares = [i / number for i in range(1, number)]
    bounds = source.select(F.percentile_approx("_key", shares, 20 * number).alias("b")).first()["b"]
    edges = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def range_of(key):
        return key.map(lambda k: int(np.searchsorted(edges, k, side="left"))).astype("int32")

    least = source.groupBy(range_of("_key").alias("part")).agg(F.min("_key").alias("k")).collect()
    chain = sorted((r["k"], r["part"]) for r in least)
    # A range's least id goes, once more, to the range before; the very first to the last.
    halo = {k: chain[i - 1][1] for i, (k, _) in enumerate(chain)}

    @F.pandas_udf("array<int>")
    def parts_of(key):
        return key.map(
            lambda k: [int(np.searchsorted(edges, k, side="left"))]
            + ([halo[k] + len(edges) + 1] if k in halo else [])
        )

    dealt = source.select("*", F.explode(parts_of("_key")).alias("_to")).select(
        id_column,
        text_column,
        "_key",
        (F.col("_to") % (len(edges) + 1)).alias("_part"),
        (F.col("_to") > len(edges)).alias("_halo"),
    )
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField(text_column, T.StringType()),
            T.StructField(next_column, T.StringType()),
        ]
    )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, which waits for the next one
        for part in slices(batches, text_column):
            if held is not None:
                part = pa.concat_batches([held, part])
            held = part.slice(part.num_rows - 1)
            here, there = part.slice(0, part.num_rows - 1), part.slice(1)
            same = pc.and_(
                pc.invert(here.column("_halo")), pc.equal(here.column("_part"), there.column("_part"))
            )
            rows = pa.RecordBatch.from_arrays(
                [here.column(id_column), here.column(text_column), there.column(text_column)],
                names=[id_column, text_column, next_column],
            )
            yield rows.filter(same)

    return (
        dealt.repartition(number, "_part")
        .sortWithinPartitions("_part", "_halo", "_key", text_column)
        .drop("_key")
        .mapInArrow(follow, schema)
    )
