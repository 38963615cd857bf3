"""Near duplicates by SimHash: fingerprints cut into blocks, joined on blocks, verified by distance.

Two fingerprints that differ in few bits agree in most of their blocks. So each distinct
fingerprint is entered once under every choice of blocks that a close one has to share with it,
fingerprints are joined on these keys, and the Hamming distance of the pairs is computed. Where
very many share a key their pairs are not made: each is entered under the points around it
instead, and fingerprints that meet at a point are close to each other by construction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import offsets, signed, slices, utf8, written
from cartulary.llm.components import components

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Blocks of a fingerprint beyond the radius. With more, keys are longer and buckets smaller.
SPARE_BLOCKS = 3
#: Fingerprints in a bucket whose pairs are compared; larger buckets go by neighbouring points.
BUCKET = 32
# Text whose shingles are hashed at a time, and shingles whose bits are counted at a time.
HASHED_BYTES, COUNTED = 1 << 20, 1 << 17

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut at white space into parts of about ``limit`` bytes; words stay whole."""
    start = 0
    while len(text) - start > limit:
        gap = _WHITE.search(text, start + limit)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.end()
    yield text[start:]


def shingle_digests(text: bytes, size: int = SHINGLE, limit: int = HASHED_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words, repeats included, part by part.

    Fewer words make one shingle, no words none.
    """
    digest, carried, some = xxhash.xxh64_intdigest, [], False
    for part in _parts(text, limit):
        words = carried + part.translate(_LOWER).split()
        if len(words) >= size:
            runs = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
            yield np.fromiter(map(digest, runs, repeat(SEED)), np.uint64, len(words) - size + 1)
            some = True
        carried = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if carried and not some:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def majority(digests: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text the number whose bits are those set in over half of the text's digests.

    ``bounds`` are the texts' offsets in ``digests``; a text without digests has zero.
    """
    ones = np.zeros((len(bounds) - 1, BITS), np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for start in range(0, len(digests), COUNTED):
        part, whose = digests[start : start + COUNTED], owner[start : start + COUNTED]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
        ones[whose[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    most = 2 * ones > np.diff(bounds)[:, None]
    return np.packbits(most, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def text_fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    found = [list(shingle_digests(t, size)) for t in texts]
    counts = [sum(map(len, parts)) for parts in found]
    digests = [d for parts in found for d in parts]
    return majority(np.concatenate(digests) if digests else np.zeros(0, np.uint64), offsets(counts))


def fingerprints(docs: DataFrame, id_column: str, text_column: str, size: int = SHINGLE) -> DataFrame:
    """``doc`` and ``print`` (a long with the fingerprint's bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", HASHED_BYTES):
            prints = text_fingerprints(utf8(part.column("text")), size)
            yield pa.RecordBatch.from_arrays([part.column("doc"), signed(prints)], names=["doc", "print"])

    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "doc long, print long")


def _long(bits: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def key_masks(radius: int, spare: int = SPARE_BLOCKS) -> list[int]:
    """Masks of all choices of ``spare`` out of ``radius + spare`` blocks.

    ``radius`` differing bits touch at most that many blocks, so two fingerprints that close agree
    under at least one of the masks.
    """
    edges = [BITS * k // (radius + spare) for k in range(radius + spare + 1)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(blocks, spare)]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _by_pairs(held: DataFrame, radius: int) -> DataFrame:
    """Links of small buckets: the pairs that share a key, with their distance verified."""
    side = held.select("table", "key", F.col("print").alias("a"))
    other = held.select("table", "key", F.col("print").alias("b"))
    near = side.join(other, ["table", "key"]).where("a < b").where(_distance("a", "b") <= radius)
    return near.select("a", "b")


def _by_points(held: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links of large buckets: fingerprints that meet at a point half the radius away.

    Two fingerprints at an even distance up to ``radius`` or below it have such a point in common,
    and all that meet at one are within ``radius`` of each other. A fingerprint has a bounded
    number of points and a point a bounded number of fingerprints, whatever the bucket's size.
    Bits under the mask are equal within a bucket and stay as they are.
    """
    flips = []
    for mask in masks:
        free = [1 << k for k in range(BITS) if not mask >> k & 1]
        chosen = [sum(c) for n in range(radius // 2 + 1) for c in combinations(free, n)]
        flips.append([_long(c) for c in chosen])
    all_flips = F.array(*(F.array(*map(F.lit, f)) for f in flips))
    points = held.select("print", F.explode(F.element_at(all_flips, F.col("table") + 1)).alias("flip"))
    met = points.groupBy(F.col("print").bitwiseXOR(F.col("flip")).alias("point")).agg(
        F.collect_set("print").alias("prints")
    )
    links = met.where(F.size("prints") > 1).select(
        F.explode("prints").alias("a"), F.array_min("prints").alias("b")
    )
    return links.where("a != b").where(_distance("a", "b") <= radius)


def close_prints(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE_BLOCKS) -> DataFrame:
    """Links between distinct fingerprints (column ``print``): ``a`` and ``b``, each verified.

    Fingerprints within ``radius`` bits are linked directly or through others that are, so links
    lead from each to all it is to be linked with. ``radius`` is even.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    masks = key_masks(radius, spare)
    keys = F.array(*(F.col("print").bitwiseAND(F.lit(_long(m))) for m in masks))
    entered = prints.select("print", F.posexplode(keys).alias("table", "key"))
    sizes = entered.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = written(entered.join(sizes, ["table", "key"]), "buckets")
    pairs = _by_pairs(held.where(F.col("n") <= BUCKET), radius)
    points = _by_points(held.where(F.col("n") > BUCKET), masks, radius)
    return pairs.unionByName(points).distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. A bit of the fingerprint
    is 1 if it is set in over half of the XXH64 (seed 42) of the text's runs of ``shingle`` words,
    repeats included. Fewer words make one run. Fingerprints that differ in ``radius`` bits at
    most are linked; ``component_id`` is the least id that links lead to, a row's own included.
    No link is missed and no bucket capped.

    A text without words and a null text have fingerprint zero, which is linked like any other.
    Each row gives a row, also if it repeats another or only its id. Ids are whole numbers; a null
    id is never the least, and the component of rows without any id has none. Other columns are
    left out, so their names do not matter. No rows give none.
    """
    printed = written(fingerprints(docs, id_column, text_column, shingle), "prints")
    firsts = written(printed.groupBy("print").agg(F.min("doc").alias("first")), "firsts")
    roots = components(close_prints(firsts.select("print"), radius))
    joined = written(roots.join(firsts, F.col("node") == F.col("print")).select("print", "root", "first"), "roots")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    leads = joined.join(least, "root").select("print", "least")
    ends = firsts.join(leads, "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    return printed.join(ends, "print").select(
        F.col("doc").alias(id_column),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
