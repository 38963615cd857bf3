"""Near duplicates: an n-gram Jaccard join by MinHash banding.

Texts with the same set of word runs are one class from the start, so copies cost a row each.
Band hashes of the classes' MinHash signatures are shuffled; classes that share one are
candidates. Candidates are gathered into groups and compared on their full sets, block against
block inside a task, so the pairs themselves never become rows: a task gives each class the
number of its links, and as many links as keep it connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import WHITE, hashes, mix, offsets, shingle_hashes, slices, utf8, written
from cartulary.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Share of pairs at the threshold that have to become candidates.
RECALL = 0.9995
MAX_HASHES = 160
# Text whose signatures are computed at a time: its shingles fit in a core's cache.
SIGNED_BYTES = 1 << 20
# Classes of a group in one block; two blocks are compared in one task.
BLOCK = 256


def bands_and_rows(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows per band, and with them the fewest bands, that reach the recall.

    A pair of similarity s shares a band of r rows with probability s**r.
    """
    found = (most, 1)
    for rows in range(1, most + 1):
        if threshold >= 1:
            return 1, most
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows > most:
            break
        found = (bands, rows)
    return found


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document in a row, and where each document starts."""
    found = [t.split() for t in utf8(part.column("text"))]
    words = hashes([w for ws in found for w in ws])
    shingles, number = shingle_hashes(words, offsets([len(w) for w in found]), size)
    document = np.repeat(np.arange(len(found)), number)
    order = np.lexsort((shingles, document))
    shingles, document = shingles[order], document[order]
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (document[1:] != document[:-1]))
    shingles, document = shingles[new[: len(shingles)]], document[new[: len(document)]]
    return shingles, offsets(np.bincount(document, minlength=len(found)))


def _sum_up(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _signatures(size: int, bands: int, rows: int):
    factors = mix(np.arange(bands * rows, dtype=np.uint64), 77) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SIGNED_BYTES):
            shingles, bounds = _sets(part, size)
            some = np.flatnonzero(np.diff(bounds))
            counts = np.diff(bounds)[some]
            keys = np.zeros((len(some), bands), np.uint64)
            if len(some):
                starts = bounds[:-1][some]
                for band in range(bands):
                    for row in range(rows):
                        # Shingles are hashes already; a multiplier of its own orders them anew.
                        order = shingles * factors[band * rows + row]
                        least = np.minimum.reduceat(order, starts)
                        keys[:, band] = mix(keys[:, band] ^ least, row + 1)
                    keys[:, band] = mix(keys[:, band], 5000 + band)
            both = [_sum_up(mix(shingles, salt), bounds)[some] for salt in (21, 22)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc").take(pa.array(some)),
                    pa.array(both[0].view(np.int64)),
                    pa.array((both[1] ^ mix(counts.astype(np.uint64))).view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(some) + 1) * bands, pa.int32()),
                        pa.array(keys.reshape(-1).view(np.int64)),
                    ),
                ],
                names=["doc", "k1", "k2", "bands"],
            )

    return run


def _shingled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            shingles, bounds = _sets(part, size)
            packed = [shingles[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc", "root", "rank", "blocks", "copies")), pa.array(packed, pa.binary())],
                names=["doc", "root", "rank", "blocks", "copies", "set"],
            )

    return run


def similar_pairs(sets: list[np.ndarray], firsts: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with at least the similarity: the first ``firsts`` against the others, or all
    among themselves if there are no others."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    used = np.bincount(shingle)
    keep = used[shingle] > 1
    owner, shingle = owner[keep], shingle[keep]
    shared = np.zeros((firsts, len(sets)), np.float32)
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    # Dense parts of the incidence, some thousand shingles at a time.
    start = 0
    while start < len(shingle):
        base = shingle[start]
        stop = int(np.searchsorted(shingle, base + 4096))
        dense = np.zeros((len(sets), int(shingle[stop - 1] - base) + 1), np.float32)
        dense[owner[start:stop], shingle[start:stop] - base] = 1
        shared += dense[:firsts] @ dense.T
        start = stop
    likeness = shared / (sizes[:firsts, None] + sizes[None] - shared)
    a, b = np.nonzero(likeness >= np.float32(threshold) - 1e-6)
    exact = shared[a, b].astype(np.float64) / (sizes[a] + sizes[b] - shared[a, b])
    ordered = (a < b) & (exact >= threshold - 1e-12)
    if firsts < len(sets):
        ordered &= b >= firsts
    return a[ordered], b[ordered]


def _forest(a: list[int], b: list[int], n: int) -> list[tuple[int, int]]:
    """Of the links given those that join what was not yet joined."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compared(threshold: float):
    """Links inside each group of sorted rows (``task``, ``side``, ``doc``, ``copies``, ``set``).

    Yields a row per class that has links in the task: their number, copies counted, and rows of
    the links that keep the task's classes connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("task", "side", "doc", "copies", "set")]
                yield from zip(*columns, strict=True)

        held: list[list] = [[], [], []]

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["a", "b", "n"])
            for c in held:
                c.clear()
            return batch

        for _, members in groupby(rows(), key=lambda r: r[0]):
            members = [next(rows) for _, rows in groupby(members, key=lambda r: r[2])]
            docs = [m[2] for m in members]
            copies = np.array([m[3] for m in members], np.int64)
            # Sides: 0 of a block against itself, 1 and 2 of two blocks.
            firsts = sum(m[1] < 2 for m in members)
            if members[0][1] and firsts in (0, len(members)):
                continue
            sets = [np.frombuffer(m[4], np.uint64) for m in members]
            a, b = similar_pairs(sets, firsts, threshold)
            n = np.bincount(a, copies[b], len(docs)) + np.bincount(b, copies[a], len(docs))
            for i in np.flatnonzero(n).tolist():
                held[0].append(docs[i]), held[1].append(None), held[2].append(int(n[i]))
            for i, j in _forest(a.tolist(), b.tolist(), len(docs)):
                held[0].append(docs[i]), held[1].append(docs[j]), held[2].append(0)
            if len(held[0]) > 10_000:
                yield out()
        yield out()

    return run


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """Per document: id, ``class_id``, ``copy_id`` and ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of runs of ``shingle`` words
    (split at ASCII white space, unchanged) is at least ``threshold``. ``n_links`` counts the other
    documents a document is linked to, copies included. ``class_id`` is the least id among all
    that links lead to, ``copy_id`` the least id among those with an equal set.

    Every link reported is verified on the full sets; a link at the threshold is found with
    probability ``recall``, a closer one with a higher one. No bucket, group or number of partners
    is capped. A text of fewer words is one run; texts without words, and null texts, are linked
    to nothing and form classes of their own. Ids are whole numbers; rows that repeat an id are
    copies if their texts are equal, and each gives a row; a null id gives a row without a class.
    """
    bands, rows = bands_and_rows(threshold, recall)
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    known = source.where("doc is not null and text is not null")
    signed = written(
        known.mapInArrow(
            _signatures(shingle, bands, rows), "doc long, k1 long, k2 long, bands array<long>"
        ),
        "signatures",
    )
    classes = written(
        signed.groupBy("k1", "k2").agg(F.min("doc").alias("copy"), F.count("*").alias("copies")),
        "classes",
    )
    member = signed.select("doc", "k1", "k2").join(classes, ["k1", "k2"]).select("doc", "copy", "copies")
    # One row of each class stands for it.
    ones = signed.join(
        classes.select("k1", "k2", F.col("copy").alias("doc"), "copies"), ["k1", "k2", "doc"], "left_semi"
    ).dropDuplicates(["k1", "k2"])
    banded = ones.select("doc", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1")
    candidates = banded.join(buckets, "key").where("doc != least").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    groups = written(components(candidates), "groups")
    links = written(_links(known, groups, classes, shingle, threshold), "links")
    counts = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(links.where("b is not null").select("a", "b"))
    # Classes of equal ids differ only if rows repeat an id with another text.
    described = (
        member.join(counts.withColumnRenamed("a", "copy"), "copy", "left")
        .join(joined.withColumnRenamed("node", "copy"), "copy", "left")
        .select(
            "doc",
            F.coalesce("root", "copy").alias("class_id"),
            F.col("copy").alias("copy_id"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        )
    )
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    wordless = source.where(F.col("doc").isNull() | (bare == ""))
    alone = wordless.select(
        "doc", F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), F.lit(0).cast("long").alias("n_links")
    )
    return described.unionByName(alone).withColumnRenamed("doc", id_column)


def _links(known: DataFrame, groups: DataFrame, classes: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links between classes of a group: counts per class, and enough links to connect them.

    A group's classes are dealt into blocks by a hash, about ``BLOCK`` in each, and each pair of
    blocks is a task. So a class is sent as often as its group has blocks, once for nearly all.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    placed = (
        groups.join(sizes, "root")
        .select(
            F.col("node").alias("doc"),
            "root",
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        )
        .withColumn("rank", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        .join(classes.select(F.col("copy").alias("doc"), "copies"), "doc")
        .dropDuplicates(["doc"])
    )
    texts = known.join(written(placed, "placed"), "doc")
    sets = texts.select("doc", "root", "rank", "blocks", "copies", "text").mapInArrow(
        _shingled(shingle), "doc long, root long, rank int, blocks int, copies long, set binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = sets.select("*", other.alias("other")).select(
        F.struct("root", F.least("rank", "other").alias("x"), F.greatest("rank", "other").alias("y")).alias("task"),
        F.when(F.col("rank") == F.col("other"), 0).when(F.col("rank") < F.col("other"), 1).otherwise(2).alias("side"),
        "doc",
        "copies",
        "set",
    )
    keyed = tasks.select(F.xxhash64("task.root", "task.x", "task.y").alias("task"), "side", "doc", "copies", "set")
    return (
        keyed.repartition("task").sortWithinPartitions("task", "side", "doc").mapInArrow(_compared(threshold), "a long, b long, n long")
    )
