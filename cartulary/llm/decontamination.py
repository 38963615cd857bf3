"""Finding benchmark items in documents.

Windows of an item's size are slid over the places of a document that share a run of words with
an item. Their SimHashes are looked up in an index over 8-bit blocks of the items' SimHashes: two
fingerprints at most ``RADIUS`` bits apart differ in at most two bits of some block, so none
within the radius is missed. A run of words that a window repeats can carry its fingerprint out of
the radius of an item it is like, so windows become candidates, too, where enough of their runs of
words are an item's to reach the threshold. What is found is verified by the exact weighted
similarity of runs of words. A window without any run of words in common has similarity 0, so
looking only at shared places loses nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import mix, offsets, shingle_hashes, slices, spread

SHINGLE, THRESHOLD = 5, 0.8
# With eight blocks, 23 bits leave at most two for the block with the fewest.
RADIUS, BLOCKS, BLOCK_RADIUS = 23, 8, 2
# Items whose index is sent to the executors at a time; more take further passes.
ITEM_BYTES = 8 << 20
# Stretch of a document, in window starts, whose SimHashes are held at a time.
STRETCH = 1 << 13

_WORD = re.compile(r"\w+")
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def words(text: str | None) -> list[str]:
    """Words in lower case, without punctuation."""
    return _WORD.findall(text.lower()) if text else []


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 times +1 or -1 per shingle."""
    bits = np.unpackbits(mix(shingles, 99).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def window_simhashes(shingles: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """SimHashes, as rows of eight bytes, of windows of a document's shingles.

    A shingle weighs as often as it stands in the window.
    """
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(_signs(shingles), axis=0, out=sums[1:])
    return np.packbits(sums[stops] - sums[starts] > 0, axis=1)


class ItemIndex:
    """The items of one pass: their shingles, and blocks of SimHashes by window size."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE):
        self.groups: dict[tuple[int, int], dict] = {}
        owners: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        sized = defaultdict(list)
        for item, text in items:
            found = words(text)
            if found:
                k = min(shingle, len(found))
                hashes, _ = shingle_hashes(word_hashes(found), offsets([len(found)]), k)
                sized[k, len(hashes)].append((item, len(found), hashes))
        for key, members in sized.items():
            prints = np.concatenate(
                [window_simhashes(h, np.array([0]), np.array([len(h)])) for _, _, h in members]
            )
            near = _BITS[np.arange(256, dtype=np.uint8)[:, None, None] ^ prints[None]] <= BLOCK_RADIUS
            sets = [np.unique(m[2]) for m in members]
            owned = np.concatenate(sets)
            order = np.argsort(owned, kind="stable")
            self.groups[key] = {
                "items": [m[0] for m in members],
                "bags": [Counter(m[2].tolist()) for m in members],
                "sets": sets,
                # All shingles of the group in order, and the number of the item of each.
                "owned": owned[order],
                "owner": np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order],
                "prints": prints,
                "near": near.transpose(2, 0, 1).copy(),  # block, value, item
            }
            for _, _, hashes in members:
                for h in hashes.tolist():
                    owners[key[0]][h].add(key)
        #: By words in a shingle: sorted hashes, a bitmap over their low bits, and their groups.
        self.shingles = {}
        for k, by_hash in owners.items():
            known = np.array(sorted(by_hash), np.uint64)
            bitmap = np.zeros(1 << 22, bool)
            bitmap[known & np.uint64((1 << 22) - 1)] = True
            self.shingles[k] = (known, bitmap, dict(by_hash))

    def matches(
        self, document: np.ndarray, k: int, shared: np.ndarray, threshold: float
    ) -> Iterator[tuple[int, int, int, float]]:
        """Item, first word, words and similarity of the best window per item of a document.

        ``document`` are its shingles of ``k`` words, ``shared`` the places of known ones.
        """
        by_hash = self.shingles[k][2]
        places = defaultdict(list)
        for p in shared.tolist():
            for key in by_hash[int(document[p])]:
                places[key].append(p)
        total = len(document)
        for key, at in places.items():
            size, group = key[1], self.groups[key]
            last = max(total - size, 0)
            at = np.array(at)
            # Window starts from which a shared place is reached, without repeats.
            reach = np.zeros(last + 2, np.int32)
            np.add.at(reach, np.clip(at - size + 1, 0, last), 1)
            np.add.at(reach, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
            best: dict[int, tuple[float, int, int]] = {}
            for own in np.split(starts, np.flatnonzero(np.diff(starts // STRETCH)) + 1):
                low = int(own[0])
                part = document[low : int(own[-1]) + size]
                for n, found, start, length in _verified(group, size, part, own - low, threshold):
                    if found > best.get(n, (0.0,))[0]:
                        best[n] = (found, low + start, length + k - 1)
            for n, (found, start, length) in best.items():
                yield group["items"][n], start, length, found


def _shared(group: dict, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of a stretch's shingles, given by value and number, each item of the group has."""
    low = np.searchsorted(group["owned"], values, side="left")
    number = np.searchsorted(group["owned"], values, side="right") - low
    at = np.repeat(low, number) + spread(number)
    return np.bincount(group["owner"][at], np.repeat(counts, number), len(group["items"]))


def _similarities(
    part: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: np.ndarray, bag: Counter, size: int, counts: dict
) -> np.ndarray:
    """Weighted Jaccard similarity of windows and an item of ``size`` shingles.

    ``most`` are the shingles of each window that the item has at all, ``counts`` those of the
    stretch by value. What a window has more often than the item is not in common.
    """
    both = most.copy()
    for shingle, n in bag.items():
        if counts.get(shingle, 0) > n:
            sums = np.concatenate([[0], np.cumsum(part == np.uint64(shingle))])
            both -= np.maximum(sums[stops] - sums[starts] - n, 0)
    return both / (stops - starts + size - both)


def _verified(
    group: dict, size: int, part: np.ndarray, starts: np.ndarray, threshold: float
) -> Iterator[tuple[int, float, int, int]]:
    """Number in the group, similarity, start and shingles of the best window per item."""
    stops = np.minimum(starts + size, len(part))
    prints = window_simhashes(part, starts, stops)
    hit = group["near"][0][prints[:, 0]]
    for block in range(1, BLOCKS):
        hit = hit | group["near"][block][prints[:, block]]
    values, numbers = np.unique(part, return_counts=True)
    counts = dict(zip(values.tolist(), numbers.tolist(), strict=True))
    # A window like an item has the threshold's share of the item's shingles at least.
    enough = _shared(group, values, numbers) >= threshold * size - 1e-9
    sizes = stops - starts + size
    for n in np.flatnonzero(hit.any(axis=0) | enough).tolist():
        candidate = hit[:, n].copy()
        apart = _BITS[prints[candidate] ^ group["prints"][n]].sum(axis=1, dtype=np.int32)
        candidate[candidate] = apart <= RADIUS
        # At most as many shingles in common as are in the item at all.
        sums = np.concatenate([[0], np.cumsum(np.isin(part, group["sets"][n]))])
        most = sums[stops] - sums[starts]
        candidate |= most / np.maximum(sizes - most, 1) >= threshold
        window = np.flatnonzero(candidate)
        if not len(window):
            continue
        found = _similarities(
            part, starts[window], stops[window], most[window], group["bags"][n], size, counts
        )
        where = int(np.argmax(found))
        if found[where] >= threshold:
            w = window[where]
            yield n, float(found[where]), int(starts[w]), int(stops[w] - starts[w])


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list]:
    block, size = [], 0
    for item, text in benchmark.select(id_column, text_column).toLocalIterator():
        if not text:
            continue
        if block and size + len(text) * 4 > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text) * 4
    if block:
        yield block


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The items found in documents: ids, ``start`` and ``n_words`` of the place, ``similarity``.

    One row per document row and item, of the window most like the item, the first of equal ones.
    Words are compared in lower case without punctuation; runs of ``shingle`` words are weighted
    by how often they stand there; an item of fewer words is one run. A document shorter than an
    item is one window. Null and empty texts, and items without a word, match nothing. Repeated
    item rows give one row. Documents do not move; the items are sent to every task in blocks of
    ``ITEM_BYTES``, a pass per block, so no broadcast grows with the tables.
    """
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField(item_column, benchmark.schema[item_column].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    source = docs.select(id_column, text_column)
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(_blocks(benchmark.distinct(), item_column, item_text_column)):
        found = source.mapInArrow(_search(docs, block, shingle, threshold, schema), schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: list, shingle: int, threshold: float, schema: T.StructType):
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, shingle))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            batch = batch.rename_columns(["id", "text"])
            for part in slices([batch], "text"):
                rows = list(_found(part, index, threshold))
                columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names]
                columns[0] = part.column("id").take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_pydict(
                    dict(zip(names, columns, strict=True)),
                    schema=pa.schema(
                        [
                            (names[0], part.schema.field("id").type),
                            (names[1], pa.from_numpy_dtype(np.int64)),
                            ("start", pa.int64()),
                            ("n_words", pa.int64()),
                            ("similarity", pa.float64()),
                        ]
                    ),
                )

    return run


def _found(part: pa.RecordBatch, index: ItemIndex, threshold: float) -> Iterator[tuple]:
    """Row number, item, place and similarity of what a slice of documents holds."""
    texts = [words(t) for t in part.column("text").to_pylist()]
    bounds = offsets([len(t) for t in texts])
    hashed = word_hashes([w for t in texts for w in t])
    for k, (known, bitmap, _) in index.shingles.items():
        shingles, number = shingle_hashes(hashed, bounds, k)
        at = np.flatnonzero(bitmap[shingles & np.uint64(len(bitmap) - 1)])
        at = at[known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]]
        if not len(at):
            continue
        starts = offsets(number)
        rows = np.searchsorted(starts, at, side="right") - 1
        cuts = np.flatnonzero(rows[1:] != rows[:-1]) + 1
        for row, shared in zip(rows[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            document = shingles[starts[row] : starts[row + 1]]
            for found in index.matches(document, k, shared - starts[row], threshold):
                yield (row, *found)
