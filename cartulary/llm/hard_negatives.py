"""Hard negatives: exact search for inner products in a window, in cover trees.

A further coordinate brings all candidates to the length of the longest, so they lie on a sphere,
and the inner product with a query depends on the angle alone. A cover tree's nodes know the
angle within which all below them lie; with the angle between a node's centre and a query this
bounds the inner products below the node from both sides. A search takes the node with the highest
bound first, skips nodes whose bounds lie outside all windows asked for, below what was found
already, or whose labels do not fit, and computes the products at the leaves exactly.

The top level is fitted on a bounded sample; every row then goes to its nearest centre. Rows of a
centre are dealt into shards of bounded size, each with a tree of its own, and a query goes
to those shards only whose node it needs.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.common import spread, written

SCALE, POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 256, 5, 10, 30, 90
#: Rows and bytes of the sample that the top level and the first thresholds come from.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 4 << 20
#: Centres of the top level at most.
CENTRES = 256
# Rows in a shard: a share of all, between a least number and what fits in memory.
SHARD_SHARE, LEAST_SHARD, SHARD_BYTES = 64, 4096, 32 << 20
# Queries that meet a shard in one task, and those whose bounds are computed at a time.
QUERY_BLOCK, QUERIES_AT_ONCE = 16_384, 256
FANOUT, LEAF = 16, 128

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
# Angles are off by less than this in double precision.
_SLACK = 1e-6
_SAME = 1e-7

_ROWS = "task long, kind int, id long, label long, row long, vector array<long>, asked array<long>, floors array<long>"
_HITS = "anchor_id long, who long, asked long, id long, row long, score long"


# ---------------------------------------------------------------------------------------------
# Vectors on a sphere
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Space:
    """The sphere all candidates lie on after the further coordinate: its dimension and radius."""

    size: int
    longest: int  # the greatest squared length

    @property
    def radius(self) -> float:
        return float(np.sqrt(float(self.longest)))

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Vectors as rows; missing components are 0.

        Whole numbers in doubles if no sum of products can leave the range in which those are
        exact, otherwise in 64 bits.
        """
        lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False)
        if (lengths == self.size).all():
            found = values.reshape(len(lengths), self.size)
        else:
            found = np.zeros((len(lengths), self.size), np.int64)
            found[np.arange(self.size) < lengths[:, None]] = values
        return found.astype(np.float64 if self.longest < 1 << 53 else np.int64)

    def heights(self, vectors: np.ndarray) -> np.ndarray:
        """The further coordinate."""
        lengths = np.einsum("ij,ij->i", vectors, vectors).astype(np.float64)
        return np.sqrt(np.maximum(float(self.longest) - lengths, 0.0))

    def angles(self, vectors: np.ndarray, heights: np.ndarray, centre: np.ndarray, height: float) -> np.ndarray:
        if not self.longest:
            return np.zeros(len(vectors))
        cosines = ((vectors @ centre).astype(np.float64) + heights * height) / float(self.longest)
        return np.arccos(np.clip(cosines, -1.0, 1.0))

    def bounds(self, products: np.ndarray, lengths: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products below nodes, from those of the centres.

        ``products`` has a row per query (of the given length) and a column per node.
        """
        most = lengths[:, None] * self.radius
        with np.errstate(invalid="ignore", divide="ignore"):
            cosines = np.where(most > 0, products.astype(np.float64) / most, 0.0)
        angles = np.arccos(np.clip(cosines, -1.0, 1.0))
        high = most * (np.cos(np.maximum(angles - radii, 0.0)) + _SLACK)
        low = most * (np.cos(np.minimum(angles + radii, np.pi)) - _SLACK)
        return low, high


def farthest_first(
    space: Space, vectors: np.ndarray, heights: np.ndarray, first: int, most: int
) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres that each lie farthest from those before: rows, each row's centre, its angle to it.

    The centres are at least as far apart as any row is from its nearest one, so they are a level of
    a cover tree whose scale the data set.
    """
    centres = [first]
    nearest = np.zeros(len(vectors), np.int64)
    angles = space.angles(vectors, heights, vectors[first], heights[first])
    while len(centres) < most:
        far = int(np.argmax(angles))
        if angles[far] <= _SAME:
            break
        here = space.angles(vectors, heights, vectors[far], heights[far])
        closer = here < angles
        closer[far] = True
        nearest[closer], angles[closer] = len(centres), here[closer]
        centres.append(far)
    return centres, nearest, angles


class CoverTree:
    """The rows of a shard below nodes with covering angles; leaves are runs of rows."""

    def __init__(self, space: Space, ids, labels, rows, vectors: np.ndarray):
        heights = space.heights(vectors)
        centre, radius, first, number, least, most, runs = [], [], [], [], [], [], []
        order: list[np.ndarray] = []
        placed = 0

        def add(members: np.ndarray, middle: int, angle: float) -> None:
            centre.append(middle), radius.append(angle + _SAME)
            least.append(int(labels[members].min())), most.append(int(labels[members].max()))
            first.append(0), number.append(0), runs.append((0, 0))
            waiting.append((len(centre) - 1, members))

        waiting: deque = deque()
        everything = np.arange(len(vectors))
        add(everything, 0, float(space.angles(vectors, heights, vectors[0], heights[0]).max()))
        while waiting:
            node, members = waiting.popleft()
            if len(members) > LEAF and radius[node] > 2 * _SAME:
                inside, outside = vectors[members], heights[members]
                middle = int(np.flatnonzero(members == centre[node])[0])
                picked, nearest, angles = farthest_first(space, inside, outside, middle, FANOUT)
                if len(picked) > 1:
                    first[node], number[node] = len(centre), len(picked)
                    for k, place in enumerate(picked):
                        mine = nearest == k
                        add(members[mine], int(members[place]), float(angles[mine].max()))
                    continue
            runs[node] = (placed, placed + len(members))
            placed += len(members)
            order.append(members)
        kept = np.concatenate(order)
        self.space, self.radii, self.first, self.number, self.runs = space, np.array(radius), first, number, runs
        self.centres = vectors[np.array(centre)]
        self.least, self.most = np.array(least), np.array(most)
        self.ids, self.labels, self.rows, self.vectors = ids[kept], labels[kept], rows[kept], vectors[kept]

    def search(self, queries: np.ndarray, wanted: "Wanted") -> None:
        """Lets a block of queries take what they need, best nodes first.

        The queries go down together: the node with the highest bound of any of them is next, and only
        those that need it at that time look into it.
        """
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries).astype(np.float64))
        low, high = self.space.bounds(queries @ self.centres.T, lengths, self.radii)
        fits = wanted.fits(self.least, self.most)
        high = np.where(fits, high, -np.inf)
        heap = [(-float(high[:, 0].max(initial=-np.inf)), 0)]
        while heap:
            best, node = heapq.heappop(heap)
            if -best < wanted.least():
                return
            which = np.flatnonzero(wanted.needs(low[:, node], high[:, node]))
            if not len(which):
                continue
            if self.number[node]:
                start = self.first[node]
                below = high[which, start : start + self.number[node]].max(axis=0)
                for child, bound in enumerate(below.tolist(), start):
                    if bound > -np.inf:
                        heapq.heappush(heap, (-bound, child))
            else:
                a, b = self.runs[node]
                scores = queries[which] @ self.vectors[a:b].T
                wanted.take(which, scores, self.ids[a:b], self.labels[a:b], self.rows[a:b])


class Wanted:
    """What a block of queries looks for: the first few rows in each window of scores.

    ``windows`` has a list of (asked, least, greatest score) per query. A floor is a score that as
    many rows as are wanted are known to reach; it rises as rows are found.
    """

    def __init__(self, anchors, labels, same: bool, number: int, windows, floors=None):
        self.anchors, self.labels = np.asarray(anchors, np.int64), np.asarray(labels, np.int64)
        self.same, self.number, self.windows = same, number, windows
        most = max(map(len, windows), default=0)
        # Windows that a query lacks ask for more than any score.
        self.floors = np.full((len(windows), most), _MOST)
        self.highs = np.full((len(windows), most), _LEAST)
        for q, own in enumerate(windows):
            for k, (_, low, high) in enumerate(own):
                self.floors[q, k] = low if floors is None else max(low, floors[q][k])
                self.highs[q, k] = high
        self.found: list[list[list[tuple[int, int, int]]]] = [[[] for _ in own] for own in windows]

    def fits(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether nodes with labels in a range can hold rows for each query."""
        labels = self.labels[:, None]
        if self.same:
            return (least <= labels) & (labels <= most)
        return (least != labels) | (most != labels)

    def least(self) -> int:
        return self.floors.min(initial=_MOST)

    def needs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether scores between the bounds are of use to each query."""
        return ((high[:, None] >= self.floors) & (low[:, None] <= self.highs)).any(axis=1)

    def take(self, which: np.ndarray, scores: np.ndarray, ids, labels, rows) -> None:
        """Scores of some queries (a row each) with some rows (a column each)."""
        if self.same:
            fit = (labels == self.labels[which, None]) & (ids != self.anchors[which, None])
        else:
            fit = labels != self.labels[which, None]
        for k in range(self.floors.shape[1]):
            inside = (scores >= self.floors[which, k, None]) & (scores <= self.highs[which, k, None])
            query, column = np.nonzero(inside & fit)
            if not len(query):
                continue
            found = -scores[query, column].astype(np.int64)
            order = np.lexsort((rows[column], ids[column], found, query))
            query, column, found = query[order], column[order], found[order]
            starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(query)], strict=True):
                first = slice(start, min(stop, start + self.number))
                new = zip(found[first].tolist(), ids[column[first]].tolist(), rows[column[first]].tolist(), strict=True)
                q = int(which[query[start]])
                kept = self.found[q][k] = sorted([*self.found[q][k], *new])[: self.number]
                if len(kept) == self.number:
                    self.floors[q, k] = max(self.floors[q, k], -kept[-1][0])


def windows_of(asked: list[int] | None, low_percent: int, high_percent: int) -> list[tuple[int, int, int]]:
    """(asked, least, greatest score) of each window that any score fits in."""
    if asked is None:
        return [(0, _LEAST, _MOST)]
    found = [(s, -(-low_percent * s // 100), high_percent * s // 100) for s in asked]
    return [w for w in found if w[1] <= w[2]]


# ---------------------------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Placed rows and the top level of the tree: a centre, angle and labels per node."""

    space: Space
    placed: DataFrame | None
    centres: np.ndarray
    radii: np.ndarray
    least: np.ndarray
    most: np.ndarray
    shards: np.ndarray  # of each node
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels, vectors


def _prepared(rows: DataFrame, asks: Column, id_column: str, label_column: str, vector_column: str, scale: int):
    """The rows that take part, in whole numbers."""
    vector = F.col(vector_column).cast("array<double>")
    given = rows.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).cast("long").alias("label"),
        vector.alias("raw"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).where("id is not null and label is not null and raw is not null")
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("raw", lambda x: F.floor(x * F.lit(float(scale))))
    named = given.where(F.coalesce(finite, F.lit(False))).select("id", "label", "asks", whole.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    named = named.withColumn("square", square).where(F.col("square") <= float(1 << 62))
    return named.withColumn("row", F.xxhash64("id", "label", "vector"))


def build_index(prepared: DataFrame) -> Index | None:
    """The top level, and each row with the node it belongs to; None without rows."""
    n, size, longest = prepared.agg(
        F.count("*"), F.max(F.size("vector")), F.max("square").cast("long")
    ).first()
    if not n:
        return None
    space = Space(max(size, 1), longest)
    limit = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * space.size)))
    picked = prepared.orderBy(F.xxhash64("row"), "id").select("id", "label", "row", "vector").limit(limit).toArrow()
    picked = picked.combine_chunks().to_batches()[0]
    ids, labels, hashed = (picked.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "row"))
    vectors = space.matrix(picked.column("vector"))
    _, once = np.unique(np.stack([ids, hashed]), axis=1, return_index=True)
    ids, labels, vectors = ids[once], labels[once], vectors[once]
    in_shard = min(max(LEAST_SHARD, -(-n // SHARD_SHARE)), max(1, SHARD_BYTES // (8 * space.size)))
    heights = space.heights(vectors)
    chosen, _, _ = farthest_first(space, vectors, heights, 0, min(CENTRES, -(-n // in_shard)))
    centres, tops = vectors[chosen], heights[chosen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = space.matrix(batch.column("vector"))
            heights = space.heights(found)
            angles = np.stack([space.angles(found, heights, c, h) for c, h in zip(centres, tops, strict=True)])
            node = np.argmin(angles, axis=0)
            angle = angles[node, np.arange(len(node))]
            for name, column in (("node", pa.array(node.astype(np.int32))), ("angle", pa.array(angle))):
                batch = batch.append_column(name, column)
            yield batch

    schema = "id long, label long, asks boolean, vector array<long>, row long, node int, angle double"
    placed = written(prepared.drop("square").mapInArrow(place, schema), "placed")
    nodes = len(centres)
    counts, radii = np.zeros(nodes, np.int64), np.zeros(nodes)
    least, most = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    about = placed.groupBy("node").agg(F.count("*"), F.max("angle"), F.min("label"), F.max("label"))
    for node, count, angle, low, high in about.collect():  # a row per centre
        counts[node], radii[node], least[node], most[node] = count, angle + _SAME, low, high
    shards = -(-counts // in_shard)
    return Index(space, placed, centres, radii, least, most, shards, (ids, labels, vectors))


def _visits(index: Index, queries: DataFrame, same: bool, number: int, low: int, high: int, blocks: int) -> DataFrame:
    """A row per query and shard that it has to look into, with what the sample tells already."""
    index = replace(index, placed=None)  # tasks get the top level only
    space, shards = index.space, index.shards
    starts = np.concatenate([[0], np.cumsum(shards)])
    sample_ids, sample_labels, sample = index.sample

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                yield from few(batch.slice(at, QUERIES_AT_ONCE))

    def few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = space.matrix(batch.column("vector"))
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).astype(np.float64))
        lows, highs = space.bounds(vectors @ index.centres.T, lengths, index.radii)
        ids, labels, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "row"))
        asked = [None] * len(ids) if same else batch.column("asked").to_pylist()
        windows = [windows_of(scores, low, high) for scores in asked]
        want = Wanted(ids, labels, same, number, windows)
        everything, numbers = np.arange(len(ids)), np.arange(len(sample))
        want.take(everything, vectors @ sample.T, sample_ids, sample_labels, numbers)
        fits = want.fits(index.least, index.most) & (shards > 0)
        for node in range(len(shards)):
            fits[:, node] &= want.needs(lows[:, node], highs[:, node])
        query, node = np.nonzero(fits)
        times = shards[node]
        query, shard = np.repeat(query, times), np.repeat(starts[node], times) + spread(times)
        task = shard * blocks + rows[query] % blocks
        floors = [want.floors[q, : len(windows[q])].tolist() for q in query]
        taken = batch.take(pa.array(query, pa.int64()))
        none = pa.nulls(len(query), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(task, pa.int64()),
                pa.array(np.ones(len(query), np.int32)),
                *(taken.column(c) for c in ("id", "label", "row", "vector")),
                none if same else pa.array([[w[0] for w in windows[q]] for q in query], pa.list_(pa.int64())),
                pa.array(floors, pa.list_(pa.int64())),
            ],
            names=["task", "kind", "id", "label", "row", "vector", "asked", "floors"],
        )

    return queries.mapInArrow(visit, _ROWS)


def _searched(space: Space, same: bool, number: int, low: int, high: int):
    """Hits in each shard of sorted rows: those of the shard, then the queries that visit it."""

    def tree_of(held: list[pa.RecordBatch]) -> CoverTree:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, labels, rows = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "row"))
        _, once = np.unique(np.stack([ids, rows]), axis=1, return_index=True)
        vectors = space.matrix(whole.column("vector"))
        return CoverTree(space, ids[once], labels[once], rows[once], vectors[once])

    def hits(tree: CoverTree, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, QUERIES_AT_ONCE):
            few = part.slice(at, QUERIES_AT_ONCE)
            columns = [few.column(c).to_pylist() for c in ("id", "row", "label", "asked", "floors")]
            anchors, whos, labels, asked, floors = columns
            windows = [windows_of(scores, low, high) for scores in asked]
            wanted = Wanted(anchors, labels, same, number, windows, floors)
            tree.search(space.matrix(few.column("vector")), wanted)
            rows = [
                (anchor, who, window[0], i, row, -score)
                for anchor, who, own, lists in zip(anchors, whos, windows, wanted.found, strict=True)
                for window, found in zip(own, lists, strict=True)
                for score, i, row in found
            ]
            names = ["anchor_id", "who", "asked", "id", "row", "score"]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, current = [], None, None
        for batch in batches:
            task = batch.column("task").to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((task[1:] != task[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(task)], strict=True):
                if a == b:
                    continue
                if task[a] != current:
                    held, tree, current = [], None, task[a]
                part = batch.slice(a, b - a)
                if not kind[a]:
                    held.append(part)
                elif held or tree:
                    if tree is None:
                        tree, held = tree_of(held), []
                    yield from hits(tree, part)

    return run


def search(
    index: Index, queries: DataFrame, same: bool, number: int, low: int = 0, high: int = 0
) -> DataFrame:
    """The first ``number`` rows of each query and window, by score and then id.

    ``queries`` has columns id, label, row and vector and, for windows, ``asked``: each score s in
    it asks for rows of other labels that score between ``low`` and ``high`` percent of s. With
    ``same``, rows of the same label and another id are searched, of any score.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    visits = _visits(index, queries, same, number, low, high, blocks)
    first = F.array(*(F.lit(int(s)) for s in np.cumsum(index.shards) - index.shards))
    dealt = F.array(*(F.lit(max(1, int(s))) for s in index.shards))
    node = F.col("node") + 1
    shard = F.element_at(first, node) + F.pmod(F.xxhash64("id"), F.element_at(dealt, node))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    nothing = F.lit(None).cast("array<long>")
    rows = index.placed.select(shard.alias("shard"), "id", "label", "row", "vector", block.alias("block")).select(
        (F.col("shard") * blocks + F.col("block")).cast("long").alias("task"),
        F.lit(0).alias("kind"),
        "id",
        "label",
        "row",
        "vector",
        nothing.alias("asked"),
        nothing.alias("floors"),
    )
    met = rows.unionByName(visits).repartition("task").sortWithinPartitions("task", "kind")
    found = met.mapInArrow(_searched(index.space, same, number, low, high), _HITS).distinct()
    place = Window.partitionBy("anchor_id", "who", "asked").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= number)


_MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine(
    rows: DataFrame,
    asks: Column,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """Hard negatives of the rows that ``asks`` is true for, the anchors.

    A component x becomes floor(``scale`` x), a row's score is its inner product with the anchor,
    and higher scores, then smaller ids, come first. An anchor's positives are its first
    ``positives`` rows of the same label and another id. For each, the result holds the first
    ``negatives`` rows of other labels whose score is between ``low_percent`` and ``high_percent``
    percent of the positive's: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. The search is exact; fewer rows than wanted are all given.

    Rows without an id, label or vector, or with a component that is null or not finite, take no
    part, nor do those whose squared length in whole numbers is over 2^62. Missing components of
    shorter vectors are 0. Rows that repeat id, label and vector count once; rows that repeat an id
    otherwise are rows of their own. Ids and labels are whole numbers. Other columns are left out.
    A positive without negatives, an anchor without positives, and an empty table give no rows.
    """
    index = build_index(_prepared(rows, asks, id_column, label_column, vector_column, scale))
    if index is None:
        return rows.sparkSession.createDataFrame([], _MINED)
    anchors = index.placed.where("asks").select("id", "label", "row", "vector").dropDuplicates(["id", "row"])
    anchors = written(anchors, "anchors")
    near = written(search(index, anchors, True, positives), "positives").select(
        "anchor_id",
        "who",
        F.col("id").alias("positive_id"),
        F.col("row").alias("positive_row"),
        F.col("score").alias("positive_score"),
    )
    asked = near.groupBy("anchor_id", "who").agg(F.array_sort(F.collect_set("positive_score")).alias("asked"))
    asking = anchors.join(
        asked.withColumnsRenamed({"anchor_id": "id", "who": "row"}), ["id", "row"]
    )
    hard = search(index, written(asking, "asking"), False, negatives, low_percent, high_percent).select(
        "anchor_id",
        "who",
        F.col("asked").alias("positive_score"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    return near.join(hard, ["anchor_id", "who", "positive_score"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        "positive_score",
        "negative_score",
    )
