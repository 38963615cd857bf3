"""Removing repeated passages by recompression.

Words are symbols. In each round every symbol is a left or a right one by a bit of its name, and
each left symbol followed by a right one becomes one symbol, named by a hash of the two; runs of
one symbol are kept as (symbol, length). Names depend on nothing but the words below them, so all
documents agree on them without asking each other, and equal passages get equal symbols except
near their ends.

How far that reaches is known exactly: each symbol carries the stretch of words that its parse
depends on. After ``ROUNDS`` rounds at most 1 + 2 + 4 words at either end of a window of 20 are
undecided, so each window has a symbol inside that any equal window has too. The one with the
least name is the window's anchor. Anchors that occur once prove their windows unique, and most
do. Of repeated ones only those whose surroundings differ are looked at window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import hashes, mix, offsets, slices, spread, utf8, written

WINDOW, ROUNDS = 20, 3

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        return np.cumprod(steps, dtype=np.uint64)


class Stretches:
    """Hashes of any stretch of a row of words in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.back = _powers(_BACK, n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(mix(words) * _powers(_BASE, n)[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stops] - self.sums[starts]) * self.back[starts])


def recompress(words: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS):
    """Names, starts, and the stretch each symbol depends on, after all rounds.

    A stretch that reaches beyond a document counts one word more, so no window of that document
    holds it: elsewhere the same words may be parsed another way.
    """
    n = len(words)
    names, start = mix(words, 7), np.arange(n)
    left, right = np.arange(n), np.arange(1, n + 1)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low, high = np.repeat(bounds[:-1] - 1, np.diff(bounds)), np.repeat(bounds[1:] + 1, np.diff(bounds))
    for k in range(rounds):
        if not len(names):
            break
        first = (mix(names, 100 + k) >> np.uint64(63)).astype(bool)  # may open a pair
        joined = np.append(first[:-1] & ~first[1:] & (document[:-1] == document[1:]), False)
        second = np.append(False, joined[:-1])
        # A symbol that closes pairs depends on the one before it, one that opens them on the next.
        same = document[1:] == document[:-1]
        before = np.append(low[0], np.where(same, left[:-1], low[1:]))
        after = np.append(np.where(same, right[1:], high[:-1]), high[-1])
        reach_left = np.where(first, left, before)
        reach_right = np.where(first, after, right)
        follow = np.append(names[1:], np.uint64(0))
        with np.errstate(over="ignore"):
            pair = mix(names * np.uint64(3) + mix(follow, 11), 13)
        names = np.where(joined, pair, names)
        ends = np.where(joined, np.append(reach_right[1:], 0), reach_right)
        keep = ~second
        names, start, document = names[keep], start[keep], document[keep]
        left, right = reach_left[keep], ends[keep]
        low, high = low[keep], high[keep]
    return names, start, left, right


def anchors(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW):
    """The anchor of every window: names, starts of symbols, first window and number of windows."""
    counts = np.diff(bounds)
    windows = np.maximum(counts - window + 1, 0)
    at = np.repeat(bounds[:-1], windows) + spread(windows)
    nothing = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), nothing, nothing, nothing
    names, start, left, right = recompress(words, bounds)
    # A symbol may be one common word. The words its parse depends on are in every window that
    # holds it, so they may name it too, and chance repeats get rare.
    names = mix(names ^ Stretches(words).of(np.maximum(left, 0), np.minimum(right, len(words))), 3)
    # Symbols whose stretch lies in the window: adjacent ones, since stretches are in order.
    n = len(words)
    low = np.cumsum(np.bincount(left + 1, minlength=n + 2))[at]
    high = np.cumsum(np.bincount(right, minlength=n + 2))[at + window] - 1
    level = np.log2(high - low + 1).astype(np.int64)
    best, chosen = np.arange(len(names)), np.zeros(len(at), np.int64)
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            a, b = best[:-half], best[half:]
            best = np.where(names[b] <= names[a], b, a)
        own = np.flatnonzero(level == k)
        a, b = best[low[own]], best[high[own] - (1 << k) + 1]
        chosen[own] = np.where(names[b] <= names[a], np.maximum(a, b), a)
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(at)))
    symbol = chosen[first]
    return names[symbol], start[symbol], at[first], number


def _words(part: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    found = [t.split() for t in utf8(part.column("text"))]
    bounds = offsets([len(w) for w in found])
    return found, hashes([w for ws in found for w in ws]), bounds


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with a hash of all words their windows cover; runs of equal ones are one row."""
    for part in slices(batches, "text"):
        _, words, bounds = _words(part)
        names, start, first, number = anchors(words, bounds)
        ids = part.column("doc").to_numpy()
        document = np.searchsorted(bounds, first, side="right") - 1
        around = mix(
            Stretches(words).of(first, first + number + WINDOW - 1)
            ^ mix((start - first).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64), 5)
        )
        if not len(names):
            continue
        follows = np.append(
            False,
            (names[1:] == names[:-1])
            & (around[1:] == around[:-1])
            & (document[1:] == document[:-1])
            & (first[1:] == first[:-1] + number[:-1]),
        )
        head = np.flatnonzero(~follows)
        yield pa.RecordBatch.from_pydict(
            {
                "sym": _long(names[head]),
                "around": _long(around[head]),
                "doc": pa.array(ids[document[head]], pa.int64()),
                "pos": pa.array(first[head] - bounds[document[head]], pa.int32()),
                "width": pa.array(number[head], pa.int32()),
                "run": pa.array(np.diff(np.append(head, len(names))), pa.int32()),
            }
        )


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of anchors and how often each occurs, summed over a slice."""
    for rows in _anchor_rows(batches):
        names, where = np.unique(rows.column("sym").to_numpy(), return_inverse=True)
        n = np.bincount(where, rows.column("run").to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"sym": names, "n": n})


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed anchors, one by one: name, hash of the words, place."""
    for part in slices(batches, "text"):
        _, words, bounds = _words(part)
        listed = part.column("edges")
        rows = listed.flatten()
        if not len(rows):
            continue
        document = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy())
        pos, width, sym = (rows.field(k).to_numpy() for k in range(3))
        start = np.repeat(pos, width) + spread(width)
        document = np.repeat(document, width)
        at = bounds[document] + start
        yield pa.RecordBatch.from_pydict(
            {
                "sym": pa.array(np.repeat(sym, width)),
                "words": _long(Stretches(words).of(at, at + WINDOW)),
                "doc": pa.array(part.column("doc").to_numpy()[document], pa.int64()),
                "pos": pa.array(start, pa.int32()),
            }
        )


_GONE = "array<struct<pos:int,width:int>>"


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the windows that also start earlier: ``doc`` and ``gone``, a list of stretches
    (first window, number of windows).

    Earlier is a smaller id, or an earlier start in the same document. Documents without such a
    window, and those with a null id or text, have no row.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")
    ).where("doc is not null and text is not null")
    rows = "sym long, around long, doc long, pos int, width int, run int"
    # Few names occur twice. Only anchors with such a name move with their places.
    repeated = written(
        source.mapInArrow(_symbol_rows, "sym long, n long")
        .groupBy("sym")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .select("sym"),
        "symbols",
    )
    found = written(
        source.mapInArrow(_anchor_rows, rows).join(repeated, "sym", "left_semi"), "anchors"
    )
    place = F.struct("doc", "pos")
    firsts = found.groupBy("sym", "around").agg(
        F.min(F.struct("doc", "pos", "width")).alias("first"), F.count("*").alias("n")
    )
    firsts = written(firsts, "surroundings")
    # All windows of an anchor with the same words around it as an earlier one are repeats; so are
    # all but the first stretch of a run.
    later = found.join(
        firsts.where("n > 1").select(
            "sym", "around", F.struct("first.doc", "first.pos").alias("first")
        ),
        ["sym", "around"],
    ).where(place != F.col("first"))
    copies = later.select("doc", "pos", (F.col("width") * F.col("run")).alias("width"))
    runs = found.where("run > 1").select(
        "doc", (F.col("pos") + F.col("width")).alias("pos"), (F.col("width") * (F.col("run") - 1)).alias("width")
    )
    # A name with several surroundings: their windows may still be equal, here and there.
    several = firsts.groupBy("sym").agg(F.count("*").alias("k")).where("k > 1").select("sym")
    edges = (
        firsts.join(several, "sym", "left_semi")
        .groupBy(F.col("first.doc").alias("doc"))
        .agg(F.collect_list(F.struct("first.pos", "first.width", "sym")).alias("edges"))
    )
    windows = written(
        source.join(edges, "doc").mapInArrow(_window_rows, "sym long, words long, doc long, pos int"),
        "windows",
    )
    earliest = (
        windows.groupBy("sym", "words")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    single = (
        windows.join(earliest, ["sym", "words"])
        .where(place != F.col("first"))
        .select("doc", "pos", F.lit(1).alias("width"))
    )
    return (
        copies.unionByName(runs)
        .unionByName(single)
        .groupBy("doc")
        .agg(F.collect_list(F.struct("pos", "width")).cast(_GONE).alias("gone"))
    )


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found = [t.split() for t in utf8(part.column("text"))]
        texts, n_words, n_removed = [], [], []
        for words, gone in zip(found, part.column("gone").to_pylist(), strict=True):
            n_words.append(len(words))
            if gone:
                edge = np.zeros(len(words) + 1, np.int64)
                for stretch in gone:
                    edge[stretch["pos"]] += 1
                    edge[min(stretch["pos"] + stretch["width"] + WINDOW - 1, len(words))] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                words = [words[i] for i in np.flatnonzero(~covered).tolist()]
            n_removed.append(n_words[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_pydict(
            {
                "id": part.column("id"),
                "kept": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
            }
        )


def _told_apart(source: DataFrame) -> tuple[DataFrame, str]:
    """Rows and the name of a column with a number per document, in order: the id, as a rule.

    If rows repeat an id with other texts, pairs of id and text hash are numbered in their order.
    """
    known, body = source.where("id is not null"), F.xxhash64("text").alias("body")
    texts = known.groupBy("id").agg(F.min(body).alias("a"), F.max(body).alias("b"))
    if written(texts.where("a != b").select("id"), "repeated-ids").isEmpty():
        return source, "id"
    places = known.select("id", body).distinct().orderBy("id", "body")
    places = written(places.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return source.withColumn("body", F.xxhash64("text")).join(places, ["id", "body"], "left"), "number"


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``kept`` text, ``n_words``, ``n_removed`` and ``kept_sha256``.

    Each word covered by a window of 20 words that also starts earlier is removed; what stays is
    joined by single spaces. Words are what ASCII white space separates. All windows are judged on
    the input. Null and empty texts have no words; rows with a null id lose none and take none
    from others; ids are whole numbers. Rows that repeat an id and its text get equal results; of
    rows that repeat an id with other texts, that with the smaller hash of its text counts as
    earlier. Windows of equal hashes (128 bits, of the anchor's name and the words) count as equal.
    """
    # Written before texts move, so that the two steps do not need disk at the same time.
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    source, key = _told_apart(source)
    gone = written(repeated_windows(source, key, "text"), "gone")
    joined = source.join(gone, source[key] == gone["doc"], "left").select("id", "text", "gone")
    return joined.mapInArrow(
        _kept_rows, "id long, kept string, n_words long, n_removed long, kept_sha256 string"
    ).withColumnRenamed("id", id_column)
