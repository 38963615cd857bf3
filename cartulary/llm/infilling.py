"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order.

A rolling hash cuts each text into chunks where its content says so, so that texts which share a
passage share its chunks. What a chunk adds to the search for a cut (its code points, a mark inside
it, the bytes at its ends) is worked out once per content and task and found by the content
itself. The counts of a text's chunks, added up, tell which chunk a cut falls into, and only in
there are code points counted one by one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import offsets, slices, utf8

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT, SEED = 10, 20, "1"

# Bytes that the rolling hash looks at, the least length of a chunk (the last of a text may be
# shorter), and the mean length beyond that.
WINDOW, LEAST_CHUNK, MEAN_CHUNK = 16, 64, 1024
# Content that a task remembers summaries of; the chunks used longest ago go first.
CACHE_BYTES = 32 << 20
CUT_BYTES = 2 << 20

_GEAR = np.frombuffer(hashlib.shake_256(b"rolling").digest(4 * 256), "<u4")


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``WINDOW`` bytes that end at each place (of fewer before the start)."""
    found = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        # The hash of twice as many bytes from the hashes of either half.
        found[reach:] = found[reach:] + (found[:-reach] << np.uint32(reach))
        reach *= 2
    return found


def chunk_ends(data: bytes, bounds: np.ndarray, mean: int = MEAN_CHUNK) -> list[list[int]]:
    """Where the chunks of each text end; ``bounds`` are the texts' offsets in ``data``.

    A chunk ends after a byte whose hash is below a threshold, at least ``LEAST_CHUNK`` bytes after
    its start, so the window never reaches back beyond a text's start.
    """
    low = np.uint32((1 << 32) // mean)
    marked = np.flatnonzero(rolling_hashes(np.frombuffer(data, np.uint8)) < low) + 1 if data else np.zeros(0, np.int64)
    out = []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, last = [], start
        low_at, high_at = np.searchsorted(marked, [start + LEAST_CHUNK, stop]).tolist()
        here = marked[low_at:high_at]
        dense = len(here) * LEAST_CHUNK > 4 * (stop - start)
        if dense:  # periodic text: look up the next one instead of going through all
            at = 0
            while at < len(here):
                last = int(here[at])
                ends.append(last)
                at = int(np.searchsorted(here, last + LEAST_CHUNK))
        else:
            for place in here.tolist():
                if place - last >= LEAST_CHUNK:
                    ends.append(place)
                    last = place
        if last < stop:
            ends.append(stop)
        out.append(ends)
    return out


class Chunk:
    """What a chunk's content says: code points that start in it, marks, and its ends."""

    __slots__ = ("points", "marked", "head", "tail", "starts")

    def __init__(self, content: bytes):
        lead = (np.frombuffer(content, np.uint8) & 0xC0) != 0x80
        self.points = int(np.count_nonzero(lead))
        self.marked = any(m in content for m in MARKS)
        reach = len(PREFIX) - 1
        self.head, self.tail = content[:reach], content[-reach:]
        # Where code points start; plain if each byte is one.
        self.starts = None if self.points == len(content) else np.flatnonzero(lead).astype(np.int32)

    def place(self, point: int) -> int:
        """The byte at which the chunk's code point of this number starts."""
        return point if self.starts is None else int(self.starts[point])


class Chunks:
    """Summaries by content. A lookup compares whole contents, so equal hashes cannot mislead."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: OrderedDict[bytes, Chunk] = OrderedDict()
        self.limit, self.held = limit, 0

    def of(self, content: bytes) -> Chunk:
        chunk = self.known.get(content)
        if chunk is not None:
            self.known.move_to_end(content)
            return chunk
        chunk = self.known[content] = Chunk(content)
        self.held += len(content)
        while self.held > self.limit and len(self.known) > 1:
            self.held -= len(self.known.popitem(last=False)[0])
        return chunk


class Cuts:
    """A text as chunks: its length in code points, whether it holds a mark, and byte places."""

    def __init__(self, text: bytes, ends: list[int], chunks: Chunks):
        """``ends`` are places in ``text``."""
        self.starts = [0, *ends]
        self.parts = [chunks.of(text[a:b]) for a, b in zip(self.starts[:-1], ends, strict=True)]
        self.before = [0, *accumulate(c.points for c in self.parts)]
        self.length = self.before[-1]
        self.marked = any(c.marked for c in self.parts) or self._mark_across()

    def _mark_across(self) -> bool:
        """Whether a mark lies across ends of chunks; short last chunks are joined on."""
        for a, b in zip(self.parts[:-1], self.parts[1:], strict=True):
            seam = a.tail + b.head
            if any(m in seam for m in MARKS):
                return True
        return False

    def place(self, point: int) -> int:
        """The byte at which the text's code point of this number starts (its length: the end)."""
        if point >= self.length:
            return self.starts[-1]
        part = bisect_right(self.before, point) - 1
        return self.starts[part] + self.parts[part].place(point - self.before[part])


def draws(identifier: int | None, seed: str = SEED) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the seed and the id only."""
    name = f"{seed}:{'' if identifier is None else identifier}"
    digest = hashlib.sha256(name.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(text: bytes, ends: list[int], identifier: int | None, chunks: Chunks, seed: str = SEED):
    """(code points, form, prefix's and middle's code points, output) of one text."""
    cuts = Cuts(text, ends, chunks)
    n = cuts.length
    h1, h2, h3, h4 = draws(identifier, seed)
    if not text or cuts.marked or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.place(first), cuts.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", first, second - first, b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return n, "psm", first, second - first, b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: str = SEED
) -> DataFrame:
    """Per row: the id, ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    The id alone decides on form and cuts. ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
    ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, and ``plain`` the text itself; a text
    that is empty or holds one of the three marks is always plain. ``restore`` undoes it.

    A null text is empty. Prefix, middle and suffix may be empty. Rows that repeat an id are cut
    alike if their lengths are; a null id counts as an empty one. Ids are whole numbers. Other
    columns are left out, so their names do not matter. No rows give none. Texts of any length
    are cut whole; a task holds a slice of texts, or one text, and a bounded memory of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for part in slices(batches, "text", CUT_BYTES):
            texts = utf8(part.column("text"))
            bounds = offsets([len(t) for t in texts])
            ends = chunk_ends(b"".join(texts), bounds)
            ids = part.column("doc").to_pylist()
            rows = [
                transform(text, [e - start for e in found], i, chunks, seed)
                for text, found, start, i in zip(texts, ends, bounds.tolist(), ids, strict=False)
            ]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=["doc", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    schema = "doc long, n long, form string, prefix_chars long, middle_chars long, output string"
    return source.mapInArrow(run, schema).withColumnRenamed("doc", id_column)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of.

    A text with marks is plain, so in the other forms each mark stands once, where it was put.
    """
    parts = F.split(output, "<[PSM]>", -1)
    one, two, three = (F.element_at(parts, k) for k in (2, 3, 4))
    return (
        F.when(form == "psm", F.concat(one, three, two))
        .when(form == "spm", F.concat(two, three, one))
        .otherwise(output)
    )
