"""Byte-level BPE over a public vocabulary: an index from pairs to their places in a partition.

The distinct pieces of a slice are laid out as one row of symbols. An index maps the rank of each
pair that a merge exists for to the positions where it stands. The lowest active rank is taken,
merged at all its positions at once, and the lists of the pairs this makes are extended. A
token comes from one merge only, so a pair never becomes active below the rank that made it, and
going through ranks in ascending order gives each piece what merging it alone would give.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import offsets, slices, spread

# Text that is encoded at a time; pieces in it are encoded once.
ENCODE_BYTES = 2 << 20

# Fixed value of byte-level vocabularies: how a text is cut into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_SHIFT = np.int64(20)


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids = data["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
        back = {c: b for b, c in letters.items()}
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max(*ids.values(), *self.special.values(), 0) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << _SHIFT | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.pieces = regex.compile(PIECES)
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.marks = regex.compile(f"({marks})") if marks else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 where no merge exists."""
        key = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker."""
    return Vocabulary(path)


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each piece has."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbols)
    gone, end = np.int64(-1), n
    symbols = np.append(symbols, gone)
    following = np.arange(1, n + 2)
    before = np.arange(-1, n)
    stops = np.cumsum(lengths)
    following[stops[lengths > 0] - 1] = end
    before[(stops - lengths)[lengths > 0]] = -1

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Enter the pairs that start at these positions into the index."""
        positions = positions[following[positions] != end]
        ranks = vocab.rank(symbols[positions], symbols[following[positions]])
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(
            ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True
        ):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(active, rank)

    if n:
        add(np.arange(n))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b = vocab.left[rank], vocab.right[rank]
        at = at[(symbols[at] == a) & (symbols[following[at]] == b)]
        if a == b and len(at) > 1:
            at = _apart(at, following)
        if not len(at):
            continue
        second = following[at]
        after = following[second]
        symbols[at] = vocab.made[rank]
        symbols[second] = gone
        following[at] = after
        before[after] = at
        ahead = before[at]
        add(np.unique(np.concatenate([ahead[ahead >= 0], at])))
    left = symbols[:n] >= 0
    counts = np.add.reduceat(left, np.minimum(stops - lengths, max(n - 1, 0))) if n else lengths * 0
    return symbols[:n][left].astype(np.uint32), np.where(lengths > 0, counts, 0)


def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of ascending positions of a pair of equal symbols, those merged from the left."""
    kept, taken = [], -1
    for p in at.tolist():
        if p != taken:
            kept.append(p)
            taken = following[p]
    return np.array(kept, np.int64)


def encode_texts(vocab: Vocabulary, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    known: dict[str, int] = {}
    number = known.setdefault
    runs: list[np.ndarray] = []
    counts = []
    for text in texts:
        parts = vocab.marks.split(text) if vocab.marks and "<" in text else (text,)
        here: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:  # a special token
                here.append(-1 - vocab.special[part])
            elif part:
                here.extend([number(p, len(known)) for p in vocab.pieces.findall(part)])
        runs.append(np.array(here, np.int64))
        counts.append(len(here))
    ids, sizes = encode_pieces(vocab, [p.encode("utf-8", "surrogatepass") for p in known])
    # Special tokens follow the pieces, as pieces of one id.
    special = np.array(sorted(vocab.special.values()), np.int64)
    starts = np.concatenate([offsets(sizes)[:-1], len(ids) + np.arange(len(special))])
    sizes = np.concatenate([sizes, np.ones(len(special), np.int64)]).astype(np.int64)
    ids = np.concatenate([ids, special.astype(np.uint32)])
    out = []
    for run in runs:
        run = np.where(run >= 0, run, len(known) + np.searchsorted(special, -1 - run))
        size = sizes[run]
        out.append(ids[np.repeat(starts[run], size) + spread(size)].astype("<u4").tobytes())
    return out


def _encoded(vocab: Vocabulary, part: pa.RecordBatch, column: str) -> pa.Array:
    texts = [t or "" for t in part.column(column).to_pylist()]
    return pa.array(encode_texts(vocab, texts), pa.binary())


def _decoded(vocab: Vocabulary, ids: pa.Array) -> pa.Array:
    token = vocab.bytes.__getitem__
    texts = (
        b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
        for x in ids.to_pylist()
    )
    return pa.array(texts, pa.string())


def encode(
    docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """``docs`` with the ids of its texts: a binary of little-endian unsigned 32-bit numbers.

    ``path`` names the vocabulary, a file that every executor has. A null text is empty; a column
    of ``docs`` named ``ids_column`` is replaced; all others stay. Each text is encoded whole;
    a special token's string in a text is that token. Memory is bounded by ``ENCODE_BYTES`` of
    text, or one text. No row moves: an empty table gives an empty table.
    """
    kept = docs.drop(ids_column)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_column, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, text_column, ENCODE_BYTES):
            ids = _encoded(vocab, part, text_column)
            yield part.append_column(pa.field(ids_column, pa.binary()), ids)

    return kept.mapInArrow(run, schema)


def decode(
    docs: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded"
) -> DataFrame:
    """``docs`` with the text that its ids stand for; bytes that are no UTF-8 become U+FFFD.

    Null ids are an empty text; ids outside the vocabulary are an error.
    """
    kept = docs.drop(text_column)
    schema = T.StructType([*kept.schema.fields, T.StructField(text_column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, ids_column, ENCODE_BYTES):
            texts = _decoded(vocab, part.column(ids_column))
            yield part.append_column(pa.field(text_column, pa.string()), texts)

    return kept.mapInArrow(run, schema)


def encode_and_decode(
    docs: DataFrame,
    path: str,
    text_column: str = "text",
    ids_column: str = "ids",
    decoded_column: str = "decoded",
) -> DataFrame:
    """``docs`` with the ids of its texts in place of the texts, and what the ids decode to.

    The same as ``encode`` followed by ``decode``, without the text column, in one Python worker
    per task: ids do not go back to Spark in between.
    """
    given = docs.drop(*{ids_column, decoded_column} - {text_column})
    schema = T.StructType(
        [
            *[f for f in given.schema.fields if f.name != text_column],
            T.StructField(ids_column, T.BinaryType()),
            T.StructField(decoded_column, T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, text_column, ENCODE_BYTES):
            ids = _encoded(vocab, part, text_column)
            part = part.drop_columns([text_column])
            part = part.append_column(pa.field(ids_column, pa.binary()), ids)
            yield part.append_column(pa.field(decoded_column, pa.string()), _decoded(vocab, ids))

    return given.mapInArrow(run, schema)


def digests(encoded: DataFrame, ids_column: str = "ids", text_column: str = "decoded"):
    """Columns that sum up an encoding: token count and SHA-256 of ids and decoded text."""
    return (
        (F.octet_length(ids_column) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids_column), 256).alias("ids_sha256"),
        F.sha2(F.col(text_column).cast("binary"), 256).alias("decoded_sha256"),
    )
