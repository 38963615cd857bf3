"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A language gives each piece of a public vocabulary a probability. The probability of a word is
the sum, over all ways to cut it into pieces, of the products of their probabilities; a forward
pass computes it. The probabilities are fitted by expectation-maximisation: a forward and a
backward pass share out each word's count among the pieces of all its segmentations.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import slices, written

#: Training rows per language; the only bound on what the model is fitted on.
SAMPLE_PER_LANGUAGE = 500
UNDETERMINED = "und"
ROUNDS = 3

# Positions after which sums are scaled, so that those of long words stay within a float; bytes of
# units that are summed side by side.
SCALED_EVERY, SIDE_BYTES = 16, 1 << 20
# Added to each piece's expected count.
SMOOTHING = 0.05
SCORE_BYTES = 12 << 20

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """By length: sorted hashes of the vocabulary's pieces and their numbers; how many there are."""
    with open(path, "rb") as file:
        known = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    hashed, numbers = [], []
    with np.errstate(over="ignore"):
        for size in range(max(map(len, known), default=0) + 1):
            own = [i for i, p in enumerate(known) if len(p) == size]
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = h * _BASE + np.array([known[i][k] + 1 for i in own], np.uint64)
            order = np.argsort(h)
            hashed.append(h[order])
            numbers.append(np.array(own, np.int64)[order])
    return hashed, numbers, len(known)


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower()) if text else []


def stretches(word: str) -> list[bytes]:
    """The bytes that are segmented, which is the whole word behind a space."""
    return [b" " + word.encode("utf-8", "surrogatepass")]


def _spans(vocab: tuple, data: np.ndarray, starts) -> Iterator[tuple[int, list]]:
    """By start: the ends of pieces of any length, with the rows of ``data`` that have them there."""
    hashed, numbers, _ = vocab
    n, length = data.shape
    for start in starts:
        found, h = [], np.zeros(n, np.uint64)
        for end in range(start + 1, min(length, start + len(hashed) - 1) + 1):
            with np.errstate(over="ignore"):
                h = h * _BASE + data[:, end - 1]
            table = hashed[end - start]
            if len(table):
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                rows = np.flatnonzero(table[at] == h)
                if len(rows):
                    found.append((end, rows, numbers[end - start][at[rows]]))
        yield start, found


def _by_length(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of one length as rows of bytes plus one, with their places in the list."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    for size in np.unique(sizes).tolist():
        same, step = np.flatnonzero(sizes == size), max(1, SIDE_BYTES // size)
        for at in np.split(same, range(step, len(same), step)):
            data = np.frombuffer(b"".join([units[i] for i in at.tolist()]), np.uint8)
            yield at, data.reshape(-1, size).astype(np.uint64) + np.uint64(1)


def _scaled(near: np.ndarray, power: np.ndarray) -> np.ndarray:
    """``near`` divided by powers of two, which are added to ``power``; that loses no digit."""
    up = np.frexp(near.max(axis=0))[1]
    power += up
    return np.ldexp(near, -up)


def _ahead(vocab: tuple, data: np.ndarray, chances: np.ndarray, kept: list | None = None):
    """Sums over all segmentations of whole units, and the powers of two to multiply them by.

    Only positions that a piece can reach from the present one are held. ``kept`` takes the sums up
    to each position, with their powers.
    """
    n, length = data.shape
    held = min(len(vocab[0]) - 1, length) + 1
    near = np.zeros((held, n, *chances.shape[1:]))
    near[0], power = 1, np.zeros(near.shape[1:], np.int64)
    for start, found in _spans(vocab, data, range(length)):
        if start and start % SCALED_EVERY == 0:
            power = power.copy()
            near = _scaled(near, power)
        now = near[start % held].copy()
        near[start % held] = 0
        for end, rows, piece in found:
            near[end % held][rows] += now[rows] * chances[piece]
        if kept is not None:
            kept.append((now, power))
    return near[length % held], power


def forward(vocab: tuple, units: list[bytes], chances: np.ndarray) -> np.ndarray:
    """Log probability of each unit in each language. ``chances``: a row of pieces' per language."""
    out = np.zeros((len(units), chances.shape[1]))
    for at, data in _by_length(units):
        total, power = _ahead(vocab, data, chances)
        out[at] = np.log(total) + power * np.log(2)
    return out


def expected(vocab: tuple, units: list[bytes], weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in units that occur ``weights`` times, in one language."""
    out = np.zeros(vocab[2])
    for at, data in _by_length(units):
        (n, length), kept = data.shape, []
        total, all_power = _ahead(vocab, data, chances, kept)
        share = weights[at] / total
        held = min(len(vocab[0]) - 1, length) + 1
        behind, power = np.zeros((held, n)), np.zeros(n, np.int64)
        behind[length % held] = 1
        for start, found in _spans(vocab, data, range(length - 1, -1, -1)):
            ahead, its_power = kept.pop()
            behind[start % held] = 0
            if start % SCALED_EVERY == 0 and length > SCALED_EVERY:
                behind = _scaled(behind, power)
            ahead = np.ldexp(ahead * share, its_power + power - all_power)
            for end, rows, piece in found:
                rest = chances[piece] * behind[end % held][rows]
                behind[start % held][rows] += rest
                out += np.bincount(piece, ahead[rows] * rest, vocab[2])
    return out


@dataclass(frozen=True)
class Model:
    """Languages, their prior probabilities and a column of piece probabilities for each."""

    path: str
    languages: tuple[str, ...]
    priors: np.ndarray
    chances: np.ndarray


def is_training(id_column: Column) -> Column:
    """Whether a row may be learned from: the CRC-32 of its id as text is no multiple of 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    rounds: int = ROUNDS,
) -> Model:
    """A model learned from the rows of ``docs`` with a language and a text.

    Priors count all rows. Pieces are fitted on ``sample_per_language`` whole texts of each
    language, those with the smallest hash of their id. What reaches the driver are sums per
    language and piece. Without any such row the model knows no language.
    """
    labelled = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    counted = labelled.groupBy(lang_column).count().orderBy(lang_column).collect()
    languages = tuple(r[0] for r in counted)
    priors = np.array([r[1] for r in counted], float)
    vocab = pieces(path)
    chances = np.full((vocab[2], len(languages)), 1 / vocab[2])
    if not languages:
        return Model(path, languages, priors, chances)
    order = Window.partitionBy(lang_column).orderBy(F.xxhash64(id_column), id_column)
    chosen = (
        labelled.select(id_column, lang_column)
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= sample_per_language)
        .select(id_column, lang_column)
        .distinct()
    )
    schema = "lang string, word string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns(["lang", "text"])
            for part in slices([batch], "text"):
                for lang, text in zip(*(part.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                    found = Counter(words(text))
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang] * len(found), "word": list(found), "n": list(found.values())},
                        schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
                    )

    # At most ``sample_per_language`` ids per language: small enough to go where the texts are.
    sample = labelled.join(F.broadcast(chosen), [id_column, lang_column]).select(lang_column, text_column)
    counts = written(
        sample.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words"
    )
    for _ in range(rounds):
        sums = np.full((vocab[2], len(languages)), SMOOTHING)
        shares = counts.mapInArrow(_expectation(counts, path, languages, chances), "lang int, piece int, n double")
        total = shares.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        np.add.at(sums, (total["piece"].to_numpy(int), total["lang"].to_numpy(int)), total["n"].to_numpy())
        chances = sums / sums.sum(axis=0)
    return Model(path, languages, priors / priors.sum(), chances)


def _expectation(df: DataFrame, path: str, languages: tuple[str, ...], chances: np.ndarray):
    shared = df.sparkSession.sparkContext.broadcast(chances)
    column = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        for batch in batches:
            langs = np.array([column[x] for x in batch.column("lang").to_pylist()], np.int64)
            found, weight = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for lang in np.unique(langs).tolist():
                own = np.flatnonzero(langs == lang).tolist()
                units = [(s, weight[i]) for i in own for s in stretches(found[i])]
                uses = expected(
                    vocab,
                    [u for u, _ in units],
                    np.array([w for _, w in units], float),
                    shared.value[:, lang],
                )
                some = np.flatnonzero(uses)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array(np.full(len(some), lang), pa.int32()),
                        "piece": pa.array(some, pa.int32()),
                        "n": uses[some],
                    }
                )

    return run


def identify(
    docs: DataFrame,
    model: Model,
    text_column: str = "text",
    lang_column: str = "lang_pred",
    score_column: str = "score",
) -> DataFrame:
    """``docs`` with the likeliest language of each whole text and its probability.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model
    knows no language. Of equally likely languages the first by name wins. Columns of the two
    names are replaced, all others stay. No row moves; memory is bounded by ``SCORE_BYTES`` of
    text, or one text.
    """
    kept = docs.drop(lang_column, score_column)
    schema = T.StructType(
        [
            *kept.schema.fields,
            T.StructField(lang_column, T.StringType()),
            T.StructField(score_column, T.DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(shared.value.path)
        for part in slices(batches, text_column, SCORE_BYTES):
            langs, scores = predict(shared.value, vocab, part.column(text_column).to_pylist())
            part = part.append_column(pa.field(lang_column, pa.string()), pa.array(langs, pa.string()))
            yield part.append_column(pa.field(score_column, pa.float64()), pa.array(scores, pa.float64()))

    return kept.mapInArrow(run, schema)


def predict(model: Model, vocab: tuple, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores of texts; each distinct word is summed over its segmentations once."""
    known: dict[str, int] = {}
    number = known.setdefault
    runs = [[number(w, len(known)) for w in words(t)] for t in texts]
    if not known or not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    units, owner = [], []
    for i, word in enumerate(known):
        for s in stretches(word):
            units.append(s)
            owner.append(i)
    scored = np.zeros((len(known), len(model.languages)))
    np.add.at(scored, np.array(owner), forward(vocab, units, model.chances))
    langs, scores = [], []
    start = np.log(model.priors)
    for run in runs:
        if not run:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        logs = start + scored[run].sum(axis=0)
        best = int(np.argmax(logs))
        langs.append(model.languages[best])
        scores.append(round(float(1 / np.exp(logs - logs[best]).sum()), 6))
    return langs, scores
