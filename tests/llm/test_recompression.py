import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import recompression as R
from cartulary.llm.common import hashes, offsets
from tests.llm.cases import LONG, ODD_TEXTS, documents, empty_documents, given_texts, read_back

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_force(rows, window=20):
    """By the definition: each window against all that start earlier."""
    first, out = {}, {}
    texts = {i: WORD.findall(t or "") for i, t in rows}
    gone = {i: [False] * len(w) for i, w in texts.items()}
    for i in sorted(texts):
        words = texts[i]
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if first.setdefault(key, (i, s)) != (i, s):
                gone[i][s : s + window] = [True] * window
    for i, words in texts.items():
        kept = " ".join(w for w, g in zip(words, gone[i], strict=True) if not g)
        out[i] = (len(words), sum(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = read_back(R.drop_repeats(docs).drop("kept"))
    expected = brute_force(rows)
    assert {i: tuple(r)[1:] for i, r in found.items()} == expected
    return expected


def test_given_documents(spark):
    expected = check(spark, given_texts(spark))
    assert sum(n for _, n, _ in expected.values()) > 100


def test_passages_runs_and_periods(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh")  # noqa: E731  few words, so windows repeat by chance too
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        kind, own = i % 6, [f"{word()}{r.randint(0, 400)}" for _ in range(r.randint(0, 90))]
        if kind == 0:
            at, cut = r.randint(0, len(own)), r.randint(0, 45)
            own[at:at] = passage[cut : cut + r.randint(15, 40)]
        elif kind == 1:
            own += ["a"] * r.randint(10, 70)
        elif kind == 2:
            own += ["x", "y", "z"][: r.randint(1, 3)] * r.randint(5, 30)
        elif kind == 3:
            own = [r.choice("ab") for _ in range(r.randint(0, 200))]
        elif kind == 4 and rows:
            own = rows[-1][1].split()
            if own:
                own[r.randrange(len(own))] = "edited"
        rows.append((i * 7 % 120, " ".join(own)))
    check(spark, rows)


def test_odd_texts(spark):
    check(spark, list(enumerate([*ODD_TEXTS, LONG, LONG, "tail " + LONG])))


def test_null_ids_repeated_rows_other_columns_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(None, text, 1), (5, text, 2), (5, text, 2), (9, text, 3)], "doc_id long, text string, pos int"
    )
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in R.drop_repeats(docs).collect())
    assert found == [(-1, 0), (5, 0), (5, 0), (9, 40)]
    assert R.drop_repeats(empty_documents(spark)).collect() == []
    assert read_back(R.drop_repeats(documents(spark, [None])))[0].n_words == 0


def test_ids_repeated_with_other_texts(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, words[0]), (5, words[1]), (5, " ".join(words[0].split()[:5])), (5, f"{words[1]} x"), (7, words[2]), (5, words[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in R.drop_repeats(docs).collect())
    # Of the two texts of id 5 that share 60 words one is the earlier, with its copy or alone.
    first = [(1, 60, 0), (5, 5, 0), (7, 60, 0)]
    assert found in (
        sorted([*first, (5, 60, 0), (5, 60, 0), (5, 61, 60)]),
        sorted([*first, (5, 60, 60), (5, 60, 60), (5, 61, 0)]),
    )
    assert R.drop_repeats(docs.select("doc_id", F.lit("one text").alias("text"))).count() == 6


@pytest.mark.parametrize("seed", range(20))
def test_each_window_has_an_anchor_that_equal_windows_share(seed):
    r = random.Random(seed)
    alphabet = "abcdefgh"[: 2 + seed % 7]
    shared = [r.choice(alphabet) for _ in range(40)]
    texts = [
        [r.choice(alphabet) for _ in range(r.randint(0, 30))] + shared + [r.choice(alphabet) for _ in range(r.randint(0, 30))]
        for _ in range(8)
    ]
    words = [w.encode() for t in texts for w in t]
    bounds = offsets([len(t) for t in texts])
    names, start, first, number = R.anchors(hashes(words), bounds)
    assert number.sum() == sum(max(len(t) - 19, 0) for t in texts)
    seen = {}
    for name, at, f, n in zip(names, start, first, number, strict=True):
        for s in range(f, f + n):
            key = tuple(words[s : s + 20])
            assert seen.setdefault(key, (name, at - s)) == (name, at - s)
            assert s <= at < s + 20


def test_equal_words_get_equal_names_inside():
    words = hashes([b"%d" % (i * i % 41) for i in range(200)])
    alone = R.recompress(words, offsets([200]))
    moved = R.recompress(np.concatenate([hashes([b"q", b"r"]), words]), offsets([202]))
    inside = {(n, s) for n, s, a, b in zip(*alone, strict=True) if a >= 0 and b <= 200}
    other = {(n, s - 2) for n, s, a, b in zip(*moved, strict=True)}
    assert inside and inside <= other
