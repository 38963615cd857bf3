import random
from collections import Counter

import numpy as np
import pyarrow as pa

from cartulary.llm import decontamination as D
from cartulary.llm.common import offsets, shingle_hashes
from tests.llm.cases import LONG, ODD_TEXTS, SMALL, documents, empty_documents, given_texts


def bag(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_force(docs, items, threshold=0.8):
    """The best window of an item's size in each document, compared outright."""
    out = {}
    for doc, text in docs:
        words = D.words(text)
        for item, own in items:
            target = D.words(own)
            if not target or not words:
                continue
            size = min(5, len(target))
            goal = bag(target, size)
            best, where = 0.0, 0
            for s in range(max(len(words) - len(target), 0) + 1):
                here = bag(words[s : s + len(target)], size)
                if here:
                    both = sum((here & goal).values())
                    found = both / (sum(here.values()) + sum(goal.values()) - both)
                    if found > best:
                        best, where = found, s
            if best >= threshold:
                out[doc, item] = (where, round(best, 9))
    return out


def check(spark, docs, items):
    found = D.find_items(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    expected = brute_force(docs, items)
    assert {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in found} == expected
    assert len(found) == len(expected)
    return expected


def test_given_documents(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert check(spark, given_texts(spark), items)


def test_edited_items_in_documents(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(40)]
    docs = []
    for i in range(150):
        text = [word() for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            passage = r.choice(items)[1].split()
            for _ in range(r.randint(0, 2)):
                if len(passage) > 30:
                    passage[r.randrange(len(passage))] = "edited"
            at = r.randint(0, len(text))
            text[at:at] = [w.upper() + r.choice(["", ",", "."]) for w in passage]
        docs.append((i, " ".join(text)))
    assert len(check(spark, docs, items)) > 50


def test_items_whose_edited_tail_repeats_a_run_of_words(spark):
    r = random.Random(5)
    items, docs = [], []
    for i, size in enumerate([59, 104, 154, 304] * 4):
        own = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
        items.append((i, " ".join(own)))
        # As long a tail as leaves a similarity of 0.8 just within.
        tail = size - 4 - -(-8 * (size - 4) // 9)
        docs.append((i, " ".join(["before", *own[: size - tail], *["again"] * tail, "after"])))
    assert check(spark, docs, items).keys() == {(i, i) for i in range(len(items))}


def test_odd_texts(spark):
    part = " ".join(LONG.split()[3000:3040])
    check(spark, list(enumerate([*ODD_TEXTS, LONG])), [(0, part), (1, None), (2, ""), (3, "..."), (4, "Same, text"), (5, "a a a a a a a")])


def test_no_rows_repeated_rows_and_other_columns(spark):
    items = spark.createDataFrame([(1, "p q r s t u v"), (1, "p q r s t u v")], "item_id long, text string")
    assert D.find_items(empty_documents(spark), items).collect() == []
    assert D.find_items(documents(spark, ["a"]), items.limit(0)).collect() == []
    docs = spark.createDataFrame(
        [(None, "x p q r s t u v", 1), (4, "P q R s t, u v", 2), (4, "P q R s t, u v", 2)], "doc_id long, text string, start int"
    )
    found = sorted((r.doc_id or -1, r.item_id, r.start, r.n_words, r.similarity) for r in D.find_items(docs, items).collect())
    assert found == [(-1, 1, 1, 7, 1.0), (4, 1, 0, 7, 1.0), (4, 1, 0, 7, 1.0)]


def test_several_passes_give_the_same(spark, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    once = sorted(map(tuple, D.find_items(docs, items).collect()))
    monkeypatch.setattr(D, "ITEM_BYTES", 20_000)
    assert once and sorted(map(tuple, D.find_items(docs, items).collect())) == once


def test_short_stretches_give_the_same(monkeypatch):
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 300)}"
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(20)]
    texts = []
    for _ in range(60):
        text = [word() for _ in range(r.randint(0, 100))]
        for _ in range(3):
            at = r.randint(0, len(text))
            text[at:at] = r.choice(items)[1].split()
        texts.append(" ".join(text))
    part = pa.RecordBatch.from_pydict({"id": list(range(60)), "text": texts})
    index = D.ItemIndex(items)
    expected = sorted(D._found(part, index, 0.8))
    assert {(d, i): (s, round(x, 9)) for d, i, s, _, x in expected} == brute_force(list(enumerate(texts)), items)
    for size in (1, 7, 50):
        monkeypatch.setattr(D, "STRETCH", size)
        assert sorted(D._found(part, index, 0.8)) == expected


def test_blocks_find_all_fingerprints_within_the_radius():
    r = np.random.default_rng(4)
    prints = r.integers(0, 256, (50, 8), dtype=np.uint8)
    near = D._BITS[np.arange(256, dtype=np.uint8)[:, None, None] ^ prints[None]] <= D.BLOCK_RADIUS
    for _ in range(2000):
        item = r.integers(50)
        flips = r.choice(64, r.integers(0, D.RADIUS + 1), replace=False)
        bits = np.unpackbits(prints[item])
        bits[flips] ^= 1
        other = np.packbits(bits)
        assert any(near[other[b], item, b] for b in range(8))


def test_window_fingerprints_weigh_repeated_shingles():
    words = np.arange(9, dtype=np.uint64) + np.uint64(5)
    shingles, _ = shingle_hashes(words, offsets([9]), 5)
    twice = np.concatenate([shingles[:1]] * 3 + [shingles[1:3]])
    one = D.window_simhashes(twice, np.array([0]), np.array([5]))
    assert (one == D.window_simhashes(shingles[:1], np.array([0]), np.array([1]))).all()
