"""Hard negatives against every score computed."""

import math
import random

import numpy as np
import pytest
from cartulary.llm import hard_negatives
from pyspark.sql import functions as F
from tests.llm.cases import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, every, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) from all products, in Python's whole numbers."""
    known = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256.0 * x) for x in vector)
        if sum(x * x for x in whole) <= 1 << 62:
            known[i, label, whole] = None
    out = []
    for i, label, query in known:
        if i % every:
            continue
        score = lambda v: sum(a * b for a, b in zip(v, query, strict=False))  # noqa: B023, E731
        same = sorted((-score(v), j) for j, k, v in known if k == label and j != i)[:positives]
        other = sorted((-score(v), j) for j, k, v in known if k != label)
        for best, positive in same:
            inside = [(s, j) for s, j in other if 30 * -best <= 100 * -s <= 90 * -best][:negatives]
            out += [(i, positive, n, j, -best, -s) for n, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def check(spark, rows, every=100):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", score int").repartition(3)
    mined = hard_negatives.mine(df, F.col("vec_id") % every == 0)
    assert mined.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(map(tuple, mined.collect()))
    assert found == brute_force(rows, every)
    return found


@pytest.fixture
def small_parts(monkeypatch):
    """Many nodes, shards and blocks on few rows."""
    for name, value in {
        "SAMPLE_ROWS": 256, "CENTRES": 5, "LEAST_SHARD": 40, "SHARD_SHARE": 50, "QUERY_BLOCK": 7,
        "QUERIES_AT_ONCE": 3, "FANOUT": 4, "LEAF": 5,
    }.items():
        monkeypatch.setattr(hard_negatives, name, value)


def clustered(seed, number, size, clusters):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(clusters, size))
    which = r.integers(0, clusters, number)
    vectors = middles[which] + 0.2 * r.normal(size=(number, size))
    return [(i, v.tolist(), int(w % 4)) for i, (v, w) in enumerate(zip(vectors, which, strict=True))]


def test_given_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert check(spark, rows, 10)


def test_clusters_in_many_shards(spark, small_parts):
    assert check(spark, clustered(1, 500, 8, 9), 20)


def test_copies_of_a_vector_ties_and_signs(spark, small_parts):
    r = random.Random(2)
    rows = [(i, [0.5, 0.25, -1.0], i % 2) for i in range(150)]
    rows += [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], r.randint(0, 2)) for i in range(150, 400)]
    rows += [(400, [0.0, 0.0, 0.0], 1), (500, [-1.0, -1.0, -1.0], 0)]
    assert check(spark, rows, 20)


def test_odd_rows(spark, small_parts):
    rows = clustered(3, 60, 4, 3)
    rows += [
        (100, None, 1), (110, [1.0, None, 0.0, 0.0], 1), (120, [math.nan] * 4, 1), (130, [math.inf, 0.0, 0.0, 0.0], 0),
        (None, [1.0] * 4, 1), (140, [1.0] * 4, None), (150, [], 1), (160, [2.0], 0), (170, [1.0] * 6, 1),
        (180, [1e300, 0.0], 0), (190, [1e12, 0.0, 0.0, 0.0], 0), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]),
        (10, [0.5, 0.5, 0.5, 0.5], 2), (10, [0.5, 0.5, 0.25, 0.5], 2),
    ]
    assert check(spark, rows, 10)


def test_products_beyond_the_range_of_doubles_are_exact(spark, small_parts):
    r = random.Random(9)
    rows = [(i, [float(r.randint(1, 1 << 21)) + r.random() for _ in range(3)], i % 3) for i in range(120)]
    assert check(spark, rows, 10)


def test_no_rows_no_anchors_no_positives(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert check(spark, [(0, [1.0], 0), (1, [0.5], 1)]) == []
    assert check(spark, [(0, [0.0], 0), (1, [0.0], 0), (2, [0.0], 1)]) == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_trees_skip_nodes():
    rows = clustered(5, 3000, 6, 12)
    vectors = np.floor(256 * np.array([v for _, v, _ in rows]))
    longest = int((vectors**2).sum(1).max())
    space = hard_negatives.Space(6, longest)
    ids, labels = np.arange(3000), np.array([k for *_, k in rows])
    tree = hard_negatives.CoverTree(space, ids, labels, ids, vectors)
    queries = vectors[:50]
    low, high = space.bounds(queries @ tree.centres.T, np.linalg.norm(queries, axis=1), tree.radii)
    below = {}
    for node in reversed(range(len(tree.runs))):
        a, b = tree.runs[node]
        start = tree.first[node]
        parts = [below[c] for c in range(start, start + tree.number[node])]
        below[node] = np.concatenate(parts) if parts else np.arange(a, b)
        products = queries @ tree.vectors[below[node]].T
        assert (products.max(1) <= high[:, node]).all() and (products.min(1) >= low[:, node]).all()
    assert sorted(below[0].tolist()) == list(range(3000))
    every = [[(0, hard_negatives._LEAST, hard_negatives._MOST)]] * 50
    wanted = hard_negatives.Wanted(ids[:50], labels[:50], True, 5, every)
    take, looked = wanted.take, []

    def counted(which, scores, *rest):
        looked.append(scores.size)
        take(which, scores, *rest)

    wanted.take = counted
    tree.search(queries, wanted)
    assert sum(looked) < 0.5 * 50 * 3000
    products = queries @ vectors.T
    for k in range(50):
        other = [(-int(products[k, i]), i) for i in range(3000) if labels[i] == labels[k] and i != k]
        assert [(s, i) for s, i, _ in wanted.found[k][0]] == sorted(other)[:5]
