"""SimHash near duplicates against every pair compared."""

import random

import numpy as np
import pytest
import xxhash
from cartulary.llm import simhash
from tests.llm.cases import LONG, ODD_TEXTS, documents, empty_documents, given_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, size=3):
    words = (text or "").translate(LOWER).encode().split()
    runs = [words[i : i + size] for i in range(len(words) - size + 1)] or ([words] if words else [])
    found = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in found) > len(found))


def brute_roots(prints, radius=2):
    """The least print that links lead to, from all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    array = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= radius).tolist():
            a, b = find(p), find(prints[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def expected(rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, print int, root int")
    df = simhash.near_duplicates(docs)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_and_edited_documents(spark):
    r = random.Random(3)
    rows = given_texts(spark)
    for i, t in list(rows)[:80]:
        words = (t or "").split()
        for n in range(3):
            if words:
                words[r.randrange(len(words))] = f"e{n}"
            rows.append((10_000 + 10 * i + n, " ".join(words).upper() if n % 2 else "\x0b ".join(words)))
    r.shuffle(rows)
    result = found(spark, rows)
    assert result == expected(rows)
    prints = {}
    for _, p, c in result:
        prints.setdefault(c, set()).add(p)
    assert any(len(p) > 1 for p in prints.values())  # some differ and are linked


def test_odd_texts_null_and_repeated_ids(spark):
    rows = list(enumerate([*ODD_TEXTS, LONG, LONG + " tail"]))
    rows += [(None, "one two three"), (None, "a b c d e f g"), (3, "a"), (3, "a"), (2, "x y z"), (None, None)]
    assert found(spark, rows) == expected(rows)


def test_no_rows_and_one(spark):
    assert simhash.near_duplicates(empty_documents(spark)).collect() == []
    assert [r.component_id for r in simhash.near_duplicates(documents(spark, [None])).collect()] == [0]


def test_long_texts_are_hashed_in_parts():
    text = LONG.encode()
    whole = np.concatenate(list(simhash.shingle_digests(text, limit=1 << 30)))
    for limit in (1000, 7777, 100_000):
        assert np.array_equal(np.concatenate(list(simhash.shingle_digests(text, limit=limit))), whole)
    short = [np.concatenate(list(simhash.shingle_digests(b" a  b c\n", limit=n))).tolist() for n in (1, 2, 50)]
    assert short[0] == short[1] == short[2] == [xxhash.xxh64_intdigest(b"a b c", 42)]


@pytest.mark.parametrize("bucket", [0, 3, 32])
def test_links_of_prints_in_buckets_of_any_size(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    prints = {r.getrandbits(64) for _ in range(300)}
    for centre in [0, (1 << 64) - 1, 1 << 63, r.getrandbits(64)]:
        # A dense group in a few bits, chains, and others just too far away.
        prints |= {centre ^ sum(1 << k for k in r.sample(range(12), r.randint(0, 8))) for _ in range(60)}
        for _ in range(30):
            prints.add(centre)
            centre ^= sum(1 << k for k in r.sample(range(64), r.randint(1, 4)))
    df = spark.createDataFrame([(simhash._long(p),) for p in prints], "print long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.close_prints(df).collect()]
    assert all(0 < bin(a ^ b).count("1") <= 2 for a, b in links)
    roots, mine = brute_roots(prints), {p: p for p in prints}

    def find(p):
        while mine[p] != p:
            p = mine[p]
        return p

    for a, b in links:
        p, q = find(a), find(b)
        mine[max(p, q)] = min(p, q)
    assert {p: find(p) for p in prints} == roots


def test_masks_leave_no_close_pair_apart():
    masks = simhash.key_masks(2)
    assert len(masks) == 10 and all(bin(m).count("1") >= 38 for m in masks)
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_an_odd_radius_is_an_error(spark):
    with pytest.raises(ValueError):
        simhash.close_prints(spark.createDataFrame([(1,)], "print long"), 3)
