import random

from cartulary.llm import jaccard
from cartulary.llm.components import components
from tests.llm.cases import LONG, ODD_TEXTS, documents, empty_documents, given_texts, read_back


def shingles(text, size=5):
    words = (text or "").encode().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_force(rows, threshold=0.8):
    """Every pair compared: links per document and the least id of what they lead to."""
    sets = {i: shingles(t) for i, t in rows}
    links, root = {i: 0 for i in sets}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in sets}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = read_back(jaccard.near_duplicates(docs))
    expected = brute_force(rows)
    assert {i: (r.class_id, r.n_links) for i, r in found.items()} == expected
    return expected


def test_given_documents(spark):
    expected = check(spark, given_texts(spark))
    assert any(n for _, n in expected.values())


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
    return words


def test_copies_chains_and_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(11)
    rows, text = [], [f"w{r.randint(0, 5000)}" for _ in range(150)]
    rows += [" ".join(text)] * 40  # copies
    rows += [" ".join(edited(r, text, r.randint(1, 3))) for _ in range(120)]  # one large group
    for _ in range(12):  # small groups, some of which are chains
        own = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(own))
            own = edited(r, own, 1 + len(own) // 60)
    r.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_odd_texts(spark):
    check(spark, list(enumerate([*ODD_TEXTS, LONG, LONG + " tail"])))


def test_null_ids_repeated_rows_other_columns_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(None, text, 1), (5, text, 2), (5, text, 2), (9, text, 3), (7, None, 0)],
        "doc_id long, text string, copy int",
    )
    found = sorted(jaccard.near_duplicates(docs).collect(), key=lambda r: (r.doc_id or -1))
    assert [(r.doc_id, r.class_id, r.n_links) for r in found] == [
        (None, None, 0), (5, 5, 2), (5, 5, 2), (7, 7, 0), (9, 5, 2),
    ]
    assert jaccard.near_duplicates(empty_documents(spark)).collect() == []
    assert read_back(jaccard.near_duplicates(documents(spark, ["x"])))[0].n_links == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.bands_and_rows(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= jaccard.RECALL
        assert bands * rows <= jaccard.MAX_HASHES


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    apart = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in apart}
