"""Fill-in-the-middle against a plain version, and its chunks against counting."""

import hashlib
import random

import numpy as np
from cartulary.llm import infilling
from cartulary.llm.common import offsets
from pyspark.sql import functions as F
from tests.llm.cases import LONG, ODD_TEXTS, documents, empty_documents, given_texts


def brute_force(i, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text)
    return (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, form string")
    df = infilling.fill_in_middle(docs).withColumn("back", infilling.restore(F.col("output"), F.col("form")))
    found = sorted(map(tuple, df.collect()), key=repr)
    assert found == sorted((brute_force(i, t) for i, t in rows), key=repr)
    return found


MARKED = ["<P>", "a<S>", "<M", "P>", "<<P>>", "<P <S <M", "x" * 70 + "<S>" + "y" * 70, "<p>", "ends in <", "> starts"]


def test_given_documents_in_all_forms(spark):
    forms = {r[2] for r in check(spark, given_texts(spark))}
    assert forms == {"plain", "psm", "spm"}


def test_odd_texts_ids_and_repeated_rows(spark):
    rows = list(enumerate([*ODD_TEXTS, LONG, "é你\U0001f600" * 5000, "a" * 50_000, *MARKED]))
    rows += [(None, "no id"), (None, None), (-7, "negative id"), (1 << 62, "large id"), (3, "same"), (3, "same")]
    check(spark, rows)
    r = random.Random(5)
    letters = ["<", ">", "P", "S", "M", "é", "\U0001f600", "\n", "a"]
    check(spark, [(i, "".join(r.choices(letters, k=r.randint(0, 40)))) for i in range(500)])


def test_no_rows_and_one(spark):
    assert infilling.fill_in_middle(empty_documents(spark)).collect() == []
    assert infilling.fill_in_middle(documents(spark, [None])).first().output == ""


def test_marks_across_the_ends_of_chunks(monkeypatch):
    monkeypatch.setattr(infilling, "LEAST_CHUNK", 1)
    text = b"ab<P>cd<S>e<M"
    for ends in ([3, 13], [4, 13], [2, 5, 13], [3, 4, 13]):
        expected = True
        assert infilling.Cuts(text, ends, infilling.Chunks()).marked == expected
    for ends in ([2, 4], [1, 4], [4]):
        assert not infilling.Cuts(b"<P S", ends, infilling.Chunks()).marked


def test_chunks_depend_on_content_and_cover_the_text():
    r = random.Random(2)
    shared = bytes(r.choices(range(32, 127), k=60_000))
    texts = [shared, bytes(r.choices(range(32, 127), k=777)) + shared, b"", b"a", b"ab" * 30_000, shared[:500]]
    ends = infilling.chunk_ends(b"".join(texts), offsets([len(t) for t in texts]))
    cut = []
    for text, found, base in zip(texts, ends, offsets([len(t) for t in texts]).tolist(), strict=False):
        places = [0, *(e - base for e in found)]
        assert places[-1] == len(text) and sorted(set(places)) == places
        assert all(b - a >= infilling.LEAST_CHUNK for a, b in zip(places[:-2], places[1:-1], strict=True))
        cut.append([text[a:b] for a, b in zip(places[:-1], places[1:], strict=True)])
        alone = infilling.chunk_ends(text, offsets([len(text)]))[0]
        assert alone == places[1:]
    assert len(set(cut[0]) & set(cut[1])) > 0.8 * len(cut[0]) > 20


def test_places_equal_counting_and_the_cache_is_bounded():
    r = random.Random(4)
    text = "".join(r.choices(["a", "é", "你", "\U0001f600"], k=5000))
    data = text.encode()
    chunks = infilling.Chunks(limit=1000)
    cuts = infilling.Cuts(data, infilling.chunk_ends(data, offsets([len(data)]), 100)[0], chunks)
    assert cuts.length == len(text)
    for point in [0, 1, 2499, 4999, 5000, *(r.randrange(5000) for _ in range(300))]:
        assert cuts.place(point) == len(text[:point].encode())
    assert chunks.held <= 1000 or len(chunks.known) == 1
    kept = next(iter(chunks.known))
    assert chunks.of(kept) is chunks.known[kept]
    assert np.array_equal(infilling.rolling_hashes(np.zeros(40, np.uint8))[20:25], np.repeat(infilling.rolling_hashes(np.zeros(40, np.uint8))[30], 5))
