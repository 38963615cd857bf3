"""Extraction, language identification and fingerprints."""

import html
import itertools
import random
import re

import numpy as np
from cartulary.llm import extraction, language, winnowing
from cartulary.llm.queries import MULTILINGUAL, op6_fingerprints
from pyspark.sql import functions as F
from tests.llm.cases import LONG, ODD_TEXTS, SMALL, documents, empty_documents, given_texts


def article(source):
    inside = re.sub(r"<[^>]*$", "", source.split("<article>")[1].split("</article>")[0])
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inside)]
    return "\n".join(p for p in parts if p)


def test_articles_of_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r.page_id: r.text for r in extraction.extract_pages(pages).collect()}
    assert found == {r.page_id: article(r.html) for r in pages.collect()}


def test_held_out_layouts():
    forest = extraction.Forest()
    for page in extraction.labelled_pages(100, seed=123):
        forest.add(page)
    truth = []
    for parent, label in zip(forest.parent, forest.label, strict=True):
        truth.append(label == "1" if label else parent >= 0 and truth[parent])
    content = extraction.marginals(extraction.arrays(forest), extraction.trained())[0] > 0.5
    right = [content[n] == truth[n] for n, text, _ in forest.texts if text.strip()]
    assert sum(right) / len(right) > 0.98


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain", "<", "<p", "<p>a&am", "<!-- never closed", "<script>x", "<div>" * 3000 + "deep", "<p>" + LONG, "</p></div>", "<p a=\"<b>\">x"]
    pages = spark.createDataFrame([(i, h, "old") for i, h in enumerate(odd)], "page_id int, html string, text string")
    found = extraction.extract_pages(pages).collect()
    assert len(found) == len(odd) and all(r.text is not None for r in found)
    assert [found[i].text for i in (0, 1, 2, 5, 7, 8)] == [""] * 6
    assert extraction.extract_pages(pages.limit(0)).collect() == []


SENTENCES = (
    "A paragraph in the middle of an article holds two or three sentences, as this one does. "
    "It is here, like all others around it, to be read by whoever opened the page."
)


def test_attributes_are_read_by_name():
    """Names and values that only look like those that matter leave a paragraph where it is."""
    plain = "<p>"
    odd = [
        '<p title="Hidden gem">', '<p data-id="nav">', "<p title=it's>", '<p data-class=menu hidden-note="x">',
        "<p lang='en' title='a > b'>", '<p title = "class=nav id=footer">', "<p title=a=b>", "<p/>", '<p x">',
    ]
    pages = []
    for opening in [plain, *odd]:
        body = "".join(f"<p>{SENTENCES} {i}</p>" for i in range(3))
        pages.append(f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{body}{opening}don't {SENTENCES}</p>{body}</article><footer>Copyright</footer></body></html>")
    forest = extraction.Forest()
    for page in pages:
        forest.add(page)
    texts = extraction.extract(forest, extraction.trained())
    assert f"don't {SENTENCES}" in texts[0]
    assert all(t == texts[0] for t in texts)
    unclosed = extraction.Forest()
    unclosed.add(f'<article><p>{SENTENCES}</p><p title="unbalanced>{SENTENCES}</p></article>')
    assert extraction.extract(unclosed, extraction.trained()) == [SENTENCES]


def test_marginals_equal_sums_over_all_labellings():
    r = random.Random(6)
    model = extraction.trained()
    for _ in range(25):
        forest = extraction.Forest()
        parts = r.choices(["<p>some text here", "</p>", "<div class=nav>", "</div>", "<b>bold</b>", "<ul><li>one", "</ul>", "<aside>x", "</aside>"], k=r.randint(1, 9))
        forest.add("".join(parts))
        data = extraction.arrays(forest)
        n = len(data.parent)
        if n > 12:
            continue
        scores = data.features @ model.weights
        total, single, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for states in itertools.product((0, 1), repeat=n):
            score = sum(scores[i] for i in range(n) if states[i])
            for i in range(n):
                if data.parent[i] >= 0:
                    score += model.pairs[data.kind[i], states[data.parent[i]], states[i]]
            weight = np.exp(score)
            total += weight
            single += weight * np.array(states)
            for i in range(n):
                if data.parent[i] >= 0:
                    pairs[i, states[data.parent[i]], states[i]] += weight
        found, joint = extraction.marginals(data, model)
        assert np.allclose(found, single / total, atol=1e-9)
        assert np.allclose(joint, pairs / total, atol=1e-9)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    training = language.is_training(F.col("doc_id"))
    model = language.fit(docs.where(training), MULTILINGUAL)
    held = language.identify(docs.where(~training & (F.length("text") > 40)), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = language.identify(documents(spark, [*ODD_TEXTS, LONG]), model).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert all(0 <= r.score <= 1 for r in odd)
    untaught = language.fit(docs.limit(0), MULTILINGUAL)
    assert {r.lang_pred for r in language.identify(documents(spark, ["a", None]), untaught).collect()} == {"und"}
    assert language.identify(empty_documents(spark), model).collect() == []


def test_forward_sums_all_segmentations():
    vocab = language.pieces(MULTILINGUAL)
    import numpy as np

    chances = np.random.default_rng(1).random((vocab[2], 1)) / 1000
    data = language.stretches("ner")[0]
    import base64

    known = {base64.b64decode(x.split()[0]): i for i, x in enumerate(open(MULTILINGUAL, "rb"))}

    def total(rest):
        if not rest:
            return 1.0
        return sum(chances[known[rest[:k]], 0] * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in known)

    assert abs(language.forward(vocab, [data], chances)[0, 0] - np.log(total(data))) < 1e-9


def brute_winnow(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    import numpy as np

    n = max(len(text) - gram + 1, 1 if text else 0)
    hashes = []
    for i in range(n):
        points = np.array([ord(c) for c in text[i : i + gram]], np.uint32)
        hashes.append(int(winnowing.gram_hashes(points, np.array([0]), np.array([len(points)]))[0]))
    kept = []
    for s in range(max(n - window + 1, 1) if n else 0):
        part = list(enumerate(hashes[s : s + window], s))
        low = min(h for _, h in part)
        best = max(p for p, h in part if h == low)
        if not kept or kept[-1][1] != best:
            kept.append((low, best))
    return kept


def test_winnowing():
    texts = [*(t or "" for t in ODD_TEXTS), "abcab" * 60, LONG[:900], "a" * 300]
    found = [list(zip(h.tolist(), p.tolist(), strict=True)) for h, p in winnowing.winnow(texts)]
    assert found == [brute_winnow(t) for t in texts]


def test_next_texts_and_edited_texts(spark):
    rows = [*given_texts(spark), *((9000 + 3 * i, t) for i, t in enumerate(ODD_TEXTS))]
    for parts in (1, 5, 40):
        found = winnowing.with_next(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()
        texts = [t or "" for _, t in rows]
        expected = [(i, t, n) for (i, _), t, n in zip(rows, texts, texts[1:] + texts[:1], strict=True)]
        assert sorted(map(tuple, found)) == expected
    assert winnowing.with_next(empty_documents(spark)).collect() == []
    assert [tuple(r) for r in winnowing.with_next(documents(spark, ["a"])).collect()] == [(0, "a", "a")]
    result = op6_fingerprints(spark, SMALL).collect()
    assert len(result) == len(given_texts(spark))
    assert sum(r.near_edited > r.near_next for r in result) > 0.9 * len(result)


def test_short_texts_are_like_their_edited_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r for r in docs.where("length(text) >= 200").orderBy("doc_id").limit(130).collect()]
    # Any text that keeps 15 characters in its first half, however long the rest.
    short = [r.asDict() | {"text": r.text[:n], "n_chars": n} for n, r in enumerate(rows, 29)]
    spark.createDataFrame(short, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op6_fingerprints(spark, str(tmp_path)).collect()}
    assert len(found) == len(short) == 130
    texts = [r["text"] for r in short]
    for row, text, following in zip(short, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        x, y = ({h for h, _ in brute_winnow(t)} for t in (text, edited))
        near = found[row["doc_id"]].near_edited
        assert near == len(x & y) / len(x | y) and near > 0
        assert near < 1 or text == edited


def test_pieces_and_words_of_any_length_are_summed():
    """Pieces over 8 bytes, cuts across byte 32, and words whose chance is no float, in plain logs."""
    import base64

    import numpy as np

    vocab = language.pieces(MULTILINGUAL)
    known = {base64.b64decode(x.split()[0]): i for i, x in enumerate(open(MULTILINGUAL, "rb"))}
    longest = max(map(len, known))
    chances = np.random.default_rng(2).random((vocab[2], 2)) / 1e6
    for word in ("действительно", "internationalization" * 3, "ありがとうございました", "ab" * 400):
        (data,) = language.stretches(word)
        logs, uses = [np.zeros(2)], np.zeros(vocab[2])
        for end in range(1, len(data) + 1):
            ways = [
                logs[k] + np.log(chances[known[data[k:end]]])
                for k in range(max(0, end - longest), end)
                if data[k:end] in known
            ]
            logs.append(np.logaddexp.reduce(ways, axis=0))
        assert np.allclose(language.forward(vocab, [data], chances)[0], logs[-1], rtol=1e-12)
        uses = language.expected(vocab, [data, data], np.array([1.0, 2.0]), chances[:, 0])
        covered = sum(uses[number] * len(piece) for piece, number in known.items())
        assert abs(covered - 3 * len(data)) < 1e-6 * len(data)
