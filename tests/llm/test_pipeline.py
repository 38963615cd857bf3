"""The pipeline, stage by stage and as a whole, against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import language
from cartulary.llm.queries import BYTE_BPE, MULTILINGUAL
from tests.llm import test_decontamination, test_jaccard
from tests.llm.cases import LONG, ODD_TEXTS, SMALL
from tests.llm.test_native import lines_left

tokenizers = pytest.importorskip("tokenizers")

LINE = "this very line stands in several documents of the corpus"


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """A folder of tables with planted cases, its documents by id, and the benchmark."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.where("doc_id < 60").collect()]
    like = next(r for r in rows if r["lang"] == "en" and r["text"])
    words = like["text"].split()
    edited = " ".join([*words, "one", "more"])
    planted = [
        *ODD_TEXTS,
        like["text"],
        edited,
        f"{items[0][1]} and {like['text'][:80]}",
        *(f"{r['text']}\n{LINE}\n{i}" for i, r in enumerate(rows[:4])),
        LINE,
        LONG[:3000],
    ]
    start = max(r["doc_id"] for r in rows) + 10
    rows += [like | {"doc_id": start + i, "text": t, "lang": None} for i, t in enumerate(planted)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r["doc_id"]: r["text"] for r in rows}, items


def languages_known(spark, folder, texts):
    """Texts whose language the model tells, judged one at a time."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs.where(language.is_training(F.col("doc_id"))), MULTILINGUAL)
    vocab = language.pieces(MULTILINGUAL)
    out = {}
    for i, text in texts.items():
        (lang,), (score,) = language.predict(model, vocab, [text])
        if lang != language.UNDETERMINED and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            out[i] = text
    return out


def test_each_stage_and_the_whole(spark, given):
    folder, texts, items = given
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)

    texts = languages_known(spark, folder, texts)
    expected = [texts]
    texts = {i: left for i, (left, _, _) in lines_left(list(texts.items())).items()}
    expected.append(texts)
    classes = test_jaccard.brute_force(list(texts.items()))
    texts = {i: t for i, t in texts.items() if classes[i][0] == i}
    expected.append(texts)
    dirty = {doc for doc, _ in test_decontamination.brute_force(list(texts.items()), items)}
    texts = {i: t for i, t in texts.items() if i not in dirty}
    expected.append(texts)
    assert len(given[1]) > len(expected[0]) > len(expected[2]) > len(texts) > 0
    assert expected[0] != expected[1]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (_, stage), left in zip(corpus_pipeline.STAGES, expected, strict=False):
        columns = docs.schema
        docs = stage(spark, docs, folder).cache()
        assert docs.schema == columns or docs.columns == columns.names
        found = docs.collect()
        assert {r.doc_id: r.text for r in found} == left and len(found) == len(left)
    assert all(r.n_chars == len(r.text) for r in found)

    coded = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in coded) == sorted(texts)
    for r in coded:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_columns_named_like_those_of_the_operators_keep_their_values(spark, given):
    names = ["lang_pred", "score", "n_lines", "n_dropped", "class_id", "n_links", "ids", "decoded", "item_id"]
    docs = spark.read.parquet(f"{given[0]}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, given[0])
        assert left.columns == docs.columns
        wrong = [F.col(c) != F.concat(F.lit(f"{c} of "), "doc_id") for c in names]
        assert left.where(F.array_contains(F.array(*wrong), True)).count() == 0
    assert corpus_pipeline.encode(spark, docs, given[0]).count() == docs.count()


def test_one_row_of_a_group_stays_if_ids_repeat_or_are_null(spark, given):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    rows = [
        *[(1, words[0]), (1, words[0]), (7, f"{words[0]} more")],
        *[(None, words[1]), (None, words[1]), (None, f"{words[1]} more")],
        *[(None, words[2]), (9, words[2]), (9, words[2])],
        *[(3, words[3]), (3, words[4]), (2, words[3])],
        *[(6, words[5]), (6, f"{words[5]} more")],
        *[(None, words[6])],
        *[(4, ""), (4, ""), (4, None), (4, None), (4, " "), (5, ""), (None, ""), (None, "")],
    ]
    docs = spark.read.parquet(f"{given[0]}/documents.parquet")
    filled = {"lang": "en", "source": "s", "n_chars": 1}
    rows = [tuple({**filled, "doc_id": i, "text": t}.get(c) for c in docs.columns) for i, t in rows]
    docs = spark.createDataFrame(rows, docs.schema).repartition(3)
    found = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, given[0]).collect()]
    nulls = sorted(t for i, t in found if i is None)
    assert len(nulls) == 4 and nulls[:2] == ["", ""] and nulls[3] == words[6]
    assert nulls[2] in (words[1], f"{words[1]} more")
    known = sorted((i, "-" if t is None else t) for i, t in found if i is not None)
    sixth = next(t for i, t in known if i == 6)
    assert sixth in (words[5], f"{words[5]} more")
    assert known == sorted(
        [(1, words[0]), (9, words[2]), (2, words[3]), (3, words[4]), (6, sixth), (4, ""), (4, "-"), (4, " "), (5, "")]
    )


def test_no_documents(spark, given, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
