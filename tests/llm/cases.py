"""Small tables that every operator has to cope with."""

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n",
    "\t\n \x0b\x0c\r",
    "a",
    "12345 67890",
    "one two three",
    "été 你好世界 \U0001f600\U0001f680 naïve",
    "x y z\x1cw\x85v​u",
    "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a",
    "line\r\nline\r\n\r\nline",
    "same text " * 30,
    "same text " * 30,
    "Same Text " * 30,
]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], DOCUMENTS)


def empty_documents(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCUMENTS))


def given_texts(spark, number=None):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows[:number]]


def read_back(df):
    """Rows by the first column, which has to be unique."""
    rows = df.collect()
    found = {r[0]: r for r in rows}
    assert len(found) == len(rows)
    return found
