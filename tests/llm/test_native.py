"""Line dedup, chat formatting and archives: operators of Spark expressions."""

import hashlib
import random
import time

from cartulary.llm import chat, warc
from cartulary.llm.line_dedup import drop_shared_lines
from pyspark.sql import functions as F
from tests.llm.cases import LONG, ODD_TEXTS, empty_documents, given_texts

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_left(rows):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_lines(spark):
    shared = "A line that Stands in many texts", "Éa line with capitals ÀÉ outside ascii"
    extra = [(5000 + i, f"own {i}\n {shared[i % 2].upper() if i % 3 else shared[i % 2]}\t\n\n{shared[0]}\r\n{shared[0]}") for i in range(9)]
    odd = [(7000 + i, t) for i, t in enumerate([*ODD_TEXTS, LONG, LONG, LONG, "\n" * 500])]
    rows = [*given_texts(spark), *extra, *odd]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_lines int, gone string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in drop_shared_lines(docs).collect()}
    assert found == lines_left(rows)
    assert drop_shared_lines(docs).columns == ["doc_id", "text", "gone", "n_lines", "n_dropped"]


def test_time_is_in_proportion_to_the_lines_dropped(spark):
    """A text is split once, not once for each of its shared lines."""

    def seconds(number):
        rows = [(d, "\n".join(f"a line that three share, {i}" + (f"\nown {d}" if i % 50 == 0 else "") for i in range(number))) for d in range(3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        start = time.perf_counter()
        found = {r.doc_id: r.n_dropped for r in drop_shared_lines(docs).collect()}
        assert found == {0: number, 1: number, 2: 0}
        return time.perf_counter() - start

    seconds(1000)
    small, large = seconds(16_000), seconds(64_000)
    assert large < 8 * small + 2 and large < 30


def test_lines_of_repeated_rows_and_none(spark):
    line = "this line has enough characters"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.text) for r in drop_shared_lines(docs).collect())
    assert found == [(-1, ""), (1, ""), (1, ""), (2, line)]
    assert drop_shared_lines(empty_documents(spark)).collect() == []


def test_chats_come_back(spark):
    r = random.Random(8)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>user\n", "<|im_sep|>", "<\\|im_end|>", "[\\\\/INST]", "\\", "<", "$1", "é\n", "<</SYS>>"]
    rows = [
        (c, t, r.choice(["user", "assistant", "assistant", "system", None, "odd\nrole%0A<|im_end|>"]), r.choice([None, "", "".join(r.choices(bits, k=r.randint(0, 9)))]))
        for c in range(40)
        for t in range(r.randint(1, 8))
    ]
    rows += [(99, 0, "user", LONG), (99, 0, "user", LONG), (None, None, None, None)]
    turns = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, turns int")
    chats = chat.format_chats(turns)
    read = chats.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] if x[1] is not None else -1, x[2] or "", x[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    found = {x.conv_id: x for x in read.collect()}
    assert found.keys() == expected.keys()
    for c, want in expected.items():
        assert [tuple(t) for t in found[c].t] == want
        assert found[c].l == [t for role, t in want if role == "assistant"]
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_archives_come_back(spark, tmp_path):
    start = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, start * 9, "WARC/1.1\r\n" * 20, "é\r\n" * 5000, "z" * 1000 + "\r\n\r\n", LONG]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)]
    rows += [(50, "u", "again " * 50), (50, "u", "again " * 50), (None, None, "n" * 200), (51, None, "n" * 200)]
    pages = spark.createDataFrame([(*x, 0) for x in rows], "page_id long, url string, html string, record int")
    folder = warc.write_archives(warc.record_rows(pages, chunk_chars=700), str(tmp_path / "archives"))
    found = sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, folder).collect()),
        key=lambda r: (r[0] if r[0] is not None else -1, r[3]),
    )
    expected = []
    for i, h in enumerate(html):
        data = (h or "").encode()
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if i == 5 else "response", 4 if i == 5 else None))
    again, null = hashlib.sha256(b"again " * 50).hexdigest(), hashlib.sha256(b"n" * 200).hexdigest()
    expected += [(50, 300, again, "response", None), (50, 300, again, "revisit", 50), (51, 200, null, "revisit", None)]
    assert found == [(None, 200, null, "response", None), *expected]
    none = warc.write_archives(warc.record_rows(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_records(spark, none).collect() == []
