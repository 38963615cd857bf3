import hashlib

from pyspark.sql import functions as F

from cartulary.operators import generation, prompts
from cartulary.sources import cache as caching
from cartulary.sources.cache import ResponseCache

PROMPT = "Describe the orders table with columns order_id, user_id"
ANSWER = "Stores all customer purchase transactions."


def entries(spark, pairs):
    return caching.cache_entries(spark.createDataFrame(pairs, "prompt string, response string"))


def asked(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "prompt string")


def counting_generator(folder):
    """Answers with the prompt in capitals and notes every prompt it is asked in a file."""

    def make():
        import os
        import uuid

        def respond(batch, lengths):
            for prompt, length in zip(batch, lengths):
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as note:
                    note.write(f"{prompt}/{length}")
            return [f" {prompt.upper()}\n" for prompt in batch]

        return respond

    return make


def notes(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_keys_are_digests_of_utf8(spark):
    for text in (PROMPT, "größe → ñ", ""):
        found = asked(spark, text).select(caching.prompt_key(F.col("prompt"))).first()[0]
        assert found == hashlib.md5(text.encode()).hexdigest()


def test_cache_folder(spark, rows, tmp_path):
    for fmt in ("parquet", "json"):
        cache = ResponseCache(spark, str(tmp_path / fmt), fmt)
        assert rows(cache.stats(), "total_cached", "exists") == [(0, False)]
        cache.save(entries(spark, [(PROMPT, ANSWER)]))
        found = caching.look_up(asked(spark, PROMPT, "other"), cache.load())
        assert sorted(rows(found, "prompt", "response"), key=str) == sorted(
            [(PROMPT, ANSWER), ("other", None)], key=str
        )
        assert rows(cache.load(), "prompt_preview") == [(PROMPT + "...",)]
        cache.save(entries(spark, [(PROMPT, "Later."), ("x" * 150, "y")]))
        assert rows(cache.stats(), "total_cached", "exists") == [(2, True)]
        assert ("Later.", PROMPT + "...") in rows(cache.load(), "response", "prompt_preview")
        assert ("y", "x" * 100 + "...") in rows(cache.load(), "response", "prompt_preview")
        before = sorted(rows(cache.load()))
        cache.compact()
        assert sorted(rows(cache.load())) == before
        assert all(len(batches) == 1 for batches in cache.batches().values())
        cache.clear()
        assert rows(cache.stats(), "total_cached") == [(0,)]


def test_only_misses_are_generated_and_only_once(spark, rows, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    cache.save(entries(spark, [("known", "cached"), ("blank", "")]))
    texts = ["known", "blank", "new", "new", "new", "other"]
    found = generation.answer_with(asked(spark, *texts), cache, counting_generator(str(folder)))
    expected = {"known": "cached", "blank": "BLANK", "new": "NEW", "other": "OTHER"}
    for _ in range(2):
        assert sorted(rows(found, "prompt", "response")) == sorted((t, expected[t]) for t in texts)
    assert notes(folder) == ["blank/150", "new/150", "other/150"]
    again = generation.answer_with(asked(spark, *texts), cache, counting_generator(str(folder)))
    assert again.count() == 6 and len(notes(folder)) == 3


def test_entries_are_written_aside_before_they_are_joined(spark, rows, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    limited = generation.with_max_length(asked(spark, "a", "b", "a"), "column")
    found, merged = generation.answer_from(
        limited, caching.empty_cache(spark), counting_generator(str(folder))
    )
    for _ in range(3):
        assert sorted(rows(found, "response")) == [("A",), ("A",), ("B",)]
    assert merged.count() == 2
    assert notes(folder) == ["a/80", "b/80"]


def test_many_prompts_make_many_tasks(spark, monkeypatch):
    def tasks(number):
        found = spark.range(number).select(F.concat(F.lit("p"), "id").alias("prompt"))
        missing = caching.misses(found, caching.empty_cache(spark))
        answered = generation.generate(missing, counting_tasks())
        return answered.select("response").distinct().count()

    def counting_tasks():
        def make():
            import uuid

            name = uuid.uuid4().hex
            return lambda batch, lengths: [name] * len(batch)

        return make

    assert tasks(1) == 1
    assert 1 < tasks(200) <= 8
    monkeypatch.setattr(generation, "PROMPTS_PER_TASK", 10)
    assert tasks(200) > 8


def columns(spark, rows):
    return spark.createDataFrame(
        rows, "table_name string, column_name string, clean_type string, null_pct double"
    )


def samples(spark, rows):
    return spark.createDataFrame(
        rows, "table_name string, column_name string, values array<string>"
    )


def test_table_prompt(spark):
    counts = [("t", 1000), ("empty", None)]
    tables = spark.createDataFrame(counts, "table_name string, row_count long")
    cols = columns(spark, [("t", f"c{i:02}", "string", 0.0) for i in range(12, 0, -1)])
    shown = samples(
        spark,
        [
            ("t", "c02", ["a", "b", "c", "d"]),
            ("t", "c03", ["x"]),
            ("t", "c04", []),
            ("t", "c05", ["y"]),
            ("t", "c06", ["beyond the first five"]),
        ],
    )
    found = {r[0]: r[1] for r in prompts.table_prompts(tables, cols, shown).collect()}
    names = ", ".join(f"c{i:02}" for i in range(1, 11))
    tail = (
        f"Table name: t\nColumns: {names}\nRow count: 1000\n"
        "Sample values: \n- c02: a, b, c\n- c03: x\n- c05: y\n\nDescription:"
    )
    assert found["t"].endswith(tail)
    assert found["t"].startswith("You are a senior data engineer writing documentation")
    assert found["empty"].endswith(
        "Columns: \nRow count: None\nSample values: Not available\n\nDescription:"
    )


def test_at_most_three_columns_are_sampled(spark):
    tables = spark.createDataFrame([("t", 1)], "table_name string, row_count long")
    cols = columns(spark, [("t", f"c{i}", "string", 0.0) for i in range(5)])
    shown = samples(spark, [("t", f"c{i}", ["v"]) for i in range(5)])
    text = prompts.table_prompts(tables, cols, shown).first()["prompt"]
    assert "\n- c0: v\n- c1: v\n- c2: v\n\n" in text and "c3: v" not in text


def test_column_prompt(spark):
    cols = columns(spark, [("t", "a", "string", 0.5), ("t", "b", "text", None)])
    shown = samples(spark, [("t", "a", list("pqrstu"))])
    found = {r["column_name"]: r["prompt"] for r in prompts.column_prompts(cols, shown).collect()}
    assert found["a"].endswith(
        "Table: t\nColumn: a\nData type: string\nNullable: Yes\n"
        "Sample values: p, q, r, s, t\n\nDescription:"
    )
    assert "Nullable: No\nSample values: Not available\n" in found["b"]


def test_tag_and_relationship_prompts(spark):
    described = spark.createDataFrame([("t", "Orders.")], "table_name string, description string")
    cols = columns(spark, [("t", f"c{i}", "string", 0.0) for i in range(9)])
    text = prompts.tag_prompts(described, cols).first()["prompt"]
    names = ", ".join(f"c{i}" for i in range(8))
    assert text.endswith(f"Table: t\nColumns: {names}\nDescription: Orders.\n\nTags:")
    links = spark.createDataFrame(
        [("a", "b", "c", "d")],
        "source_table string, source_column string, target_table string, target_column string",
    )
    text = prompts.relationship_prompts(links).first()["prompt"]
    assert text.endswith("Relationship:\na.b references c.d\n\nExplanation:")


def test_the_text_of_a_prompt_passes_one_shuffle(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    asked = spark.range(1000).selectExpr("concat('prompt ', id % 10) as prompt")
    known = spark.range(5).selectExpr("md5(concat('prompt ', id)) as key", "'yes' as response")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        missing = caching.misses(asked, known)
        plan = missing._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert sorted(r["prompt"] for r in missing.collect()) == [f"prompt {i}" for i in range(5, 10)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_lookup_opens_the_buckets_of_its_keys_only(spark, rows, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    cache.save(entries(spark, [(f"prompt {i}", f"answer {i}") for i in range(500)]))
    cache.save(entries(spark, [("prompt 3", "later")]))
    assert len(cache.batches()) == 16 and sum(map(len, cache.batches().values())) == 17
    wanted = ("prompt 3", "prompt 4", "none")
    digits = {hashlib.md5(p.encode()).hexdigest()[0] for p in wanted}
    keys = asked(spark, *wanted).select(caching.prompt_key(F.col("prompt")).alias("key"))
    found = cache.answers(keys)
    assert {f.split("bucket=")[1][0] for f in found.inputFiles()} == digits
    assert sorted(rows(found, "response")) == [("answer 4",), ("later",)]


def test_buckets_of_one_batch_are_read_without_comparing(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    cache.save(entries(spark, [(f"prompt {i}", "x") for i in range(200)]))
    plan = cache.load()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    cache.save(entries(spark, [("prompt 3", "later")]))
    plan = cache.load()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan
    assert cache.load().count() == 200


def test_entries_are_sorted_and_have_bloom_filters(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    cache.save(entries(spark, [(f"prompt {i}", "x") for i in range(300)]))
    pq = __import__("pyarrow.parquet").parquet
    files = list((tmp_path / "cache").rglob("*.parquet"))
    assert len(files) == 16
    for file in files:
        keys = pq.read_table(str(file), columns=["key"], partitioning=None).column("key").to_pylist()
        assert keys == sorted(keys)
    with_filters = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(
        spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(str(files[0]))
    )
    column = with_filters.getBlocks().get(0).getColumns().get(0)
    assert column.getPath().toDotString() == "key" and column.getBloomFilterOffset() > 0


def test_texts_of_known_prompts_do_not_move(spark, rows, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    cache.save(entries(spark, [(f"prompt {i}", f"a{i}") for i in range(50)]))
    many = spark.range(200).selectExpr("id", "concat('prompt ', id % 50) as prompt")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = generation.answer_with(many, cache, counting_generator(str(tmp_path)))
        plan = found.select("id", "response")._jdf.queryExecution().executedPlan()
        shuffled = [line for line in plan.toString().split("\n") if "Exchange" in line]
        assert shuffled and not any("prompt" in line for line in shuffled)
        assert dict(rows(found, "id", "response")) == {i: f"a{i % 50}" for i in range(200)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def dying_generator(folder, fatal):
    """Notes what it answers; dies at one prompt once all others are answered."""

    def make():
        import os
        import time
        import uuid

        def respond(batch, lengths):
            for prompt in batch:
                if prompt == fatal:
                    time.sleep(3)
                    raise RuntimeError("the generator died")
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as note:
                    note.write(prompt)
            return [p.upper() for p in batch]

        return respond

    return make


def test_a_failed_run_loses_only_unfinished_tasks(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(generation, "PROMPTS_PER_TASK", 2)
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    cache.save(entries(spark, [("known", "yes")]))
    texts = ["known", *(f"p{i}" for i in range(20))]
    folders = [tmp_path / "first", tmp_path / "second"]
    for f in folders:
        f.mkdir()
    try:
        generation.answer_with(asked(spark, *texts), cache, dying_generator(str(folders[0]), "p7")).count()
        raise AssertionError("the run should have failed")
    except Exception as error:
        assert "the generator died" in str(error)
    kept = {r[0] for r in rows(cache.journal(), "response")}
    assert kept
    assert rows(cache.stats(), "total_cached") == [(1,)]
    found = generation.answer_with(asked(spark, *texts), cache, dying_generator(str(folders[1]), ""))
    assert dict(rows(found, "prompt", "response")) == {t: "yes" if t == "known" else t.upper() for t in texts}
    again = set(notes(folders[1]))
    assert {t.upper() for t in again} == {f"P{i}" for i in range(20)} - kept
    cache.compact()
    assert rows(cache.stats(), "total_cached") == [(21,)] and cache.journal() is None
