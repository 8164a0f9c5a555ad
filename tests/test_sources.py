"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import tables as S
from plumbline.streaming import traces as Z


def test_directory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_text("one")
    (tmp_path / "y.md").write_text("two")
    (tmp_path / "z.pdf").write_bytes(b"%PDF")
    (tmp_path / "w.csv").write_text("no")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    rows = {r.source_file: r for r in S.read_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.TXT", "y.md", "z.pdf", "b.txt"}
    assert rows["x.TXT"].text == "one" and rows["z.pdf"].error == "no PDF reader" and rows["b.txt"].error == "not UTF-8"
    with pytest.raises(Exception):
        S.read_directory(spark, str(tmp_path / "missing")).count()


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"\n')
    rows = S.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string").cache().collect()
    assert sum(r._corrupt_record is None for r in rows) == 1 and len(rows) == 2


def test_traces(spark, tmp_path):
    for day, body in (("2024-01-01", {"trace_id": "a", "generated_answer": "x"}), ("2024-01-02", {"trace_id": "b"})):
        (tmp_path / f"date={day}").mkdir()
        (tmp_path / f"date={day}" / "t.json").write_text(json.dumps(body))
    (tmp_path / "date=2024-01-02" / "bad.json").write_text("{")
    good, bad = S.read_traces(spark, str(tmp_path), "trace_id string, generated_answer string")
    assert [r.trace_id for r in good.cache().collect()] == ["a"] and bad.count() == 1


def test_publish(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, v array<double>")
    S.publish(chunks, vectors, str(tmp_path / "s"))
    assert S.published(spark, str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError):
        S.publish(chunks, vectors.limit(1), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        S.publish(chunks.limit(0), vectors.limit(0), str(tmp_path / "s"))
    assert S.published(spark, str(tmp_path / "s")).count() == 2


def test_versions_are_restored_and_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    make = lambda ids: (spark.createDataFrame([(i, i) for i in ids], "chunk_id string, text string"), spark.createDataFrame([(i, [1.0]) for i in ids], "chunk_id string, v array<double>"))
    one, two = S.publish(*make("ab"), path), S.publish(*make("bc"), path)
    assert S.versions(spark, path) == [one, two] and {r.chunk_id for r in S.published(spark, path).collect()} == {"b", "c"}
    assert [r.chunk_id for r in S.obsolete_ids(S.published(spark, path, one), S.published(spark, path)).collect()] == ["a"]
    S.restored(spark, path, one)
    assert {r.chunk_id for r in S.published(spark, path).collect()} == {"a", "b"}
    three = S.publish(*make("d"), path)
    assert S.pruned(spark, path, 2) == [two] and [r.chunk_id for r in S.published(spark, path).collect()] == ["d"] and S.versions(spark, path)[-1] == three
    with pytest.raises(ValueError):
        S.restored(spark, path, "v0")


def test_checkpoints_drop_a_torn_last_line_only(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"example_id": "1", "x": 1}\n\n{"example_id": "2", "x": 2}\n{"example_id": "3", "x"')
    (tmp_path / "b.jsonl").write_text('{"example_id": "4", "x": 4}\n')
    read = lambda: S.checkpoint_records(spark, str(tmp_path), "example_id string, x int")
    assert sorted((r.example_id, r.x) for r in read().collect()) == [("1", 1), ("2", 2), ("4", 4)]
    (tmp_path / "c.jsonl").write_text('{"example_id": "5"\n{"example_id": "6", "x": 6}\n')
    with pytest.raises(Exception, match="corrupt record inside .*c.jsonl, in the bytes from 0: .*5"):
        read().collect()


def test_a_large_log_is_read_by_many_tasks(spark, tmp_path):
    name = tmp_path / "big" / "log.jsonl"
    name.parent.mkdir()
    name.write_text("".join(f'{{"example_id":{i}, "text": "{"x" * 40}"}}\n' for i in range(200_000)) + '{"example_id": 7, "te')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = S.checkpoint_records(spark, str(tmp_path / "big"), "example_id long, text string")
        assert spark.read.text(str(tmp_path / "big")).rdd.getNumPartitions() > 8 and rows.agg(F.sum("example_id"), F.count("*")).first() == (199_999 * 100_000, 200_000)
        whole = name.read_bytes()
        at = whole.index(b'"example_id":150000')
        name.write_bytes(whole[: at - 1] + b"#" + whole[at:])
        with pytest.raises(Exception, match="corrupt record inside .*in the bytes from [1-9]"):
            S.checkpoint_records(spark, str(tmp_path / "big"), "example_id long, text string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checkpoint_files_are_fewer_than_users(spark, tmp_path, monkeypatch):
    """Files hold many users' records, every one with a torn line at its end (before: a file for each user)."""
    from plumbline.plans import surface

    rows = spark.range(3000).selectExpr("id as event_id", "if(id % 1000 = 7, null, id % 750 * 1000003) as user_id")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(surface, "_folder", lambda s, name: str(tmp_path / name))
    got = {(r.user_id, r.n) for r in surface.checkpoint_repair(spark, str(tmp_path)).collect()}
    assert got == {(r.user_id, r["count"]) for r in rows.groupBy("user_id").count().collect()}
    files = list((tmp_path / "records").rglob("*.txt"))
    assert 1 < len(files) < 12
    for f in files:
        lines = f.read_text().splitlines()
        assert lines[-1] == '{"example_id": 1, "us' and all(x.endswith("}") for x in lines[:-1])


def test_only_one_of_two_publishers_takes_a_number(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([("a",)], "chunk_id string")
    path = str(tmp_path / "s")
    first = S.publish(one, one.withColumn("v", F.lit(1)), path)
    (tmp_path / "s" / "pointers" / "000000000002-claim").write_text("")  # a publisher that broke off: its number is passed over
    second = S.publish(one, one.withColumn("v", F.lit(2)), path)
    assert S.versions(spark, path) == [first, second]
    monkeypatch.setattr(S, "_numbers", lambda files, place: [1, 2])  # both looked before either wrote
    with pytest.raises(RuntimeError, match="published meanwhile"):
        S.publish(one, one.withColumn("v", F.lit(3)), path)
    assert S.versions(spark, path) == [first, second]


def test_database_reads_ranges_under_filters(spark, tmp_path):
    from plumbline.sources import datasources as D

    D.register(spark)
    rows = spark.range(1000).selectExpr("id", "id % 7 as kind", "if(id % 3 = 0, null, concat('t', id)) as title", "id / 2 as score")
    path = str(tmp_path / "memory.db")
    D.write_database(rows, path)
    read = spark.read.format("memory_database").option("path", path).option("rows", "120").load()
    assert read.dtypes == [("id", "bigint"), ("kind", "bigint"), ("title", "string"), ("score", "double")]
    assert read.rdd.getNumPartitions() == 9 and sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    some = read.where("kind = 3 and title is not null and id >= 100 and kind in (3, 4) and title like 't1%'")
    want = rows.where("kind = 3 and title is not null and id >= 100 and title like 't1%'").count()
    assert some.count() == want
    reader = D.DatabaseReader(path, "observations", 120, {"id": "long", "kind": "long", "title": "string", "score": "double"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull

    left = list(reader.pushFilters([EqualTo(("kind",), 3), IsNotNull(("title",)), GreaterThanOrEqual(("id",), 100), EqualTo(("other",), 1)]))
    assert left == [EqualTo(("other",), 1)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == rows.where("kind = 3 and title is not null and id >= 100").count()  # rows that leave the database
    with pytest.raises(Exception, match="no table"):
        spark.read.format("memory_database").option("path", path).option("table", "none").load()


def test_databases_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """One file for each partition, empty ones too; no rows come to the driver."""
    from pyspark.sql import DataFrame

    from plumbline.sources import datasources as D

    D.register(spark)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    rows = spark.range(0, 1000, 1, 5).selectExpr("id", "if(id % 3 = 0, null, concat('t', id)) as title", "id / 2 as score", "cast(id as int) as small").where("id >= 200")
    assert D.write_databases(rows, str(tmp_path)) == 800 and len(list(tmp_path.iterdir())) == 5
    read = spark.read.format("memory_database").option("path", str(tmp_path)).option("rows", "120").load()
    assert read.rdd.getNumPartitions() == 8 and sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    assert read.where("id >= 500 and title is null").count() == rows.where("id >= 500 and title is null").count()
    (tmp_path / "none").mkdir()
    D.write_databases(rows.where("id < 0"), str(tmp_path / "none"))
    none = spark.read.format("memory_database").option("path", str(tmp_path / "none")).load()
    assert none.columns == rows.columns and none.count() == 0


def test_appended_lines_are_read_once(spark, tmp_path):
    from plumbline.sources import datasources as D

    D.register(spark)
    log, out = tmp_path / "logs", str(tmp_path / "out")
    log.mkdir()

    def run():
        rows = spark.readStream.format("appended_lines").option("path", str(log)).option("bytes", "64").load()
        Z.to_table(rows, out, str(tmp_path / "state"))
        return sorted((r.path.rsplit("/", 1)[-1], r["at"], r.line) for r in spark.read.schema("path string, at long, line string").parquet(out).collect())

    lines = [f"line {i} " + "é" * (i % 9) for i in range(40)]
    (log / "a.log").write_text("\n".join(lines[:30]) + "\ntorn li")
    first = run()
    assert [x[2] for x in first] == lines[:30]
    (log / "a.log").write_text("\n".join(lines[:30]) + "\ntorn line\n" + "\n".join(lines[30:]) + "\n")
    (log / "b.log").write_text("one\r\n\ntwo\nthree")
    second = run()
    assert [x[2] for x in second if x[0] == "a.log"] == [*lines[:30], "torn line", *lines[30:]]
    assert [(x[1], x[2]) for x in second if x[0] == "b.log"] == [(0, "one"), (5, ""), (6, "two")]
    assert run() == second


def test_tags_cut_anywhere_give_the_same_parts():
    text = "so <b <thinking>a < b <answer</thinking>\n<answer>x</answer>tail <"
    want = Z.split_text(text)
    for n in (1, 2, 3, 5, 7, 11, 100):
        mode, held, parts = "answer", "", {"thinking": "", "answer": ""}
        for at in range(0, len(text), n):
            mode, held, found = Z.split_step(mode, held, text[at : at + n])
            assert len(held) < 12
            for kind, part in found:
                parts[kind] += part
        assert (parts["thinking"].strip(), parts["answer"].strip()) == want
    assert want == ("a < b <answer", "so <b \nxtail")


def test_upsert_and_vectors(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([("2", "c", 1.0)], "k string, v string, extra double")
    got = {str(r.k): r.v for r in S.upserted(old.withColumn("k", F.col("k").cast("string")), new, "k").collect()}
    assert got == {"1": "a", "2": "c"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "id int, embedding array<double>")
    assert sorted(r.id for r in S.bad_vectors(v).collect()) == [2, 3, 4]


def test_exports(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a,b")], "session_id int, ordinal int, role string, text string")
    assert json.loads(S.session_export(m, "json").first().document)[1]["text"] == "a,b"
    assert S.session_export(m, "csv").first().document.startswith("role,text\nuser,hi")
    assert "**user**: hi" in S.session_export(m, "markdown").first().document


@pytest.mark.parametrize("text,parts", [("<thinking>a</thinking><answer>b</answer>", ("a", "b")), ("plain <b", ("", "plain <b")), ("<answer>b</ans", ("", "b")), ("x <thinking>y", ("y", "x"))])
def test_tags(text, parts):
    assert Z.split_text(text) == parts


def test_resume_twice_writes_once(spark, data, tmp_path):
    for _ in range(2):
        rows = Z.source(spark, f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        Z.to_table(Z.resumed(rows, "event_id", "ts"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{data}/events.parquet").count()
