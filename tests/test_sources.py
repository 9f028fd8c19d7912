import csv
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.plans.corpus import load_corpus, prepare_corpus
from askloom.sources import dumps, records, sinks

QUESTIONS = (
    "Id,OwnerUserId,CreationDate,ClosedDate,Score,Title,Body\n"
    '1,26.0,2008-08-01T13:57:07Z,NA,4,"A ""quoted"" title","<p>line one\nline two é</p>"\n'
    "2,NA,2008-08-02T00:00:00Z,2009-01-01T00:00:00Z,-1,Second,<p>b</p>\n"
)
ANSWERS = (
    "Id,OwnerUserId,CreationDate,ParentId,Score,Body\n"
    "10,5.0,2008-08-01T14:00:00Z,1,3,<p>first</p>\n"
    "11,NA,2008-08-01T15:00:00Z,1,3,<p>second</p>\n"
    "12,6.0,2008-08-01T16:00:00Z,99,1,<p>orphan</p>\n"
)
TAGS = "Id,Tag\n1,python\n1,null\n1,NA\n"


@pytest.fixture()
def dump(tmp_path):
    paths = {}
    for name, text in (("questions", QUESTIONS), ("answers", ANSWERS), ("tags", TAGS)):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode("latin-1"))
        paths[name] = str(path)
    return paths


def test_staging(spark, dump):
    got = dumps.stage_questions(dumps.read_questions(spark, dump["questions"])).orderBy("Id").collect()
    assert [r["OwnerUserId"] for r in got] == [26, None]
    assert got[0]["Title"] == 'A "quoted" title' and got[0]["Body"] == "<p>line one\nline two é</p>"
    assert got[0]["ClosedDate"] is None and got[1]["Score"] == -1
    tags = dumps.stage_tags(dumps.read_tags(spark, dump["tags"]))
    assert sorted(r["Tag"] for r in tags.collect()) == ["NA", "null", "python"]


def test_dump_options(spark, dump):
    some = dumps.read_questions(spark, dump["questions"], drop_columns={"Body"}, limit=1)
    assert "Body" not in some.columns and some.count() == 1
    with pytest.raises(ValueError):
        dumps.read_tags(spark, dump["tags"], drop_columns={"Id", "Tag"})


def test_missing_inputs_are_listed_together(spark, dump, tmp_path):
    paths = {**dump, "answers": str(tmp_path / "no1"), "tags": str(tmp_path / "no2")}
    with pytest.raises(FileNotFoundError) as error:
        dumps.required_inputs(spark, paths)
    assert "no1" in str(error.value) and "no2" in str(error.value) and "questions" not in str(error.value)


def test_malformed_rows_fail(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Id,Tag\n1,a,b,c\n")
    with pytest.raises(Exception):
        dumps.read_tags(spark, str(path)).collect()


def test_a_missing_id_fails(spark):
    rows = spark.createDataFrame([(None, "t")], "Id string, Tag string")
    with pytest.raises(Exception, match="Id is not a whole number"):
        dumps.stage_tags(rows).collect()


@pytest.mark.parametrize(
    "text, number",
    [("26.0", 26), ("26", 26), ("NaN", None), ("", None), ("x", None), (None, None), ("9007199254740993", 9007199254740993)],
)
def test_nullable_int(value, text, number):
    assert value(dumps.nullable_int_cast(F.col("x")), row=(text,)) == number


def test_load_corpus_twice(spark, dump, tmp_path):
    root = str(tmp_path / "tables")
    first = load_corpus(spark, dump, root).collect()
    second = load_corpus(spark, dump, root).collect()
    assert sorted(first) == sorted(second)
    assert [(r["question_id"], r["answer_id"], r["tags"]) for r in sorted(second)] == [
        (1, 10, "NA, null, python"), (1, 11, "NA, null, python"),
    ]
    stored = prepare_corpus(spark.read.parquet(f"{root}/qa_documents"), str(tmp_path / "chunks"), dim=64)
    again = prepare_corpus(spark.read.parquet(f"{root}/qa_documents"), str(tmp_path / "chunks"), dim=64)
    assert sorted(r["chunk_id"] for r in again.collect()) == ["q1_a10_c0", "q1_a11_c0"]
    assert {r["dim"] for r in stored.collect()} == {256}


def test_insert_if_absent(spark):
    incoming = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3), (3, "d", 4)], "k int, v string, o int")
    existing = spark.createDataFrame([(3, "old", 0)], "k int, v string, o int")
    new = sinks.insert_if_absent(incoming, existing, ["k"], ["o"])
    assert sorted((r["k"], r["v"]) for r in new.collect()) == [(1, "a"), (2, "c")]
    assert sinks.insert_if_absent(incoming, None, ["k"], ["o"]).count() == 3


CHUNKS = (
    "chunk_id string, question_id string, answer_id string, chunk_index int, title string, tags string, "
    "question_score int, answer_score int, chunk_text string, embedding array<double>"
)


def test_chunk_contract(spark):
    df = spark.createDataFrame(
        [
            ("a", "1", "2", 0, "t", "g", 1, 1, "x", [0.5]),
            ("b", "1", "2", 0, "t", "g", 1, 1, "x", None),
            ("c", "one", "2", 0, "t", "g", 1, 1, "x", [0.5]),
            (None, "1", "2", 0, "t", "g", 1, 1, "x", [0.5]),
        ],
        CHUNKS,
    )
    valid, rejects = sinks.chunk_sink_contract(df)
    assert [r["chunk_id"] for r in valid.collect()] == ["a"]
    assert dict(valid.dtypes)["embedding"] == "array<float>"
    assert sorted(r["reason"] for r in rejects.collect()) == [
        "chunk_id is missing", "embedding is missing", "question_id is not a whole number",
    ]
    with pytest.raises(ValueError, match=r"\['tags', 'title'\]"):
        sinks.chunk_sink_contract(df.drop("title", "tags"))
    with pytest.raises(TypeError):
        sinks.chunk_sink_contract(df.withColumn("embedding", F.lit("x")))
    empty_valid, empty_rejects = sinks.chunk_sink_contract(df.limit(0))
    assert empty_valid.count() == 0 and empty_rejects.count() == 0


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, 'say "x"\nnow')], "id int, t string").repartition(2)
    path = str(tmp_path / "out")
    sinks.csv_sink(df, path, sep=";", files=1)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    back = spark.read.csv(path, header=True, sep=";", escape='"', multiLine=True, schema="id int, t string")
    assert sorted(map(tuple, back.collect())) == [(1, "a;b"), (2, 'say "x"\nnow')]


def test_document_batches(spark, sf):
    with pytest.raises(ValueError):
        dumps.read_documents(spark, f"{sf}/documents.parquet", 0)
    assert dumps.read_documents(spark, f"{sf}/documents.parquet").count() == 200
    with pytest.raises(ValueError):
        dumps.read_documents(spark, f"{sf}/documents.parquet", 50)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = [dumps.read_documents(spark, f"{sf}/documents.parquet", n, sizes, "n long").collect() for n in (30, 64)]
    assert [[r["n"] for r in m] for m in made] == [[30] * 6 + [20], [64] * 3 + [8]]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_rename(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert dumps.rename_columns(df, {"a": "b", "zz": "y"}).columns == ["b"]


def hard_csv(path, rows, ends, encoding="latin-1"):
    with open(path, "w", encoding=encoding, newline="") as file:
        writer = csv.writer(file, lineterminator=ends)
        writer.writerow(["Id", "x", "y"])
        writer.writerows(rows)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_one_large_file_is_read_in_splits(spark, tmp_path, ends):
    """The rows and their order are those of the one-task reader, wherever a border lies."""
    rng = random.Random(3)
    parts = ["a", '"', ",", "\n", "\r\n", "é", "NA", " ", "xx", '""', "\n\n"]
    rows = [[i, *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in "xy")] for i in range(300)]
    rows.insert(150, ["long", "line\n" * 900, '",\n' * 300])  # longer than a split
    path = str(tmp_path / "hard.csv")
    hard_csv(path, rows, ends)
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in sizes}
    columns = ("Id", "x", "y")
    want = [tuple(r) for r in dumps.read_dump(spark, path, columns).collect()]
    assert len(want) == 301
    try:
        spark.conf.set(sizes[0], "1000b")
        spark.conf.set(sizes[1], "1b")
        assert records.numbered_lines(spark, path, "ISO-8859-1").rdd.getNumPartitions() >= 8
        got = records.read_csv_records(spark, path, columns, encoding="ISO-8859-1", null_value="NA", arrival=True)
        inside = records.numbered_lines(spark, path, "ISO-8859-1").where("at = 1 AND split > 0")
        spark.conf.set(sizes[0], "100000b")
        got = got.orderBy(*records.ARRIVAL).drop(*records.ARRIVAL)
        assert [tuple(r) for r in got.collect()] == want
        spark.conf.set(sizes[0], "1000b")
        # Some splits begin inside a quoted field.
        marks = [r["line"] for r in inside.where("split BETWEEN 4000 AND 9000").collect()]
        assert any("," not in line or line.startswith('""') for line in marks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_split_reader_options(spark, tmp_path, dump):
    same = [dumps.read_questions(spark, dump["questions"], one_task_bytes=n).collect() for n in (0, 1 << 20)]
    assert sorted(map(repr, same[0])) == sorted(map(repr, same[1]))
    one = dumps.read_tags(spark, dump["tags"], one_task_bytes=0, drop_columns={"Id"}, limit=2)
    assert one.columns == ["Tag"] and one.count() == 2
    assert dumps.largest_file(spark, str(tmp_path)) == len(QUESTIONS.encode("latin-1"))
    bad = tmp_path / "bad.csv"
    bad.write_text("Id,Other\n1,a\n")
    with pytest.raises(ValueError, match="header"):
        dumps.read_tags(spark, str(bad), one_task_bytes=0)
    bad.write_text("﻿Id,Tag\n1,a,b,c\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        dumps.read_tags(spark, str(bad), one_task_bytes=0, encoding="UTF-8").collect()
    bad.write_text("Id,Tag\n")
    assert dumps.read_tags(spark, str(bad), one_task_bytes=0).count() == 0
    with pytest.raises(ValueError, match="split"):
        records.read_records(spark, str(bad), encoding="UTF-16")


def test_split_reader_stores_no_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('"Id","Tag"\n"1","x"\n"2","y\nz"\n')
    stored, land = [], records.land
    monkeypatch.setattr(records, "land", lambda df, label: stored.append(df.columns) or land(df, label))
    got = records.read_csv_records(spark, str(tmp_path / "a.csv"), ("Id", "Tag")).collect()
    assert sorted(tuple(r) for r in got) == [("1", "x"), ("2", "y\nz")]
    assert len(stored) == 1 and "line" not in stored[0]
