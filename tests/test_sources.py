"""Readers, declared schemas, lineage, feeds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tributary.schema import parse_schema
from tributary.session import fresh_path
from tributary.sources import readers, records, workbook
from tributary.streaming import feeds


def read(spark, tmp_path, data: bytes):
    path = tmp_path / "export.csv"
    path.write_bytes(data)
    return readers.read_csv_export(spark, str(path))


def test_csv_cells_tokens_and_empty_rows(spark, tmp_path):
    df = read(spark, tmp_path, b' A ,B\n x ,"1,5"\nNA,\n,null\n"say ""hi""",007\n')
    assert df.columns == ["A", "B", "row_idx"]
    assert [tuple(r) for r in df.orderBy("row_idx").collect()] == [(" x ", "1,5", 0), ('say "hi"', "007", 1)]


def test_csv_line_break_in_a_cell_and_latin1(spark, tmp_path):
    assert readers.csv_layout(spark, str(write(tmp_path, "a.csv", b'A,B\n"one\ntwo",2\n'))) == ("UTF-8", True)
    df = read(spark, tmp_path, b'A,B\n"one\ntwo",2\n3,4\n')
    assert [r["A"] for r in df.orderBy("row_idx").collect()] == ["one\ntwo", "3"]
    df = read(spark, tmp_path, "A,B\nJosé,1\n".encode("latin-1"))
    assert df.first()["A"] == "José"
    df = read(spark, tmp_path, "A,B\nJosé,1\n".encode("utf-8-sig"))
    assert df.columns[0] == "A" and df.first()["A"] == "José"


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return path


def test_dense_index_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5003).alias("k"))
    got = readers.dense_index(rows, [F.col("k")]).orderBy("k").collect()
    assert [r["row_idx"] for r in got] == list(range(5000))


def test_schema_shapes():
    assert parse_schema(["id_no", "email", "age"]).match_keys == ("email", "id_no")
    full = parse_schema({"fields": {"code": "string", "birth_date": None, "x": {"required": True}}, "primary_key": "code"})
    assert [(f.name, f.type, f.required) for f in full] == [("code", "string", False), ("birth_date", "date", False), ("x", "string", True)]
    assert full.match_keys == ("code",) and full.entity == "record"
    assert parse_schema({"fields": [{"field": "work e-mail"}, "n"]}).fields[0].type == "email"
    for empty in ({}, {"fields": []}, []):
        with pytest.raises(ValueError):
            parse_schema(empty)


def test_activity_stream_continues_from_its_checkpoint(spark):
    path, out, mark = fresh_path(spark, "feed"), fresh_path(spark, "out"), fresh_path(spark, "mark")
    schema = "run_id bigint, id bigint, ts timestamp, action string, reason string"

    def append(ids):
        rows = [(1, i, None, "activity:map:x" if i % 2 else "cleaned_value", f"m{i}") for i in ids]
        feeds.append_audit(spark.createDataFrame(rows, schema), path)

    for ids, want in (([1, 2, 3], [3]), ([4, 5], [3, 5])):
        append(ids)
        feeds.follow_activity(feeds.audit_stream(spark, path, schema), 1, out, mark).awaitTermination()
        got = spark.read.parquet(out).orderBy("id").collect()
        assert [r["id"] for r in got] == want
        assert {r["stage"] for r in got} == {"map:x"}


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as Fake

    from tributary import session

    def fake(master, named):
        return Fake(conf=Fake(get=lambda key, default: named), sparkContext=Fake(master=master, applicationId="app-1"))

    assert session.shared_dir(fake("yarn", "hdfs:/shared/")) == "hdfs:/shared"
    assert session.shared_dir(fake("local[2]", None)) == session.shared_dir(fake("local[2]", None))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake("yarn", None))


def test_csv_rows_with_too_many_cells_are_never_cut(spark, tmp_path):
    path = str(write(tmp_path, "ragged.csv", b'A,B\n1,2\n3,4,5\n6\n"7,8",9\n"x,y",z,"w ""q"", v"\n'))
    kept = readers.read_csv_export(spark, path, "apart").orderBy("row_idx").collect()
    assert [tuple(r) for r in kept] == [("1", "2", 0), ("6", None, 1), ("7,8", "9", 2)]
    errors = readers.csv_errors(spark, path).collect()
    assert {(r["line"], r["expected"]) for r in errors} == {("3,4,5", 2), ('"x,y",z,"w ""q"", v"', 2)}
    with pytest.raises(Exception, match="more cells than the header"):
        readers.read_csv_export(spark, path).collect()


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "400")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_cells_over_line_breaks_in_splits(spark, tmp_path, small_splits):
    """Records equal those of Python's own reader, and the file is read by many tasks."""
    import csv
    import random

    rng = random.Random(8)
    rows = [[str(i), "".join(rng.choice(["a", "\n", '"', ",", "é", ", "]) for _ in range(rng.randint(1, 30)))] for i in range(400)]
    rows[17][1] = "x\n" * 700  # a cell longer than several splits
    with open(tmp_path / "a.csv", "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerows([["A", "B"], *rows])
    got = readers.read_csv_export(spark, str(tmp_path / "a.csv")).orderBy("row_idx").collect()
    assert [[r["A"], r["B"]] for r in got] == rows
    assert [r["row_idx"] for r in got] == list(range(400))
    splits = records.layout(spark, str(tmp_path / "a.csv"))
    assert splits.select("start").distinct().count() > 5 and splits.rdd.getNumPartitions() > 5


def test_one_odd_file_leaves_the_others(spark, tmp_path):
    write(tmp_path, "a.csv", b'A,B\n1,5" pipe\n2,x\n')  # a quote inside a cell opens nothing
    write(tmp_path, "b.csv", b'A,B\r\n3,"two\r\nlines, ""x"""\r\n\r\n4,y\r\n')
    write(tmp_path, "c.csv", "A,B\n5,José\n".encode("latin-1"))
    write(tmp_path, "d.csv", "A,B\n6,\"é\né\"\n7,8,9\n".encode("latin-1"))
    got = readers.read_csv_export(spark, str(tmp_path), "apart")
    assert sorted((r["A"], r["B"]) for r in got.collect()) == [
        ("1", '5" pipe'), ("2", "x"), ("3", 'two\r\nlines, "x"'), ("4", "y"), ("5", "José"), ("6", "é\né"),
    ]
    assert [r["line"] for r in readers.csv_errors(spark, str(tmp_path)).collect()] == ["7,8,9"]


def test_states_of_quotes():
    for line, out, inside in [
        ("a,b", 0, 1), ('"a', 1, 0), ('a"b', 0, 0), ('"a""', 1, 1), ('"a"""', 0, 1), ('x,"a,', 1, 0), ('",b"', 0, 1), ('a","b', 1, 1), ("", 0, 1), ('"a",""', 0, 1),
    ]:
        assert records.behind(line, 0) == out, line
    assert [records.behind(x, 1) for x in ('a"', 'a""', 'a"",b"', 'a","b', 'a",b"c', '"')] == [0, 1, 0, 1, 0, 0]


def test_workbooks_in_a_run(spark, tmp_path):
    """Two workbooks of one export: places, dates, gaps, equal and missing headers, dense row_idx."""
    from tributary.catalogue.ingest import _book
    from tributary.plans.consolidate import run
    from tributary.schema import employee_schema

    head = ["Emp ID", "Email", "Email", None, "DOJ"]
    (tmp_path / "a.xlsx").write_bytes(_book([head, ["E1", " a@x.org", None, "z", "44927"], [None, None, None, None, None], ["E2", "NA", "b@x.org", None, "44928.5"]]))
    (tmp_path / "b.xlsx").write_bytes(_book([head, ["E3", "c@x.org", "n/a", None, "59"]]))
    df = workbook.read_excel_export(spark, f"{tmp_path}/*")
    assert df.columns == ["Emp ID", "Email", "Email.1", "Unnamed: 3", "DOJ", "row_idx"]
    assert [tuple(r) for r in df.orderBy("row_idx").collect()] == [
        ("E1", " a@x.org", None, "z", "2023-01-01", 0), ("E2", None, "b@x.org", None, "2023-01-02 12:00:00", 1), ("E3", "c@x.org", None, None, "1900-02-28", 2),
    ]
    build = run(spark, [("books", df)], employee_schema())
    assert {r["employee_id"]: r["date_of_joining"] for r in build.records.collect()}["E1"] == "2023-01-01"
    with pytest.raises(ValueError):
        workbook.read_excel_export(spark, "old.xls")


def test_plan_of_many_files_does_not_grow(spark, tmp_path):
    from tributary.operators import matching
    from tributary.schema import employee_schema
    from tributary.sources import many

    schema, sizes = employee_schema(), []
    for n in (2, 40):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            head = ["Emp ID,Email", "Email,Locker,Emp ID"][i % 2]
            (folder / f"f{i:02d}.csv").write_text(f"{head}\n" + (f"E{i},a@x.org\n,\n" if i % 2 == 0 else f'b@x.org,"x\ny",E{i}\n'))
        exports = many.read_exports(spark, str(folder))
        mappings = matching.match_columns(readers.column_catalog(exports.catalog), schema)
        rows = many.map_exports(exports, mappings, schema)
        assert sorted((r["file"], r["row_idx"], r["employee_id"], r["email"]) for r in rows.collect()) == [
            (f"f{i:02d}.csv", 0, f"E{i}", "ab"[i % 2] + "@x.org") for i in range(n)]
        assert {r["row_count"] for r in exports.catalog.collect()} == {1}
        sizes.append(len(rows._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]
    (tmp_path / "2" / "f00.csv").write_text("Emp ID,Email\n1,2,3\n")
    with pytest.raises(Exception, match="more cells than the header"):
        many.read_exports(spark, str(tmp_path / "2"))
