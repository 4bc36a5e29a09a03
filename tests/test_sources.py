import json
import os

import pytest
from pyspark.sql import types as T

from cohortweave.schemas import OUTCOME_COLUMNS
from cohortweave.sources import files, tables, text


def write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    return path


HEADER = "a,b,c,d,e,f,g,h\n"
LINES = ["7,,1,2,3,1,,", '8,"x,1,2,3,1,0', "9,d,1,2,3,1,0,2,extra"]


def expected():
    return [
        ("7", None, "1", "2", "3", "1", None, None),
        ("8", '"x', "1", "2", "3", "1", "0", None),
        ("9", "d", "1", "2", "3", "1", "0", "2"),
    ]


def test_positional_csv_pads_short_rows_and_keeps_quotes(spark, folder, rows):
    path = write(folder, "o.csv", HEADER + "\n".join(LINES) + "\n")
    assert rows(text.read_positional_csv(spark, path, OUTCOME_COLUMNS)) == expected()


def test_positional_lines_read_the_same(spark, rows):
    lines = spark.createDataFrame([(line,) for line in LINES], "value string")
    assert rows(text.parse_positional_lines(lines, OUTCOME_COLUMNS)) == expected()


def test_split_character_is_no_pattern(spark, rows):
    lines = spark.createDataFrame([("1|2",)], "value string")
    assert rows(text.parse_positional_lines(lines, ["a", "b"], "|")) == [("1", "2")]


def test_header_csv_takes_named_columns(spark, folder, rows):
    path = write(folder, "m.csv", "Other,Series UID,Patient Id\nx,s1,7\ny,s2,8\n")
    names = {"Series UID": "series_id", "Patient Id": "patient_id"}
    assert rows(text.read_header_csv(spark, path, names)) == [("s1", "7"), ("s2", "8")]


def test_id_list_is_trimmed(spark, folder, rows):
    path = write(folder, "ids.txt", "s1  \ns2\n\n")
    assert rows(text.read_id_list(spark, path, "series_id")) == [("s1",), ("s2",)]


def test_description_counts_become_numbers(spark, folder, rows):
    path = write(folder, "c.json", json.dumps([{"SeriesDescription": "3D", "num": "31"}, {"SeriesDescription": "b,c", "num": "4"}]))
    assert rows(text.read_description_counts(spark, path)) == [("3D", 31), ("b,c", 4)]


@pytest.fixture
def tree(folder):
    for path in ("s1/1.2.3/a.dcm", "s1/1.2.3/b.dcm", "s1/1.2.34/a.dcm", "s2/9/a.dcm", "s2/9/notes.txt"):
        write(folder, f"tree/{path}", path)
    write(folder, "tree/loose.dcm", "loose")
    write(folder, "tree/s1/loose.dcm", "loose")
    write(folder, "tree/s1/1.2.3/deep/a.dcm", "deep")
    return f"{folder}/tree"


def test_only_files_two_levels_down_are_listed(spark, tree, rows):
    listed = files.list_files(spark, tree, "*.dcm")
    assert rows(listed, "study_id", "series_id", "file_name") == [
        ("s1", "1.2.3", "a.dcm"), ("s1", "1.2.3", "b.dcm"), ("s1", "1.2.34", "a.dcm"), ("s2", "9", "a.dcm"),
    ]


def test_series_id_that_starts_another_stays_apart(spark, tree, rows):
    found = rows(files.series_directories(files.list_files(spark, f"file://{tree}/", "*.dcm")), "series_id", "n_files", "series_path")
    assert [f[:2] for f in found] == [("1.2.3", 2), ("1.2.34", 1), ("9", 1)]
    assert found[0][2].endswith("/tree/s1/1.2.3/")


SCHEMA = T.StructType([T.StructField("size", T.LongType())])


def decoder(path, content):
    if content.startswith(b"s2"):
        raise files.MetadataError("no tags")
    if path.endswith("b.dcm"):
        raise ValueError("odd")
    return {"size": len(content)}


def test_failed_files_keep_their_row(spark, tree, rows):
    decoded = files.decode_files(files.read_files(spark, tree, "*.dcm"), decoder, SCHEMA)
    got = {(p.split("/tree/")[1], size, status) for p, size, status, _ in rows(decoded)}
    assert got == {
        ("s1/1.2.3/a.dcm", 14, "ok"), ("s1/1.2.3/b.dcm", None, "unknown_error"),
        ("s1/1.2.34/a.dcm", 15, "ok"), ("s2/9/a.dcm", None, "metadata_error"),
    }


def test_tasks_fetch_files_by_path(spark, tree, rows):
    paths = spark.createDataFrame([(f"{tree}/s1/1.2.3/a.dcm",), (f"{tree}/gone.dcm",)], "path string")
    got = {(p.split("/")[-1], size, status) for p, size, status, _ in rows(files.fetch_and_decode(paths, decoder, SCHEMA))}
    assert got == {("a.dcm", 14, "ok"), ("gone.dcm", None, "access_error")}


def test_distinct_series_by_list_table_and_limit(spark, rows):
    all_files = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1), ("a", 3)], "study_id string, series_id long")
    assert rows(tables.distinct_series(all_files)) == [("a", 1), ("a", 3), ("b", 2)]
    assert rows(tables.distinct_series(all_files, only=[3])) == [("a", 3)]
    assert rows(tables.distinct_series(all_files, only=[])) == []
    only = spark.createDataFrame([(1,), (2,)], "series_id long")
    assert rows(tables.distinct_series(all_files, only=only)) == [("a", 1), ("b", 2)]
    assert rows(tables.distinct_series(all_files, limit=2)) == [("a", 1), ("a", 3)]


def test_shards_are_read_from_files_and_folders(spark, folder, rows):
    df = spark.range(10)
    tables.write_sharded(df, f"{folder}/all", 3, "id")
    write(folder, "all/readme.txt", "no shard")
    names = [n for n in os.listdir(f"{folder}/all") if n.endswith(".parquet")]
    assert len(names) == 3
    assert tables.read_shards(spark, [f"{folder}/all"]).count() == 10
    assert tables.read_shards(spark, [f"{folder}/all/{n}" for n in names]).count() == 10
    assert sum(n for _, n in rows(tables.shard_counts(spark, f"{folder}/all"))) == 10


def test_any_other_mode_is_test(spark, folder, rows):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id long, split string")
    df.write.partitionBy("split").parquet(f"{folder}/s")
    assert [rows(tables.read_split(spark, f"{folder}/s", m), "id") for m in ("train", "val", "predict")] == [[(1,)], [(2,)], [(3,)]]
    assert [tables.split_batch_size(m, 10, 5) for m in ("train", "val", "test")] == [10, 5, 1]


def test_a_batch_run_again_replaces_its_folder_only(spark, folder, rows):
    write_batch = lambda data: tables.write_batches(spark.createDataFrame(data, "id long, batch_id long"), f"{folder}/b")
    write_batch([(1, 0), (2, 1)])
    write_batch([(3, 1)])
    assert rows(spark.read.parquet(f"{folder}/b"), "id", "batch_id") == [(1, 0), (3, 1)]


def test_batches_have_their_number_of_files(spark, folder):
    df = spark.range(4000).selectExpr("id", "id % 3 AS batch_id")
    tables.write_batches(df, f"{folder}/b", num_shards=4, spread="id")
    for batch in range(3):
        names = [n for n in os.listdir(f"{folder}/b/batch_id={batch}") if n.endswith(".parquet")]
        assert 1 <= len(names) <= 4
    assert spark.read.parquet(f"{folder}/b").count() == 4000


def test_report_lines(spark, folder):
    tables.write_report(spark.createDataFrame([("a, 1",)], "line string"), f"{folder}/r")
    assert spark.read.text(f"{folder}/r").first()[0] == "a, 1"
