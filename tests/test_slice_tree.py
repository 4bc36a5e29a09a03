"""The data source that lists trees in its tasks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.sources import slice_tree as st
from cohortweave.sources.files import decode_files


@pytest.fixture
def tree(tmp_path):
    """Studies 1 and 10, series of like names, files at other depths."""
    for place in ("1/1.2/a.dcm", "1/1.2/b.dcm", "1/1.20/a.dcm", "1/1.20/notes.txt", "10/1.2/c.dcm", "10/9/d.dcm", "top.dcm", "1/stray.dcm", "1/1.2/deep/e.dcm"):
        path = tmp_path / place
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(place.encode())
    return str(tmp_path)


def _files(df):
    return sorted((r.study_id, r.series_id, r.file_name) for r in df.select("study_id", "series_id", "file_name").collect())


ALL = [("1", "1.2", "a.dcm"), ("1", "1.2", "b.dcm"), ("1", "1.20", "a.dcm"), ("10", "1.2", "c.dcm"), ("10", "9", "d.dcm")]


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_every_file_once(spark, tree, tasks):
    assert _files(st.slice_tree(spark, tree, "*.dcm", tasks)) == ALL
    assert _files(st.slice_tree(spark, f"file://{tree}/", None, tasks, content=False)) == sorted([*ALL, ("1", "1.20", "notes.txt")])


@pytest.mark.parametrize("studies", [None, [], ["1"], ["10", "none", "10"]])
@pytest.mark.parametrize("series", [None, [], ["1.2"], ["1.2", "9"]])
def test_named_ids(spark, tree, studies, series):
    wanted = [f for f in ALL if (studies is None or f[0] in studies) and (series is None or f[1] in series)]
    assert _files(st.slice_tree(spark, tree, "*.dcm", 4, False, studies, series)) == wanted


def test_one_table_in_several_queries(spark, tree):
    df = st.slice_tree(spark, tree, "*.dcm", 4)
    assert df.where("series_id = '1.2'").count() == 3
    assert df.count() == len(ALL)
    assert df.where("series_id = '1.2'").union(df.where("series_id = '9'")).count() == 4


def test_ids_decide_before_a_file_is_opened(tree, monkeypatch):
    reader = st.SliceTreeReader(tree, "*.dcm", 4, True, ["10"], ["1.2"])
    opened, listed = [], []
    monkeypatch.setattr(st.SliceTreeReader, "_opened", lambda self, system, path: opened.append(path) or b"")
    inner = st._listed
    monkeypatch.setattr(st, "_listed", lambda system, folder: listed.append(folder) or inner(system, folder))
    parts = reader.partitions()
    assert len(parts) == 1 and sum(b.num_rows for p in parts for b in reader.read(p)) == 1
    assert opened == [f"{tree}/10/1.2/c.dcm"]
    assert listed == [f"{tree}/10", f"{tree}/10/1.2"]  # neither the root nor any other study


def test_the_driver_lists_nothing(spark, tree, monkeypatch):
    monkeypatch.setattr(st, "_listed", lambda *a: pytest.fail("listed on the driver"))
    assert len(st.SliceTreeReader(tree, None, 16, True).partitions()) == 16


def test_without_content_no_file_is_opened(spark, tree):
    df = st.slice_tree(spark, tree, content=False)
    assert df.columns == ["path", "study_id", "series_id", "file_name", "length"]


def test_a_file_that_cannot_be_read_is_an_access_error(spark, tree):
    """It has no content; that is what decoding tells."""
    reader = st.SliceTreeReader(tree, None, 1, True)
    assert reader._opened(st.fs.LocalFileSystem(), f"{tree}/none") is None
    schema = T.StructType([T.StructField("n", T.IntegerType())])
    rows = st.slice_tree(spark, tree, "*.dcm").withColumn("content", F.when(F.col("file_name") != "c.dcm", F.col("content")))
    decoded = decode_files(rows, lambda path, content: {"n": len(content)}, schema)
    found = {r.path.rsplit("/", 1)[1]: (r.status, r.n) for r in decoded.collect()}
    assert found["c.dcm"] == ("access_error", None) and found["d.dcm"] == ("ok", len("10/9/d.dcm"))


def test_no_tree(spark, tmp_path):
    assert st.slice_tree(spark, f"{tmp_path}/none").count() == 0
    assert st.slice_tree(spark, str(tmp_path)).where(F.col("study_id") == "1").count() == 0
