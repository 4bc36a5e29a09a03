import itertools

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortweave.operators import series as sr
from cohortweave.operators.shared import written
from cohortweave.schemas import TAG_LATERALITY, TAG_TIME

SCHEMA = """series_id string, path string, slice_location double, position array<double>, rows int, cols int,
pixels array<float>, status string, study_id string, patient_id string, time_point string, description string,
modality string, laterality string, slice_spacing double, pixel_spacing array<double>, orientation array<double>"""


def slice_row(series, path, location=None, z=None, rows=1, cols=2, pixels=None, status="ok", **more):
    base = dict(
        series_id=series, path=path, slice_location=location, position=None if z is None else [0.0, 0.0, z], rows=rows,
        cols=cols, pixels=pixels or [float(len(path))] * (rows * cols), status=status, study_id="st", patient_id="7",
        time_point=None, description=None, modality=None, laterality=None, slice_spacing=None, pixel_spacing=None,
        orientation=None,
    )
    return {**base, **more}


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


THREE_SERIES = [
    slice_row("loc", "a", 3.0, 1.0), slice_row("loc", "b", 1.0, 2.0), slice_row("loc", "c", 2.0),
    slice_row("pos", "a2", None, 9.0), slice_row("pos", "b2", 1.0, 8.0), slice_row("pos", "c2", 2.0, 7.0),
    slice_row("path", "c3", 1.0), slice_row("path", "a3", None, 5.0), slice_row("path", "b3", 0.0),
]


def test_order_falls_back_from_location_to_position_to_path(spark):
    placed = sr.slice_order(frame(spark, THREE_SERIES)).collect()
    got = {s: [r.path for r in sorted((r for r in placed if r.series_id == s), key=lambda r: r.z_index)] for s in ("loc", "pos", "path")}
    assert got == {"loc": ["b", "c", "a"], "pos": ["c2", "b2", "a2"], "path": ["a3", "b3", "c3"]}
    assert {(r.series_id, r.sort_source) for r in placed} == {("loc", "location"), ("pos", "position"), ("path", "path")}
    assert all(r.z_index in (0, 1, 2) for r in placed)


def test_one_middle_slice_per_series(spark):
    data = [slice_row(f"s{n}", f"{n}-{i}", float(i)) for n in (1, 2, 3, 4, 5) for i in range(n)]
    middle = sr.middle_slices(frame(spark, data)).collect()
    assert {(r.series_id, r.path) for r in middle} == {(f"s{n}", f"{n}-{n // 2}") for n in (1, 2, 3, 4, 5)}


def volumes(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.series_id, r.block_no)):
        out.setdefault(r.series_id, []).append((r.z_start, list(r.voxels), list(r.shape)))
    return out


def test_volume_is_whole_in_one_block_or_in_many(spark):
    data = [slice_row("s", f"p{i}", float(i), pixels=[float(i), i + 0.5]) for i in range(5)]
    data += [slice_row("one", "q", 4.0, pixels=[1.0, 2.0])]
    df = frame(spark, data)
    whole = volumes(sr.volume_blocks(df))
    flat = list(itertools.chain.from_iterable((float(i), i + 0.5) for i in range(5)))
    assert whole == {"s": [(0, flat, [5, 1, 2])], "one": [(0, [1.0, 2.0], [1, 1, 2])]}
    split = volumes(sr.volume_blocks(df, max_voxels=4))["s"]
    assert [b[0] for b in split] == [0, 2, 4]
    assert list(itertools.chain.from_iterable(b[1] for b in split)) == flat


def test_a_repeated_path_is_quarantined_whatever_the_block_size(spark, rows):
    data = [slice_row("s", "a", 1.0), slice_row("s", "a", 2.0), slice_row("s", "b", 3.0), slice_row("good", "c", 1.0)]
    df = frame(spark, data)
    assert rows(sr.series_quarantine(df), "series_id", "reason") == [("s", "repeated_path")]
    assert set(volumes(sr.volume_blocks(df))) == set(volumes(sr.volume_blocks(df, max_voxels=2))) == {"good"}
    assert [r.series_id for r in sr.middle_slices(df).collect()] == ["good"]


def test_mixed_sizes_and_failed_slices_are_quarantined(spark, rows):
    data = [
        slice_row("mixed", "a", rows=2), slice_row("mixed", "b", rows=2, cols=3),
        slice_row("failed", "c"), slice_row("failed", "d", status="access_error"), slice_row("good", "e"),
    ]
    df = frame(spark, data)
    assert rows(sr.series_quarantine(df), "series_id", "reason") == [("failed", "failed_slice"), ("mixed", "mixed_size")]
    assert set(volumes(sr.volume_blocks(df))) == {"good"}


def test_pixel_count_is_checked(spark, rows):
    data = [slice_row("s", "a", pixels=[1.0]), slice_row("s", "b"), slice_row("s", "c", status="access_error")]
    assert rows(sr.check_pixels(frame(spark, data)), "path", "status") == [("a", "pixel_count"), ("b", "ok"), ("c", "access_error")]


def test_bounds(spark, rows):
    data = [slice_row("one", "a", 5.0), slice_row("two", "b", 5.0), slice_row("two", "c", -1.0), slice_row("none", "d"), slice_row("none", "e")]
    assert rows(sr.z_bounds(frame(spark, data)).select("series_id", "z_bound.lo", "z_bound.hi")) == [
        ("none", None, None), ("one", 0.0, 0.0), ("two", -1.0, 5.0),
    ]


def test_metadata_takes_values_from_any_slice_and_defaults(spark):
    data = [
        slice_row("s", "a", 1.0, laterality="", modality="MR", slice_spacing=0.0),
        slice_row("s", "b", 2.0, laterality="R", modality="SEG", description="ACRIN_6657/T1 x"),
        slice_row("bare", "c", study_id=None, patient_id=None),
    ]
    got = {r.series_id: r for r in sr.series_metadata(frame(spark, data)).collect()}
    s, bare = got["s"], got["bare"]
    assert (s.laterality, s.modality, s.slice_spacing, s.flags, s.time) == ("R", "MR", 0.0, ["T1_X"], "t-1")
    assert (s.z_bound.lo, s.z_bound.hi, s.shape, s.status) == (1.0, 2.0, [2, 1, 2], "ok")
    assert (bare.patient_id, bare.study_id, bare.slice_spacing) == ("UNKNOWN", "", -1.0)
    assert (bare.pixel_spacing, bare.position, bare.orientation) == ([-1.0] * 2, [-1.0] * 3, [0.0] * 6)


TAGS = [("s", {TAG_TIME: "T2", "n": "0"}), ("s", {TAG_TIME: "T1", TAG_LATERALITY: ""}), ("t", {"n": "5"})]


def test_tags(spark, rows):
    df = spark.createDataFrame(TAGS, "series_id string, meta map<string,string>")
    assert rows(sr.metadata_keys(df)) == sorted([("s", TAG_TIME), ("s", TAG_LATERALITY), ("s", "n"), ("t", "n")], key=repr)
    assert rows(sr.representative_values(df)) == sorted([("s", TAG_TIME, "T1", 2), ("s", "n", "0", 1), ("t", "n", "5", 1)], key=repr)
    columns = sr.tag_columns(df)
    assert [r.time_point for r in columns.collect()] == ["T2", "T1", None]
    assert [r.laterality for r in columns.collect()] == [None, None, None]


def test_pixel_tag_is_dropped(spark):
    df = spark.createDataFrame([(1, '{"Pixel Data": "zz", "A": 1, "B": null, "C": {"d": 2}}')], "id long, props string")
    assert sr.metadata_map(df, "id", "props").first().meta == {"A": "1", "C": '{"d":2}'}


def test_features_are_named_and_unique(spark, rows):
    data = [
        slice_row("s1", "a", 1.0, time_point="T1", description="x", modality="SEG", laterality="R", pixel_spacing=[0.5, 0.25]),
        slice_row("s2", "b", 1.0, time_point="T1", description="x"),
    ]
    features = sr.series_features(sr.series_metadata(frame(spark, data)))
    first = {r.series_id: r for r in features.collect()}["s1"]
    assert (first.feature_name, first.dicom_id, first.dx, first.dy, first.is_seg, first.right) == ("time1/X/", "st/s1/", 0.5, 0.25, 1, 1)
    long = sr.feature_long(features)
    assert long.count() == 22
    assert rows(sr.image_features(long), "feature_name", "series_id") == [("time1/X/image", "s1"), ("time1/X/image", "s2")]
    kept = sr.feature_dedup(long)
    assert kept.count() == 11
    assert rows(kept.select("series_id", "n_collisions").distinct()) == [("s2", 1)]
    assert kept.where("feature_name = 'time1/X/shape'").select(F.col("value.i")).first()[0] == [1, 1, 2]


def test_pixels_are_fetched_by_path(spark, rows):
    df = frame(spark, THREE_SERIES)
    middle = sr.middle_slices(df).select("path")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        found = rows(sr.fetch_pixels(middle, df), "path")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert found == [("b2",), ("b3",), ("c",)]


def _long_series(spark):
    """Series of many slices: skewed keys, ties, no keys, one key, an endless one."""
    rows = [("skew", f"p{i:05}", float(1.01 ** (i * 7 % 3000)), None) for i in range(3000)]
    rows += [("ties", f"p{i:05}", float(i % 3), None) for i in range(1001)]
    rows += [("paths", f"p{i * 9 % 700:05}", None, None) for i in range(700)]
    rows += [("half", f"p{i:05}", None if i else 1.0, [0.0, 0.0, float(-i)]) for i in range(900)]
    rows += [("one", "p", 4.0, None), ("endless", "a", float("inf"), None), ("endless", "b", 2.0, None), ("endless", "c", 1.0, None)]
    kinds = "series_id string, path string, slice_location double, position array<double>"
    df = spark.createDataFrame(rows, kinds).selectExpr("*", "2 AS rows", "1 AS cols", "'ok' AS status", "array(CAST(coalesce(slice_location, -1) AS FLOAT), 0F) AS pixels")
    return rows, df.repartition(7)


def _placed_by_hand(rows):
    by_series = {}
    for series, path, location, position in rows:
        by_series.setdefault(series, []).append((path, location, position[2] if position else None))
    for series, own in by_series.items():
        key = 1 if all(r[1] is not None for r in own) else 2 if all(r[2] is not None for r in own) else 0
        yield series, [r[0] for r in sorted(own, key=lambda r: (r[key], r[0]))]


def test_places_and_middles_of_long_series(spark):
    rows, df = _long_series(spark)
    wanted = dict(_placed_by_hand(rows))
    placed = {(r.series_id, r.path): r.z_index for r in sr.slice_order(df).collect()}
    assert placed == {(s, p): i for s, paths in wanted.items() for i, p in enumerate(paths)}
    middle = {r.series_id: (r.path, r.n_slices, r.z_index) for r in sr.middle_slices(df).collect()}
    assert middle == {s: (paths[len(paths) // 2], len(paths), len(paths) // 2) for s, paths in wanted.items()}


def test_only_slices_near_the_middle_are_ranked(spark, monkeypatch):
    ranked = []
    inner = sr.rank_within
    monkeypatch.setattr(sr, "rank_within", lambda df, *more: ranked.append(df.count()) or inner(df, *more))
    df = spark.range(20_000).selectExpr("'s' AS series_id", "concat('p', id) AS path", "CAST(id * 37 % 20000 AS DOUBLE) AS slice_location",
                                        "CAST(NULL AS ARRAY<DOUBLE>) AS position", "1 AS rows", "1 AS cols", "'ok' AS status")
    assert [r.z_index for r in sr.middle_slices(df).collect()] == [10_000]
    assert ranked[0] <= 2 * sr._RANGE_SLICES


def test_blocks_of_a_long_series_stream_by(spark):
    rows, df = _long_series(spark)
    for series, paths in _placed_by_hand(rows):
        blocks = sr.volume_blocks(df.where(f"series_id = '{series}'"), max_voxels=500).orderBy("block_no").collect()
        assert [b.block_no for b in blocks] == list(range(-(-len(paths) // 250)))
        assert [b.z_start for b in blocks] == list(range(0, len(paths), 250))
        location = {r[1]: -1.0 if r[2] is None else r[2] for r in rows if r[0] == series}
        voxels = [v for b in blocks for v in b.voxels]
        assert voxels[::2] == pytest.approx([location[p] for p in paths], rel=1e-6) and set(voxels[1::2]) == {0.0}


def _block_batches(rows, size):
    schema = pa.schema([("series_id", pa.string()), ("block_no", pa.int64()), ("z_start", pa.int64()), ("shape", pa.list_(pa.int32())), ("voxels", pa.list_(pa.float32()))])
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    return schema, [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*p), schema)], schema=schema) for p in parts]


def test_blocks_of_a_batch_are_joined_at_once():
    rows = [(f"s{i // 2:06}", 0, i % 2, [2, 1, 1], [float(i)]) for i in range(10_000)]
    schema, batches = _block_batches(rows, 10_000)
    made = list(sr._blocks_of(iter(batches), schema))
    assert len(made) == 2  # all but the last block, and that
    assert [v for b in made for v in b.column(4).to_pylist()] == [[float(i), i + 1.0] for i in range(0, 10_000, 2)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_blocks_go_on_from_batch_to_batch(size):
    rows = [("a", 0, 0, [5, 1, 2], [1.0, 2.0]), ("a", 0, 1, [5, 1, 2], [3.0]), ("a", 1, 2, [5, 1, 2], []), ("b", 1, 0, None, [4.0]), ("b", 1, 1, None, None),
            ("b", 1, 2, None, [5.0]), (None, 0, 0, [1], [6.0]), (None, 0, 1, [1], [7.0, None]), ("c", None, 0, [1], [8.0]), ("d", 2, 0, [1], None)]
    schema, batches = _block_batches(rows, size)
    made = [tuple(r.values()) for b in sr._blocks_of(iter(batches), schema) for r in b.to_pylist()]
    assert made == [
        ("a", 0, 0, [5, 1, 2], [1.0, 2.0, 3.0]), ("a", 1, 2, [5, 1, 2], []), ("b", 1, 0, None, None), (None, 0, 0, [1], [6.0, 7.0, None]),
        ("c", None, 0, [1], [8.0]), ("d", 2, 0, [1], None),
    ]
    assert list(sr._blocks_of(iter([]), schema)) == []


def test_slices_of_short_series_are_written_once_for_the_middle(spark, monkeypatch):
    """Besides the paths only rows of series are written ahead of the ranks."""
    sizes = {}
    inner = sr.written

    def counted(df, name):
        table = inner(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(sr, "written", counted)
    data = [slice_row(f"s{n}", f"{n}-{i}", float(i)) for n in (3, 4, 5) for i in range(n)]
    assert sr.middle_slices(frame(spark, data)).count() == 3
    assert [n for n, size in sizes.items() if size > 3] == ["paths"]


def test_repeated_and_nameless_features(spark, rows):
    df = spark.createDataFrame(
        [(1, "f", "a", "s", 1), (1, "f", "a", "t", 2), (1, "f", "a", "t", 2), (None, "f", None, "s", 3), (None, "f", "a", None, 4)],
        "patient_id long, feature_name string, study_id string, series_id string, value int",
    )
    assert rows(sr.feature_dedup(df)) == [(1, "f", "a", "t", 2, 2), (None, "f", "a", None, 4, 1)]


def test_paths_of_a_series_stand_together(spark, monkeypatch):
    """What facts and order are read from is laid out by series, so that slices meet before they shuffle."""
    kept = {}

    def keep(df, name, *more):
        kept[name] = written(df, name, *more)
        return kept[name]

    monkeypatch.setattr(sr, "written", keep)
    data = [slice_row(f"s{k % 7}", f"{k % 7}-{k}", float(k)) for k in range(200)]
    assert sr.slice_order(frame(spark, data)).count() == 200
    files = {}
    for r in kept["paths"].select("series_id", F.input_file_name().alias("file")).collect():
        files.setdefault(r.file, []).append(r.series_id)
    assert sum(len(list(itertools.groupby(ids))) for ids in files.values()) <= 7 + len(files) - 1


def test_a_path_that_comes_twice_keeps_one_place(spark):
    data = [slice_row("s", p, at, z) for p, at, z in [("a", 3.0, 1.0), ("b", 2.0, None), ("a", 1.0, 5.0)]]
    got = {r.path: (r.z_index, r.n_slices, r.reason) for r in sr.slice_order(frame(spark, data)).collect()}
    assert got == {"a": (0, 3, "repeated_path"), "b": (1, 3, "repeated_path")}
