import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.functions import pixels as px
from cohortweave.operators import samples as sm


def images(spark, *arrays, **columns):
    data = [(i, [float(v) for v in np.ravel(a)], int(np.shape(a)[0]), int(np.shape(a)[1])) for i, a in enumerate(arrays)]
    return spark.createDataFrame(data, "patient_id long, pixels array<float>, height int, width int")


def pixels(df, expression=None):
    column = F.col("pixels") if expression is None else expression
    return [list(r[1]) for r in sorted(df.select("patient_id", column.alias("v")).collect())]


A = np.arange(6).reshape(2, 3)


def test_rearrangements(spark):
    df = images(spark, A)
    assert pixels(df, px.transposed(F.col("pixels"), F.col("height"), F.col("width"))) == [list(A.T.ravel())]
    assert pixels(df, px.flipped_left_right(F.col("pixels"), F.col("height"), F.col("width"))) == [list(A[:, ::-1].ravel())]
    assert pixels(df, px.flipped_up_down(F.col("pixels"), F.col("height"), F.col("width"))) == [list(A[::-1].ravel())]


def test_values(spark):
    df = images(spark, [[0.0, 127.5, 255.0]])
    assert pixels(df, px.scaled(F.col("pixels"))) == [[-1.0, 0.0, 1.0]]
    assert pixels(df, px.min_max_normalised(F.col("pixels"))) == [[0.0, 0.5, 1.0]]
    assert pixels(images(spark, [[4, 4]]), px.min_max_normalised(F.col("pixels"))) == [[0.0, 0.0]]
    assert pixels(images(spark, [[-1, 0.5, 2]]), px.clipped(F.col("pixels"))) == [[0.0, 0.5, 1.0]]
    assert np.allclose(pixels(df, px.mean_subtracted(F.col("pixels"))), [[-123.68, 127.5 - 116.779, 255 - 103.939]])


def test_shapes(spark):
    df = spark.createDataFrame([([1, 5, 4],), ([-1, -1, -1],), ([2, 3, 4],)], "shape array<int>")
    got = df.select(px.squeezed_shape(F.col("shape")), px.voxel_count(F.col("shape"))).collect()
    assert [list(r[0]) if r[0] else None for r in got] == [[5, 4], None, [2, 3, 4]]
    assert got[2][1] == 24


def test_top_k_and_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2, 0.7],)], "s array<double>")
    best, at = df.select(px.top_k(F.col("s"), 3), px.argmax(F.col("s"))).first()
    assert [(b.score, b.class_id) for b in best] == [(0.7, 3), (0.7, 1), (0.2, 2)] and at == 1


def bilinear(image, height, width):
    """Pixel by pixel, from the definition."""
    h, w = image.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            sy = min(max((y + 0.5) * h / height - 0.5, 0), h - 1)
            sx = min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            fy, fx = sy - y0, sx - x0
            top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
            low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
            out[y, x] = top * (1 - fy) + low * fy
    return out


def test_resize_brings_every_shape_to_one_size(spark):
    rng = np.random.default_rng(1)
    arrays = [np.array([[0, 1], [2, 3]]), rng.random((5, 7)), rng.random((4, 4)), rng.random((9, 3))]
    df = sm.resized(images(spark, *arrays), 4, 4)
    got = pixels(df)
    assert got[0][:4] == [0.0, 0.25, 0.75, 1.0]
    for image, out in zip(arrays, got):
        assert np.allclose(out, bilinear(image, 4, 4).ravel(), atol=1e-6)
    assert {(r.height, r.width) for r in df.select("height", "width").collect()} == {(4, 4)}


def test_resize_keeps_rows_without_an_image(spark):
    df = images(spark, A).unionByName(spark.createDataFrame([(9, None, 2, 2)], "patient_id long, pixels array<float>, height int, width int"))
    assert {r.patient_id: r.pixels is None for r in sm.resized(df, 4, 4).collect()} == {0: False, 9: True}


def test_turns(spark):
    image = np.arange(9).reshape(3, 3)
    df = images(spark, image, image, image).withColumn(
        "angle", F.element_at(F.array(F.lit(0.0), F.lit(np.pi / 2), F.lit(np.pi / 4)), (F.col("patient_id") + 1).cast("int"))
    )
    still, quarter, eighth = pixels(sm.rotated(df, "angle"))
    assert still == list(image.ravel())
    assert quarter == list(np.rot90(image).ravel())
    assert eighth[4] == 4.0 and eighth[0] == 1.0


def test_augmentation_repeats_itself_and_depends_on_the_seed(spark):
    rng = np.random.default_rng(2)
    df = images(spark, *[rng.random((6, 6)) for _ in range(40)])
    first, again, other = (pixels(sm.augmented(d, seed=s)) for d, s in ((df, 1), (df.repartition(5), 1), (df, 2)))
    assert first == again and first != other
    changed = sum(a != b for a, b in zip(first, pixels(df)))
    assert 25 <= changed <= 40


def test_noise_is_gaussian(spark):
    df = images(spark, np.zeros((200, 100)))
    uniform = lambda stream, i: px.unit_hash(F.col("patient_id"), stream, i)
    noise = np.array(pixels(df, px.with_noise(F.col("pixels"), 0.2, uniform))[0])
    assert abs(noise.mean()) < 0.01 and abs(noise.std() - 0.2) < 0.01


@pytest.mark.parametrize("pcr, rcb, group", [(1, 0, 1), (0, 2, 2), (0, 3, 3)])
def test_response_group(spark, pcr, rcb, group):
    df = spark.createDataFrame([(pcr, rcb)], "pCR int, RCB int").select(sm.response_group(F.col("pCR"), F.col("RCB")).alias("g"))
    assert df.first().g == group
    assert list(df.select(sm.one_hot(F.col("g"))).first()[0]) == [float(g == group) for g in (1, 2, 3)]


def test_one_hot_out_of_range_is_all_zeros(spark):
    df = spark.createDataFrame([(0,), (4,)], "g int")
    assert [list(r[0]) for r in df.select(sm.one_hot(F.col("g"))).collect()] == [[0.0] * 3] * 2


def test_labelled_only(spark, rows):
    df = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, -1, 1), (4, 0, -1), (None, 1, 1)], "patient_id long, pCR int, RCB int")
    assert rows(sm.labelled_only(df), "patient_id") == [(1,)]


FEATURES = [(1, "b", "s1"), (1, "a", "s2"), (1, "x", "s3"), (2, "b", "s4"), (3, "a", "s6"), (3, "a", "s5"), (3, "b", "s7")]


def test_required_and_preferred(spark, rows):
    df = spark.createDataFrame(FEATURES, "patient_id long, feature_name string, series_id string")
    assert rows(sm.required_series(df, ["a", "b"]), "patient_id", "feature_name", "series_id") == [
        (1, "a", "s2"), (1, "b", "s1"), (3, "a", "s5"), (3, "a", "s6"), (3, "b", "s7"),
    ]
    assert rows(sm.preferred_series(df, ["a", "b"])) == [(1, 0, "a", "s2"), (2, 1, "b", "s4"), (3, 0, "a", "s5")]


def test_samples_and_quarantine_share_all_rows(spark, rows):
    data = [(1, [1.0] * 4, 1, 0), (2, None, 1, 0), (3, [-10000.0] * 4, 1, 0), (4, [1.0] * 3, 1, 0), (5, [1.0] * 4, None, 0), (6, [], 1, 0)]
    df = spark.createDataFrame(data, "patient_id long, pixels array<float>, pCR int, RCB int")
    assert rows(sm.sample_input(df, 2, 2), "patient_id", "height", "width", "response_group") == [(1, 2, 2, 1)]
    assert rows(sm.sample_quarantine(df, 2, 2)) == [
        (2, "no_image"), (3, "absent_image"), (4, "wrong_shape"), (5, "no_label"), (6, "no_image"),
    ]


def test_take_shuffle_and_names(spark, rows):
    df = spark.range(50).withColumnRenamed("id", "k").withColumn("label", (F.col("k") % 3).cast("int"))
    assert rows(sm.sample_take(df, 2, "k"), "k") == [(0,), (1,)]
    order = lambda d, s: [r.k for r in sm.sample_shuffle(d, "k", s).collect()]
    assert order(df, 1) == order(df.repartition(7), 1) != order(df, 2)
    assert sorted(order(df, 1)) == list(range(50))
    names = spark.createDataFrame([(0, "cat"), (1, "dog")], "label int, name string")
    assert dict(rows(sm.label_names(df, names).groupBy("name").count())) == {"cat": 17, "dog": 17, None: 16}


def test_cost_per_pixel_does_not_grow_with_the_image(spark):
    """Normalising and augmenting are linear in the pixels: sixteen times the pixels, not much more per pixel."""
    import time

    def seconds(side, n):
        df = images(spark, *[np.random.default_rng(i).random((side, side)) for i in range(n)]).cache()
        df.count()
        out = sm.augmented(df.withColumn("pixels", px.min_max_normalised(F.col("pixels"))))
        out.write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    assert seconds(256, 4) < 6 * seconds(64, 64) + 2
