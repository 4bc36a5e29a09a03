"""Image queries: embeddings as 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.functions import pixels as px
from cohortweave.operators import samples as sm
from cohortweave.registry.base import query, table

SIDE = 8

_CELLS = "(SELECT unnest(range(64)) AS p)"


def images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"),
        F.col("label"),
        F.col("embedding").alias("pixels"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
    )


def cells(rows, pixels: Column, digits: int | None = None):
    value = F.col("value").cast("double")
    return rows.select("vec_id", F.posexplode(pixels).alias("place", "value")).select(
        "vec_id", "place", (value if digits is None else F.round(value, digits)).alias("value")
    )


def _sql(value: str) -> str:
    return f"""SELECT vec_id, CAST(p AS INT) AS place, CAST({value} AS DOUBLE) AS value FROM embeddings, {_CELLS}"""


@query("slice_transpose", _sql("embedding[(p % 8) * 8 + p // 8 + 1]"))
def slice_transpose(spark, sf_dir):
    rows = images(spark, sf_dir)
    return cells(rows, px.transposed(F.col("pixels"), F.col("height"), F.col("width")))


@query("pixel_scale", _sql("CAST(CAST(embedding[p + 1] AS DOUBLE) / 127.5 - 1 AS FLOAT)"))
def pixel_scale(spark, sf_dir):
    return cells(images(spark, sf_dir), px.scaled(F.col("pixels")))


@query(
    "channel_mean_subtract",
    _sql("CAST(CAST(embedding[p + 1] AS DOUBLE) - ([123.68, 116.779, 103.939]::DOUBLE[])[p % 3 + 1] AS FLOAT)"),
)
def channel_mean_subtract(spark, sf_dir):
    return cells(images(spark, sf_dir), px.mean_subtracted(F.col("pixels")))


@query(
    "pixel_normalise",
    _sql(
        """CAST((CAST(embedding[p + 1] AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE))
           / (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) AS FLOAT)"""
    ),
)
def pixel_normalise(spark, sf_dir):
    return cells(images(spark, sf_dir), px.min_max_normalised(F.col("pixels")))


@query(
    "augment_flip",
    _sql(
        """embedding[(CASE WHEN label >= 5 THEN 7 - p // 8 ELSE p // 8 END) * 8
           + (CASE WHEN label % 2 = 1 THEN 7 - p % 8 ELSE p % 8 END) + 1]"""
    ),
)
def augment_flip(spark, sf_dir):
    """Classes from 5 flip up-down, odd classes left-right."""
    height, width, label = F.col("height"), F.col("width"), F.col("label")
    up = F.when(label >= 5, px.flipped_up_down(F.col("pixels"), height, width)).otherwise(F.col("pixels"))
    rows = images(spark, sf_dir).withColumn("pixels", up)
    mirrored = px.flipped_left_right(F.col("pixels"), height, width)
    return cells(rows, F.when(label % 2 == 1, mirrored).otherwise(F.col("pixels")))


@query("augment_clip", _sql("greatest(least(embedding[p + 1], CAST(1 AS FLOAT)), CAST(0 AS FLOAT))"))
def augment_clip(spark, sf_dir):
    return cells(images(spark, sf_dir), px.clipped(F.col("pixels")))


# Uniform numbers that SQL can work out too; the operators' own come from a hash.
_STEP, _WRAP = 2654435761, 1_000_003


def _uniform(stream: int, place: Column) -> Column:
    mixed = F.col("vec_id") * 64 + place + stream * 97
    return F.pmod(mixed * F.lit(_STEP), F.lit(_WRAP)).cast("double") / F.lit(float(_WRAP))


def _uniform_sql(stream: int, place: str) -> str:
    return f"(CAST(((vec_id * 64 + {place} + {stream * 97}) * {_STEP}) % {_WRAP} AS DOUBLE) / {_WRAP}.0)"


@query(
    "augment_noise",
    f"""SELECT vec_id, CAST(p AS INT) AS place, round(CAST(CAST(CAST(embedding[p + 1] AS DOUBLE)
      + 0.2 * sqrt(-2.0 * ln(1.0 - {_uniform_sql(1, 'p')})) * cos(2 * pi() * {_uniform_sql(2, 'p')}) AS FLOAT) AS DOUBLE), 4) + 0.0 AS value
    FROM embeddings, {_CELLS}""",
)
def augment_noise(spark, sf_dir):
    return cells(images(spark, sf_dir), px.with_noise(F.col("pixels"), 0.2, _uniform), 4)


_ANGLE_SQL = f"(CASE WHEN {_uniform_sql(3, '0')} > 0.5 THEN ({_uniform_sql(4, '0')} * 2 - 1) * 0.2 ELSE 0.0 END)"


@query(
    "augment_rotate",
    f"""WITH turned AS (
      SELECT vec_id, embedding, p, {_ANGLE_SQL} AS a, CAST(p % 8 AS DOUBLE) - 3.5 AS x, CAST(p // 8 AS DOUBLE) - 3.5 AS y
      FROM embeddings, {_CELLS}),
    source AS (
      SELECT vec_id, embedding, p, CAST(floor(cos(a) * x - sin(a) * y + 4.0) AS BIGINT) AS sx,
             CAST(floor(sin(a) * x + cos(a) * y + 4.0) AS BIGINT) AS sy FROM turned)
    SELECT vec_id, CAST(p AS INT) AS place, CAST(CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7
      THEN embedding[sy * 8 + sx + 1] ELSE 0 END AS DOUBLE) AS value FROM source""",
)
def augment_rotate(spark, sf_dir):
    zero = F.lit(0)
    angle = F.when(_uniform(3, zero) > 0.5, (_uniform(4, zero) * 2 - 1) * 0.2).otherwise(0.0)
    return cells(sm.rotated(images(spark, sf_dir).withColumn("angle", angle), "angle"), F.col("pixels"))


def _drawn_sql(stream: int) -> str:
    return f"(CAST('0x' || left(md5(concat(vec_id, ':{11 * 16 + stream}')), 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _noise_sql(stream: int) -> str:
    first = f"((base + {stream * 16807} + p * 48271) % {px.NOISE_MODULUS})"
    second = f"(({first} * {first} + base) % {px.NOISE_MODULUS})"
    return f"((({second} * {second} + p * 69621 + {stream}) % {px.NOISE_MODULUS} + 0.5::DOUBLE) / {px.NOISE_MODULUS}.0::DOUBLE)"


@query(
    "augment_random",
    f"""WITH draws AS (
      SELECT vec_id, embedding, CASE WHEN {_drawn_sql(0)} > 0.5 THEN ({_drawn_sql(1)} * 2 - 1) * 0.2::DOUBLE ELSE 0.0::DOUBLE END AS a,
        {_drawn_sql(2)} > 0.5 AS noisy, {_drawn_sql(3)} > 0.5 AS up, {_drawn_sql(7)} > 0.5 AS mirrored,
        CAST('0x' || left(md5(concat(vec_id, ':{11 * 16 + 4}')), 8) AS BIGINT) % {px.NOISE_MODULUS} AS base FROM embeddings),
    turned AS (SELECT *, CAST(p % 8 AS DOUBLE) - 3.5::DOUBLE AS x, CAST(p // 8 AS DOUBLE) - 3.5::DOUBLE AS y
      FROM draws, (SELECT unnest(range(64))::BIGINT AS p)),
    source AS (SELECT *, CAST(floor(cos(a) * x - sin(a) * y + 4.0::DOUBLE) AS BIGINT) AS sx, CAST(floor(sin(a) * x + cos(a) * y + 4.0::DOUBLE) AS BIGINT) AS sy FROM turned),
    moved AS (SELECT *, CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN embedding[sy * 8 + sx + 1] ELSE 0::FLOAT END AS v FROM source),
    noised AS (SELECT *, CASE WHEN noisy THEN greatest(least(CAST(CAST(v AS DOUBLE)
      + 0.2::DOUBLE * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_noise_sql(1)})) * cos(2.0::DOUBLE * pi() * {_noise_sql(2)})) AS FLOAT), 1::FLOAT), 0::FLOAT)
      ELSE v END AS w FROM moved)
    SELECT vec_id, CAST((CASE WHEN noisy AND up THEN 7 - p // 8 ELSE p // 8 END) * 8
      + (CASE WHEN mirrored THEN 7 - p % 8 ELSE p % 8 END) AS INT) AS place, round(CAST(w AS DOUBLE), 4) + 0.0 AS value FROM noised""",
)
def augment_random(spark, sf_dir):
    """All augmentations of the operator, by its own draws."""
    return cells(sm.augmented(images(spark, sf_dir), "vec_id", seed=11), F.col("pixels"), 4)


_RESIZE_SQL = """WITH out AS (SELECT unnest(range(16)) AS o),
axis AS (
  SELECT o, greatest(least((o + 0.5::DOUBLE) * 8 / 16 - 0.5::DOUBLE, 7.0::DOUBLE), 0.0::DOUBLE) AS pos FROM out),
pair AS (SELECT o, CAST(floor(pos) AS BIGINT) AS lo, least(CAST(floor(pos) AS BIGINT) + 1, 7) AS hi, pos - floor(pos) AS f FROM axis)
SELECT vec_id, CAST(y.o * 16 + x.o AS INT) AS place, round(CAST(CAST(
    (embedding[y.lo * 8 + x.lo + 1]::DOUBLE * (1 - y.f) + embedding[y.hi * 8 + x.lo + 1]::DOUBLE * y.f) * (1 - x.f)
  + (embedding[y.lo * 8 + x.hi + 1]::DOUBLE * (1 - y.f) + embedding[y.hi * 8 + x.hi + 1]::DOUBLE * y.f) * x.f
  AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
FROM embeddings, pair y, pair x"""


@query("resize_bilinear", _RESIZE_SQL)
def resize_bilinear(spark, sf_dir):
    return cells(sm.resized(images(spark, sf_dir), 16, 16), F.col("pixels"), 6)


@query(
    "topk_scores",
    """WITH scores AS (SELECT vec_id, unnest(embedding) AS score, unnest(range(64)) AS class_id FROM embeddings)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id DESC) AS INT) AS place,
           CAST(class_id AS INT) AS class_id, CAST(score AS DOUBLE) AS score FROM scores
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id DESC) <= 5""",
)
def topk_scores(spark, sf_dir):
    best = images(spark, sf_dir).select("vec_id", F.posexplode(px.top_k(F.col("pixels"), 5)).alias("at", "best"))
    return best.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("place"),
        F.col("best.class_id").alias("class_id"),
        F.col("best.score").cast("double").alias("score"),
    )
