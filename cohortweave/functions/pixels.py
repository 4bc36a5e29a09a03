"""Expressions over one image stored as a flat, row-major array."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.functions.values import bound, drawn
from cohortweave.schemas import ABSENT_IMAGE_VALUE, CHANNEL_MEANS


def squeezed_shape(shape: Column) -> Column:
    """Dimensions other than 1; NULL where the image is absent (all dimensions -1)."""
    absent = F.forall(shape, lambda d: d == -1)
    return F.when(~absent, F.filter(shape, lambda d: d != 1))


def voxel_count(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda n, d: n * d)


def _places(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def transposed(pixels: Column, height: Column, width: Column) -> Column:
    """Image of ``width`` rows and ``height`` columns."""
    def turn(image: Column) -> Column:
        return F.transform(_places(height * width), lambda p: F.get(image, ((p % height) * width + F.floor(p / height)).cast("int")))

    return bound(pixels, turn)


def flipped_left_right(pixels: Column, height: Column, width: Column) -> Column:
    return bound(pixels, lambda image: F.flatten(F.transform(_places(height), lambda r: F.reverse(F.slice(image, r * width + 1, width)))))


def flipped_up_down(pixels: Column, height: Column, width: Column) -> Column:
    return bound(pixels, lambda image: F.flatten(F.transform(_places(height), lambda r: F.slice(image, (height - 1 - r) * width + 1, width))))


def scaled(pixels: Column) -> Column:
    """0..255 to -1..1."""
    return F.transform(pixels, lambda x: (x.cast("double") / 127.5 - 1).cast("float"))


def mean_subtracted(pixels: Column, means: Sequence[float] = tuple(CHANNEL_MEANS)) -> Column:
    """Channel means taken off pixels whose channels lie side by side."""
    table = F.array(*[F.lit(float(m)) for m in means])
    return F.transform(pixels, lambda x, i: (x.cast("double") - F.get(table, i % len(means))).cast("float"))


def clipped(pixels: Column, low: float = 0.0, high: float = 1.0) -> Column:
    bound = lambda x: F.greatest(F.least(x, F.lit(high).cast("float")), F.lit(low).cast("float"))
    return F.transform(pixels, bound)


def min_max_normalised(pixels: Column) -> Column:
    """Least value to 0 and greatest to 1; a flat image becomes 0."""
    # Both ends are found once per image, not once per pixel.
    ends = F.struct(F.array_min(pixels).cast("double").alias("low"), F.array_max(pixels).cast("double").alias("high"))

    def stretch(e: Column) -> Column:
        span = e["high"] - e["low"]
        return F.transform(pixels, lambda x: F.when(span > 0, (x.cast("double") - e["low"]) / span).otherwise(0.0).cast("float"))

    return bound(ends, stretch)


def is_absent_image(pixels: Column) -> Column:
    return F.array_min(pixels) == F.lit(ABSENT_IMAGE_VALUE).cast("float")


def argmax(values: Column) -> Column:
    """Place of the greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """The ``k`` greatest scores as (score, class), best first; of equal ones the later class."""
    pairs = F.transform(scores, lambda p, i: F.struct(p.alias("score"), i.alias("class_id")))
    return F.slice(F.sort_array(pairs, asc=False), 1, k)


def unit_hash(key: Column, seed: int, place: Column | None = None) -> Column:
    """Repeatable number in [0, 1) for a row, or for a place in a row."""
    whole = key.cast("string") if place is None else F.concat_ws("/", key.cast("string"), place.cast("string"))
    return drawn(whole, seed).cast("double") / F.lit(float(1 << 52))


NOISE_MODULUS = 2_147_483_647  # a prime; squares of what is below it fit into 64 bits


def noise_uniforms(base: np.ndarray, n: int, stream: int) -> np.ndarray:
    """``n`` numbers between 0 and 1 for each base (below the modulus): a function of base, place and stream alone."""
    own, place = base[:, None].astype(np.int64), np.arange(n, dtype=np.int64)[None, :]
    r = (own + stream * 16_807 + place * 48_271) % NOISE_MODULUS
    r = (r * r + own) % NOISE_MODULUS
    r = (r * r + place * 69_621 + stream) % NOISE_MODULUS
    return (r + 0.5) / NOISE_MODULUS


def noisy_batch(images: np.ndarray, base: np.ndarray, stddev: float) -> np.ndarray:
    """Images (n, height, width) with Gaussian noise, cut to 0..1."""
    n, size = len(images), images.shape[1] * images.shape[2]
    radius = np.sqrt(-2.0 * np.log(1.0 - noise_uniforms(base, size, 1)))
    normal = radius * np.cos(2.0 * np.pi * noise_uniforms(base, size, 2))
    noisy = images.reshape(n, size).astype(np.float64) + stddev * normal
    return np.clip(noisy.astype(np.float32), 0.0, 1.0).reshape(images.shape)


def with_noise(pixels: Column, stddev: float, uniform) -> Column:
    """Gaussian noise from two uniform numbers per pixel.

    ``uniform(stream, place)`` must depend on the row and its arguments alone, so a
    task that is run again gives the same pixels.
    """

    def noisy(x: Column, i: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(1, i)))
        return (x.cast("double") + stddev * radius * F.cos(2.0 * np.pi * uniform(2, i))).cast("float")

    return F.transform(pixels, noisy)


def resize_batch(images: np.ndarray, out_height: int, out_width: int) -> np.ndarray:
    """Bilinear resize of images (n, height, width): half-pixel centres, clamped edges."""

    def axis(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(out) + 0.5) * size / out - 0.5, 0, size - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = axis(images.shape[1], out_height)
    x0, x1, fx = axis(images.shape[2], out_width)
    rows = images[:, y0, :] * (1 - fy)[None, :, None] + images[:, y1, :] * fy[None, :, None]
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def rotate_batch(images: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Turn images about their centre, nearest pixel, zero where nothing was."""
    n, height, width = images.shape
    cos, sin = np.cos(angles)[:, None, None], np.sin(angles)[:, None, None]
    cy, cx = (height - 1) / 2.0, (width - 1) / 2.0
    y, x = np.arange(height)[None, :, None] - cy, np.arange(width)[None, None, :] - cx
    from_x = np.floor(cos * x - sin * y + cx + 0.5).astype(np.int64)
    from_y = np.floor(sin * x + cos * y + cy + 0.5).astype(np.int64)
    inside = (from_x >= 0) & (from_x < width) & (from_y >= 0) & (from_y < height)
    row = np.arange(n)[:, None, None]
    picked = images[row, np.clip(from_y, 0, height - 1), np.clip(from_x, 0, width - 1)]
    return np.where(inside, picked, 0)
