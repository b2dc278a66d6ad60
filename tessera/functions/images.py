"""Grey images as arrays of floats: statistics, histograms, mutual information, mapping and warping.

Reductions are higher-order functions, in the order of the pixels, so they stay in the JVM. Warping needs
random access to pixels and runs as an Arrow UDF in NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

BINS = 64
TINY = 1e-12


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def statistics(pixels: Column) -> Column:
    """Struct of mean, stddev (of the population), min, max, p10, p50, p90; null for an empty image."""

    def of(known: Column) -> Column:
        v, mean, n = known["v"], known["mean"], F.size(known["v"])
        spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean)) / n)
        at = lambda share: F.get(v, F.floor(n * share).cast("int")).cast("double")
        ends = F.get(v, F.lit(0)).cast("double"), F.get(v, n - 1).cast("double")
        return F.struct(mean.alias("mean"), spread.alias("stddev"), ends[0].alias("min"), ends[1].alias("max"), *[at(p / 100).alias(f"p{p}") for p in (10, 50, 90)])

    return F.when(F.size(pixels) > 0, let(F.struct(F.array_sort(pixels).alias("v"), (total(pixels) / F.size(pixels)).alias("mean")), of))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of a value; null for NaN; infinite values fall in the outer bins."""
    at = F.floor((x.cast("double") - low) / (high - low) * bins)
    return F.when(F.isnan(x), F.lit(None).cast("int")).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1).cast("long"), at)).cast("int"))


def histogram(values: Column, bins: int) -> Column:
    """Counts of an array of bin numbers; null bins are in none."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda v: v == b)))


def entropy(counts: Column, n: Column) -> Column:
    """Natural-logarithm entropy of counts; zeros are skipped."""
    share = lambda c: c / n.cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - F.when(c > 0, share(c) * F.log(F.greatest(share(c), F.lit(1e-300)))).otherwise(F.lit(0.0)))


def run_counts(values: Column) -> Column:
    """Lengths of the runs of equal values in the sorted array: counts by value."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        places = F.when(ordered.isNotNull(), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
        ends = F.filter(places, lambda i: (i == n - 1) | (F.get(ordered, i) != F.get(ordered, i + 1)))
        return let(ends, lambda e: F.transform(e, lambda end, k: end - F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(-1))))

    return let(F.sort_array(F.filter(values, lambda v: v.isNotNull())), of)


def excluded(index: Column, size: Column, mask: Column) -> Column:
    """Whether a pixel of a square image lies in a normalised rectangle, widened to whole pixels."""
    x, y = index % size, F.floor(index / size)
    inside = lambda v, low, wide: (v >= F.floor(low * size)) & (v < F.ceil((low + wide) * size))
    return F.coalesce(inside(x, mask["x"], mask["width"]) & inside(y, mask["y"], mask["height"]), F.lit(False))


def mutual_information(a: Column, b: Column, bins: int = BINS, mask: Column | None = None, size: Column | None = None) -> Column:
    """Struct of mi, nmi, ha, hb, hab and pixels_used of two images; zeros if lengths differ or an image is flat."""
    if bins < 4:
        raise ValueError("bins must be 4 or more")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.get(a, i).cast("double").alias("a"), F.get(b, i).cast("double").alias("b")))
    if mask is not None:
        pairs = F.filter(pairs, lambda p: ~excluded(p["i"], size, mask))
    ends = lambda v: F.struct(F.array_min(F.filter(v, finite)).alias("low"), F.array_max(F.filter(v, finite)).alias("high"))
    zero = F.lit(0.0)
    none = F.struct(*[zero.alias(k) for k in ("mi", "nmi", "ha", "hb", "hab")], F.lit(0).alias("pixels_used"))

    def of_entropies(e: Column) -> Column:
        ha, hb, hab = e["ha"], e["hb"], e["hab"]
        return F.struct((ha + hb - hab).alias("mi"), F.when(hab > TINY, (ha + hb) / hab).otherwise(zero).alias("nmi"), ha.alias("ha"), hb.alias("hb"), hab.alias("hab"), e["n"].alias("pixels_used"))

    def of_bins(binned: Column) -> Column:
        n = F.size(binned)
        joint = F.transform(binned, lambda p: p["a"] * bins + p["b"])
        return let(F.struct(*[entropy(run_counts(v), n).alias(k) for k, v in (("ha", binned["a"]), ("hb", binned["b"]), ("hab", joint))], n.alias("n")), of_entropies)

    def of_ends(s: Column) -> Column:
        wide = lambda e: F.coalesce(e["high"] - e["low"] >= TINY, F.lit(False))
        binned = F.transform(s["pairs"], lambda p: F.struct(bin_of(p["a"], s["a"]["low"], s["a"]["high"], bins).alias("a"), bin_of(p["b"], s["b"]["low"], s["b"]["high"], bins).alias("b")))
        return F.when(wide(s["a"]) & wide(s["b"]), let(binned, of_bins)).otherwise(none)

    found = let(pairs, lambda p: let(F.struct(p.alias("pairs"), ends(p["a"]).alias("a"), ends(p["b"]).alias("b")), of_ends))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), found).otherwise(none)


def differences(a: Column, b: Column) -> Column:
    """Struct of the mean and the largest absolute difference."""
    apart = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.struct((total(apart) / F.greatest(F.size(apart), F.lit(1))).alias("mad"), F.coalesce(F.array_max(apart), F.lit(0.0)).alias("max_abs"))


def grey(rgba: Column) -> Column:
    """Grey values of an array of r, g, b, a bytes: the red channel if three sampled pixels are grey, else luma."""
    n = F.floor(F.size(rgba) / 4).cast("int")
    at = lambda i, c: F.get(rgba, (i * 4 + c).cast("int"))
    sampled = F.forall(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1), lambda i: (at(i, 0) == at(i, 1)) & (at(i, 0) == at(i, 2)))
    value = lambda i: F.when(sampled, at(i, 0) / 255.0).otherwise((0.299 * at(i, 0) + 0.587 * at(i, 1) + 0.114 * at(i, 2)) / 255.0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: value(i).cast("float"))).otherwise(F.array().cast("array<float>"))


def displayed(pixels: Column, brightness: Column, contrast: Column) -> Column:
    """Pixels under brightness and contrast in percent, within [0, 1]."""
    shown = lambda x: (x.cast("double") * (brightness / 100) - 0.5) * (contrast / 100) + 0.5
    return F.transform(pixels, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), shown(x))).cast("float"))


def intensity_match(reference: Column, target: Column) -> Column:
    """Struct of brightness and contrast in percent that bring a target's statistics to the reference's."""
    percent = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(200.0), v * 100)) + 0.5).cast("int")

    def of(s: Column) -> Column:
        scale = s["r"]["stddev"] / F.when(s["t"]["stddev"] >= 1e-10, s["t"]["stddev"])
        return let(F.struct(scale.alias("a"), (1 - 2 * (s["r"]["mean"] - scale * s["t"]["mean"])).alias("c")), of_scale)

    def of_scale(k: Column) -> Column:
        a, c = k["a"], k["c"]
        neutral = F.coalesce(a.isNull() | ~finite(c) | (F.abs(c) < 1e-10), F.lit(True))
        b = a / F.when(F.abs(c) >= 1e-10, c)
        return F.struct(F.when(neutral, F.lit(100)).otherwise(percent(b)).alias("brightness"), F.when(neutral, F.lit(100)).otherwise(percent(c)).alias("contrast"))

    return let(F.struct(reference.alias("r"), target.alias("t")), of)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of a square image at points; zero outside."""
    size = image.shape[0]
    x0, y0 = np.floor(x), np.floor(y)
    out = np.zeros(x.shape)
    for dx in (0, 1):
        for dy in (0, 1):
            u, v = x0 + dx, y0 + dy
            inside = (u >= 0) & (u < size) & (v >= 0) & (v < size)
            value = np.zeros(x.shape)
            value[inside] = image[v[inside].astype(int), u[inside].astype(int)]
            out += value * np.where(dx, x - x0, 1 - (x - x0)) * np.where(dy, y - y0, 1 - (y - y0))
    return out


def warped(pixels: np.ndarray, size: int, m: tuple[float, float, float, float], t: tuple[float, float]) -> np.ndarray:
    """The image under y = A(x - c) + c + t, by sampling at the inverse; c is the centre."""
    if len(pixels) != size * size:
        raise ValueError("pixels do not fill the square")
    d = m[0] * m[3] - m[1] * m[2]
    if not np.isfinite(d) or abs(d) < TINY:
        raise ValueError("singular matrix")
    c = (size - 1) / 2
    y, x = np.mgrid[0:size, 0:size].astype(float)
    u, v = x - c - t[0], y - c - t[1]
    back_x, back_y = (m[3] * u - m[1] * v) / d + c, (-m[2] * u + m[0] * v) / d + c
    return sampled(np.asarray(pixels, dtype=float).reshape(size, size), back_x, back_y).astype(np.float32).ravel()


def warp_rows(pixels: pd.Series, size: pd.Series, m00: pd.Series, m01: pd.Series, m10: pd.Series, m11: pd.Series, tx: pd.Series, ty: pd.Series) -> pd.Series:
    rows = zip(pixels, size, m00, m01, m10, m11, tx, ty, strict=True)
    return pd.Series([None if p is None else warped(p, int(s), (a, b, c, d), (x, y)) for p, s, a, b, c, d, x, y in rows])


def warp(pixels: Column | str, size: Column | str, m00: Column | str, m01: Column | str, m10: Column | str, m11: Column | str, tx: Column | str, ty: Column | str) -> Column:
    """Warped images; each row has its own map about the centre."""
    return F.pandas_udf(warp_rows, T.ArrayType(T.FloatType()))(pixels, size, m00, m01, m10, m11, tx, ty)
