"""Images of any size on a square grid: whole, in proportion, in the middle, with black around them.

Both ways are separable, so an image is multiplied by one matrix of weights for its rows and one for its
columns. Images of one size in an Arrow batch are multiplied together.

Defined results: a null image, or one whose pixels are not width times height, gives null; a grid of no pixels raises an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fitted(width: int, height: int, size: int) -> tuple[int, int, int, int]:
    """(columns, rows, first column, first row) that an image takes on a square grid."""
    scale = min(size / width, size / height)
    columns, rows = (max(1, int(np.floor(n * scale + 0.5))) for n in (width, height))
    return columns, rows, (size - columns) // 2, (size - rows) // 2


def weights(source: int, target: int) -> np.ndarray:
    """target x source weights: shares of the area that each new pixel covers if there are fewer, else linear between the pixels' middles."""
    out = np.zeros((target, source))
    if target < source:
        edges = np.arange(target + 1) * source / target
        k = np.arange(source)
        out = np.clip(np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k), 0, None)
        return out / out.sum(axis=1, keepdims=True)
    at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
    low = np.minimum(at.astype(int), source - 1)
    high = np.minimum(low + 1, source - 1)
    np.add.at(out, (np.arange(target), low), 1 - (at - low))
    np.add.at(out, (np.arange(target), high), at - low)
    return out


def resample_rows(pixels: pd.Series, width: pd.Series, height: pd.Series, size: pd.Series) -> pd.Series:
    out: list = [None] * len(pixels)
    shapes = pd.DataFrame({"w": width, "h": height, "s": size}).dropna().astype(int).reset_index(drop=False)
    for (w, h, s), group in shapes.groupby(["w", "h", "s"]):
        if s < 1:
            raise ValueError("a grid needs pixels")
        own = [i for i in group["index"] if pixels[i] is not None and len(pixels[i]) == w * h and w * h > 0]
        if not own:
            continue
        columns, rows, x, y = fitted(w, h, s)
        stack = np.stack([np.asarray(pixels[i], dtype=float) for i in own]).reshape(len(own), h, w)
        grid = np.zeros((len(own), s, s), dtype=np.float32)
        grid[:, y : y + rows, x : x + columns] = weights(h, rows) @ stack @ weights(w, columns).T
        for i, image in zip(own, grid.reshape(len(own), s * s), strict=True):
            out[i] = image
    return pd.Series(out, index=pixels.index)


def on_grid(pixels: Column | str, width: Column | str, height: Column | str, size: Column | str) -> Column:
    """The pixels (row by row) of an image on a square grid of this size."""
    return F.pandas_udf(resample_rows, T.ArrayType(T.FloatType()))(pixels, width, height, size)
