"""Affine registration of grey images by mutual information, which does not depend on their contrast.

The joint histogram of two images is smoothed by Parzen windows, cubic splines over the moving image's
grey values, so mutual information is smooth in the map and has an analytic gradient. It is climbed from blurred to
sharp images by quasi-Newton steps (BFGS), from the best of a grid of shifts or from a given map. The moving image is interpolated on a
finer grid by cubics: interpolation by lines alone blurs it between pixels, and so makes small peaks where pixels meet pixels.

Each row is a job of its own: Spark deals the pairs of images over its tasks, in Arrow batches, where NumPy climbs some
pairs at a time. Memory is that of HELD pixels, or of one pair.

Defined results: a null image gives a null; images of different or not square sizes, and flat ones, are
not registered: the identity, mi 0, and registered false; so are pairs that lose half of their overlap.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of grey values: wide ones smear the moving image's and shift the peak; and points of the finer grid from pixel to pixel.
BINS, FINE = 48, 4
#: Half widths of the blurs as parts of the side, coarse to fine; pixels of the last step at each; steps at each, and from each start that is tried; shifts tried first, as parts of the side.
BLURS, LAST, STEPS, TRIED = (0.08, 0.03, 0.0), (0.05, 0.02, 0.003), 40, 8
SHIFTS = (-0.16, -0.08, 0.0, 0.08, 0.16)
#: Part of the pixels that must meet, and the ratio of areas that a map may have.
OVERLAP, AREA = 0.4, (0.25, 4.0)
#: Pixels of the pairs that are climbed together.
HELD = 32 * 24 * 24
MAP = ("m00", "m01", "m10", "m11", "tx", "ty")
FOUND = T.StructType([*(T.StructField(k, T.DoubleType()) for k in MAP), T.StructField("mi", T.DoubleType()), T.StructField("registered", T.BooleanType())])


def blurred(images: np.ndarray, half: int) -> np.ndarray:
    """Means over triangles of images (two box means in turn), with their border repeated."""
    for axis in (-2, -1, -2, -1) if half else ():
        padded = np.pad(images, [(half, half) if k == axis % images.ndim else (0, 0) for k in range(images.ndim)], mode="edge")
        sums = np.cumsum(np.insert(padded, 0, 0.0, axis=axis), axis=axis)
        n, wide = images.shape[axis], 2 * half + 1
        images = (np.take(sums, np.arange(wide, wide + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)) / wide
    return images


def finer(size: int) -> np.ndarray:
    """The matrix from values at pixels to cubics through them (Catmull-Rom) at every FINE-th of a pixel; beyond the border values go on straight."""
    at = np.arange((size - 1) * FINE + 1) / FINE
    cell = np.minimum(at.astype(int), size - 2)
    t = at - cell
    padded = np.zeros((len(at), size + 2))
    for k, weight in enumerate((-t / 2 + t * t - t**3 / 2, 1 - 2.5 * t * t + 1.5 * t**3, t / 2 + 2 * t * t - 1.5 * t**3, -t * t / 2 + t**3 / 2)):
        padded[np.arange(len(at)), cell + k] = weight
    padded[:, 1] += 2 * padded[:, 0]
    padded[:, 2] -= padded[:, 0]
    padded[:, -2] += 2 * padded[:, -1]
    padded[:, -3] -= padded[:, -1]
    return padded[:, 1:-1]


class Pairs:
    """Mutual information of pairs of images (n, side, side) under maps; a map is four entries of A - I times half the side, and a shift, all in pixels."""

    def __init__(self, fixed: np.ndarray, moving: np.ndarray) -> None:
        n, self.size = fixed.shape[:2]
        self.half = self.size / 2
        y, x = np.mgrid[0 : self.size, 0 : self.size] - (self.size - 1) / 2
        self.points = np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
        flat = fixed.reshape(n, -1)
        low, high = flat.min(axis=1, keepdims=True), flat.max(axis=1, keepdims=True)
        self.row = np.minimum((flat - low) / (high - low) * BINS, BINS - 1).astype(int) * BINS
        up = finer(self.size)
        self.side, fine = len(up), (up @ moving @ up.T).reshape(n, -1)
        low, high = fine.min(axis=1, keepdims=True), fine.max(axis=1, keepdims=True)
        # In bins; two at either end take what the windows spread.
        self.fine = ((fine - low) * ((BINS - 5) / (high - low)) + 2).ravel()

    def at(self, maps: np.ndarray, which: np.ndarray, sloped: bool = True, bent: bool = False) -> tuple[np.ndarray, ...]:
        """(mutual information, with sloped its gradients, with bent the curvatures as they are to be expected) of the pairs named, each under its map.

        Minus infinity where too little meets or the area changes too much.
        """
        n, side, cells = len(which), self.side, BINS * BINS
        a = np.concatenate([np.eye(2) + maps[:, :4].reshape(n, 2, 2) / self.half, maps[:, 4:, None] + (self.size - 1) / 2], axis=2)
        place = (a @ self.points) * FINE
        inside = ((place >= 0) & (place <= side - 1)).all(axis=1)
        met, area = inside.sum(axis=1), a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
        fit = (met >= OVERLAP * inside.shape[1]) & (area > AREA[0]) & (area < AREA[1])
        met = np.maximum(met, 1)
        place = np.clip(place, 0, side - 1 - 1e-9)
        corner = place.astype(int)
        p, q = (place - corner).transpose(1, 0, 2)
        corner = corner[:, 1] * side + corner[:, 0] + (which * side * side)[:, None]
        left, right, low, high = (np.take(self.fine[k:], corner) for k in (0, 1, side, side + 1))
        right, high = right - left, high - low
        left, low = left + right * p, low + high * p
        low = low - left
        grey = left + low * q
        first = grey.astype(int)
        t = grey - first
        r = 1 - t
        t2, r2 = t * t, r * r
        cell = np.take(self.row, which, axis=0) + first + (np.arange(n) * cells - 1)[:, None]
        seen = inside / met[:, None]
        joint = np.zeros(n * cells + 3)
        for k, window in enumerate((r2 * r / 6, 2 / 3 - t2 + t2 * t / 2, 2 / 3 - r2 + r2 * r / 2, t2 * t / 6)):
            joint[k : n * cells + k] += np.bincount(cell.ravel(), (window * seen).ravel(), n * cells)
        joint = joint[: n * cells].reshape(n, BINS, BINS)
        rows, columns = joint.sum(axis=2), joint.sum(axis=1, keepdims=True)
        along = np.log(np.where(joint > 0, joint, 1.0) / np.where(joint > 0, columns, 1.0))
        value = (joint * along).sum(axis=(1, 2)) - (rows * np.log(np.where(rows > 0, rows, 1.0))).sum(axis=1)
        value = np.where(fit, value, -np.inf)
        if not sloped:
            return (value,)
        along = np.append(along.ravel(), np.zeros(3))
        pull = sum(np.take(along[k:], cell) * slope for k, slope in enumerate((-r2 / 2, 1.5 * t2 - 2 * t, 2 * r - 1.5 * r2, t2 / 2))) * seen
        steep = np.stack([right + (high - right) * q, low], axis=1) * FINE
        share = self.points / np.array([[self.half], [self.half], [1.0]])
        by = (steep * pull[:, None]) @ share.T
        slope = np.where(fit[:, None], np.concatenate([by[:, :, :2].reshape(n, 4), by[:, :, 2]], axis=1), 0.0)
        if not bent:
            return value, slope
        ways = np.concatenate([steep[:, :1] * share[:2], steep[:, 1:] * share[:2], steep], axis=1) * inside[:, None]
        return value, slope, (ways @ ways.transpose(0, 2, 1)) * (pull * pull).sum(axis=1)[:, None, None]


class Pair:
    """One pair of images (side, side)."""

    def __init__(self, fixed: np.ndarray, moving: np.ndarray) -> None:
        self.pairs = Pairs(fixed[None], moving[None])

    def at(self, m: np.ndarray) -> tuple[float, np.ndarray]:
        """(mutual information, its gradient)."""
        value, slope = self.pairs.at(m[None], np.zeros(1, int))
        return float(value[0]), slope[0]


def climbed(pairs: Pairs, maps: np.ndarray, steps: int, last: float) -> tuple[np.ndarray, np.ndarray]:
    """The maps at which quasi-Newton ascent of all pairs from theirs ends, by a step shorter than last, and their mutual information."""
    n, maps = len(maps), maps.copy()
    value, slope, bend = pairs.at(maps, np.arange(n), bent=True)
    inverse = np.linalg.inv(bend + (np.trace(bend, axis1=1, axis2=2)[:, None, None] / 600 + 1e-12) * np.eye(6))
    step, share, fresh = np.zeros((n, 6)), np.ones(n), np.ones(n, bool)
    live = np.flatnonzero(np.isfinite(value))
    for _ in range(steps):
        if not len(live):
            break
        new = live[fresh[live]]
        ahead = np.einsum("nij,nj->ni", inverse[new], slope[new])
        step[new] = ahead * np.minimum(1.0, 3.0 / np.maximum(np.linalg.norm(ahead, axis=1), 1e-30))[:, None]
        share[new], fresh[new] = 1.0, False
        moved = share[live][:, None] * step[live]
        after, steep = pairs.at(maps[live] + moved, live)
        up = after > value[live] + 1e-4 * (moved * slope[live]).sum(axis=1)
        short = np.linalg.norm(moved, axis=1) < last
        gone, stay = live[up], live[~up]
        turned, moved = slope[gone] - steep[up], moved[up]
        maps[gone], value[gone], slope[gone], fresh[gone] = maps[gone] + moved, after[up], steep[up], True
        share[stay] /= 3
        bend = (moved * turned).sum(axis=1)
        curved = bend > 1e-12
        k, turned, moved, bend = gone[curved], turned[curved, None, :], moved[curved, :, None], bend[curved, None, None]
        left = np.eye(6) - moved * turned / bend
        inverse[k] = left @ inverse[k] @ left.transpose(0, 2, 1) + moved * moved.transpose(0, 2, 1) / bend
        live = live[~short]
    return maps, value


def registered_together(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """registered, of pairs of images (n, side, side) and maps (n, 6)."""
    n, size = fixed.shape[:2]
    maps = None if start is None else np.concatenate([(start[:, :4] - np.eye(2).ravel()) * size / 2, start[:, 4:]], axis=1)
    value = np.zeros(n)
    for blur, last in list(zip(BLURS, LAST, strict=True))[start is not None :]:
        half = round(blur * size)
        pairs = Pairs(blurred(fixed, half), blurred(moving, half))
        if maps is None:
            shifts = np.array([[0, 0, 0, 0, dx * size, dy * size] for dx in SHIFTS for dy in SHIFTS])
            tried = np.stack([pairs.at(np.tile(s, (n, 1)), np.arange(n), sloped=False)[0] for s in shifts])
            best = shifts[np.argsort(-tried, axis=0, kind="stable")[:2]]
            ends, values = zip(*(climbed(pairs, s, TRIED, last) for s in [*best, np.zeros((n, 6))]), strict=True)
            maps = np.stack(ends)[np.argmax(values, axis=0), np.arange(n)]
        maps, value = climbed(pairs, maps, STEPS, last)
    return np.eye(2) + maps[:, :4].reshape(n, 2, 2) * 2 / size, maps[:, 4:], value


def registered(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(A, t, mutual information) about the centre with fixed(y) like moving(A(y - c) + c + t). start: a map (m00, m01, m10, m11, tx, ty) to refine."""
    a, t, value = registered_together(fixed[None], moving[None], None if start is None else start[None])
    return a[0], t[0], float(value[0])


def usable(fixed: np.ndarray, moving: np.ndarray) -> bool:
    side = int(len(fixed) ** 0.5)
    return len(fixed) == len(moving) and side * side == len(fixed) and side >= 4 and bool(np.isfinite(fixed).all() and np.isfinite(moving).all()) and min(np.ptp(fixed), np.ptp(moving)) >= 1e-12


def rows(pairs: Iterable[tuple]) -> pd.DataFrame:
    """FOUND of (fixed, moving, start): those of one size go together, with and without a start apart."""
    out, alike = [], defaultdict(list)

    def climb(kind: tuple[int, bool]) -> None:
        (side, given), (places, fixed, moving, start) = kind, zip(*alike.pop(kind), strict=True)
        a, t, value = registered_together(*(np.stack(v).reshape(-1, side, side) for v in (fixed, moving)), np.stack(start) if given else None)
        for k, place in enumerate(places):
            if np.isfinite(value[k]):
                back = np.linalg.inv(a[k])
                out[place] = [*back.ravel(), *(-back @ t[k]), value[k], True]

    for fixed, moving, start in pairs:
        out.append([None] * len(FOUND) if fixed is None or moving is None else [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, False])
        if fixed is None or moving is None:
            continue
        fixed, moving = (np.asarray(v, dtype=float) for v in (fixed, moving))
        if usable(fixed, moving):
            kind = (int(len(fixed) ** 0.5), start is not None)
            alike[kind].append((len(out) - 1, fixed, moving, start))
            if (len(alike[kind]) + 1) * len(fixed) > HELD:
                climb(kind)
    for kind in list(alike):
        climb(kind)
    return pd.DataFrame(out, columns=FOUND.names)


def register_pairs(fixed: pd.Series, moving: pd.Series) -> pd.DataFrame:
    return rows((f, m, None) for f, m in zip(fixed, moving, strict=True))


def refine_pairs(fixed: pd.Series, moving: pd.Series, start: pd.DataFrame) -> pd.DataFrame:
    def inner(s: tuple) -> np.ndarray | None:
        a = np.array(s[:4], dtype=float).reshape(2, 2)
        if not np.isfinite(a).all() or abs(np.linalg.det(a)) < 1e-9:
            return None
        back = np.linalg.inv(a)
        return np.concatenate([back.ravel(), -back @ np.array(s[4:], dtype=float)])

    return rows((f, m, inner(s)) for f, m, s in zip(fixed, moving, start[list(MAP)].itertuples(index=False, name=None), strict=True))


def registration(fixed: Column | str, moving: Column | str, start: Column | str | None = None) -> Column:
    """Struct of the affine map about the centre that brings each moving image onto its fixed one, as images.warp takes it (MAP), mi and registered.

    start: a struct of MAP, the map to refine.
    """
    if start is None:
        return F.pandas_udf(register_pairs, FOUND)(fixed, moving)
    return F.pandas_udf(refine_pairs, FOUND)(fixed, moving, start)
