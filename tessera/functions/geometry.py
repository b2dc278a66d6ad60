"""Plane affine algebra on struct columns.

A matrix is struct(m00, m01, m10, m11), a vector struct(x, y), an affine map y = Ax + b struct(a, b), and
one about an origin, y = A(x - O) + O + t, struct(a, t, origin).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .numbers import ZOOM, clamp, normal_rotation

TINY = 1e-12


def matrix(m00, m01, m10, m11) -> Column:
    parts = {"m00": m00, "m01": m01, "m10": m10, "m11": m11}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in parts.items()])


def vector(x, y) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in (("x", x), ("y", y))])


def affine(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def det(m: Column) -> Column:
    return m["m00"] * m["m11"] - m["m01"] * m["m10"]


def product(p: Column, q: Column) -> Column:
    entry = lambda i, j: p[f"m{i}0"] * q[f"m0{j}"] + p[f"m{i}1"] * q[f"m1{j}"]
    return matrix(entry(0, 0), entry(0, 1), entry(1, 0), entry(1, 1))


def applied(m: Column, v: Column) -> Column:
    return vector(m["m00"] * v["x"] + m["m01"] * v["y"], m["m10"] * v["x"] + m["m11"] * v["y"])


def transposed(m: Column) -> Column:
    return matrix(m["m00"], m["m10"], m["m01"], m["m11"])


def inverse(m: Column) -> Column:
    """The inverse; a singular matrix raises an error."""

    def of(p: Column) -> Column:
        d, a = p["d"], p["m"]
        singular = F.coalesce(F.isnan(d) | (F.abs(d) == float("inf")) | (F.abs(d) < TINY), F.lit(True))
        safe = F.when(singular, F.raise_error(F.lit("singular matrix")).cast("double")).otherwise(d)
        return matrix(a["m11"] / safe, -a["m01"] / safe, -a["m10"] / safe, a["m00"] / safe)

    return let(m, lambda a: let(F.struct(det(a).alias("d"), a.alias("m")), of))


def from_origin(a: Column, t: Column, origin: Column) -> Column:
    """About an origin, as y = Ax + b."""
    turned = applied(a, origin)
    return affine(a, vector(origin["x"] + t["x"] - turned["x"], origin["y"] + t["y"] - turned["y"]))


def about_origin(std: Column, origin: Column) -> Column:
    def of(p: Column) -> Column:
        s, o = p["s"], p["o"]
        turned = applied(s["a"], o)
        t = vector(s["b"]["x"] - o["x"] + turned["x"], s["b"]["y"] - o["y"] + turned["y"])
        return F.struct(s["a"].alias("a"), t.alias("t"), o.alias("origin"))

    return let(F.struct(std.alias("s"), origin.alias("o")), of)


def composed(outer: Column, inner: Column) -> Column:
    def of(p: Column) -> Column:
        o, i = p["o"], p["i"]
        moved = applied(o["a"], i["b"])
        return affine(product(o["a"], i["a"]), vector(moved["x"] + o["b"]["x"], moved["y"] + o["b"]["y"]))

    return let(F.struct(outer.alias("o"), inner.alias("i")), of)


def inverted(std: Column) -> Column:
    with_inverse = lambda m: let(inverse(m["a"]), lambda back: affine(back, applied(back, vector(-m["b"]["x"], -m["b"]["y"]))))
    return let(std, with_inverse)


def identity() -> Column:
    return affine(matrix(1, 0, 0, 1), vector(0, 0))


def chain(maps: Column) -> Column:
    """One map of an array of maps, applied in order."""
    return F.aggregate(maps, identity(), lambda done, step: composed(step, done))


def similarity(rotation: Column, zoom: Column) -> Column:
    c, s = F.cos(rotation * math.pi / 180), F.sin(rotation * math.pi / 180)
    return matrix(zoom * c, -zoom * s, zoom * s, zoom * c)


def decomposed(m: Column) -> Column:
    """Struct of rotation, zoom and residual with m = zoom * R * residual; a degenerate matrix is its own residual."""

    def of(p: Column) -> Column:
        a, theta, zoom = p["m"], p["theta"], p["zoom"]
        flat = F.isnan(zoom) | (zoom < TINY)
        c, s = F.cos(theta), F.sin(theta)
        scale = F.when(flat, F.lit(1.0)).otherwise(zoom)
        turned = product(matrix(c, s, -s, c), a)
        part = lambda k: F.when(flat, a[k]).otherwise(turned[k] / scale)
        return F.struct(F.when(flat, F.lit(0.0)).otherwise(theta * 180 / math.pi).alias("rotation"), scale.alias("zoom"), matrix(*map(part, ("m00", "m01", "m10", "m11"))).alias("residual"))

    parts = lambda a: F.struct(a.alias("m"), F.atan2(a["m10"] - a["m01"], a["m00"] + a["m11"]).alias("theta"), F.sqrt(F.abs(det(a))).alias("zoom"))
    return let(m, lambda a: let(parts(a), of))


def recomposed(rotation: Column, zoom: Column, residual: Column) -> Column:
    return product(similarity(rotation, zoom), residual)


def css_arguments(m: Column) -> Column:
    return F.struct(m["m00"].alias("a"), m["m10"].alias("b"), m["m01"].alias("c"), m["m11"].alias("d"))


def panel_affine(g: Column, size: Column) -> Column:
    """Panel geometry (zoom, rotation, pan_x, pan_y, affine00 .. affine11) about the centre of a square of this size."""
    centre = vector((size - 1) / 2, (size - 1) / 2)
    a = recomposed(g["rotation"], g["zoom"], matrix(g["affine00"], g["affine01"], g["affine10"], g["affine11"]))
    return F.struct(a.alias("a"), vector(g["pan_x"] * size, g["pan_y"] * size).alias("t"), centre.alias("origin"))


def panel_geometry(a: Column, t: Column, size: Column) -> Column:
    d = decomposed(a)
    r = d["residual"]
    values = {"zoom": clamp(d["zoom"], *ZOOM), "rotation": normal_rotation(d["rotation"]), "pan_x": clamp(t["x"] / size, -1.0, 1.0), "pan_y": clamp(t["y"] / size, -1.0, 1.0)}
    values |= {"affine00": r["m00"], "affine01": r["m01"], "affine10": r["m10"], "affine11": r["m11"]}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def plane_from_orientation(cosines: Column) -> Column:
    """Plane of an array of six direction cosines: the dominant axis of their cross product (ties: x, y, z); null for fewer."""
    v = lambda i: F.get(cosines, F.lit(i))
    x, y, z = (F.abs(v(a) * v(b) - v(c) * v(d)) for a, b, c, d in ((1, 5, 2, 4), (2, 3, 0, 5), (0, 4, 1, 3)))
    return F.when(F.size(cosines) < 6, F.lit(None)).when((x >= y) & (x >= z), "Sagittal").when((y >= x) & (y >= z), "Coronal").otherwise("Axial")


def base_point(x: Column, y: Column, width: Column, height: Column, g: Column) -> Column:
    """A point on the screen in coordinates of the unmoved panel."""
    zoom = F.when(~F.isnan(g["zoom"]) & (F.abs(g["zoom"]) > 1e-8), g["zoom"]).otherwise(F.lit(1.0))
    angle, m = -g["rotation"] * math.pi / 180, matrix(g["affine00"], g["affine01"], g["affine10"], g["affine11"])

    def turned(p: Column) -> Column:
        c, s = p["c"], p["s"]
        return let(vector(c * p["u"] - s * p["v"], s * p["u"] + c * p["v"]), unsheared)

    def unsheared(p: Column) -> Column:
        d = det(m)
        solid = ~F.isnan(d) & (F.abs(d) >= 1e-10)
        over = F.when(solid, d).otherwise(F.lit(1.0))
        back_x = F.when(solid, (m["m11"] * p["x"] - m["m01"] * p["y"]) / over).otherwise(p["x"])
        back_y = F.when(solid, (m["m00"] * p["y"] - m["m10"] * p["x"]) / over).otherwise(p["y"])
        return vector(back_x + width / 2, back_y + height / 2)

    start = {"u": (x - width / 2 - g["pan_x"] * width) / zoom, "v": (y - height / 2 - g["pan_y"] * height) / zoom, "c": F.cos(angle), "s": F.sin(angle)}
    return let(F.struct(*[v.alias(k) for k, v in start.items()]), turned)


def screen_mask(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, g: Column) -> Column:
    """Normalised bounding box, within the panel, of a rectangle drawn on the screen."""

    def boxed(corners: Column) -> Column:
        box = {}
        for axis, size in (("x", width), ("y", height)):
            low = clamp(F.array_min(corners.getField(axis)), F.lit(0.0), size)
            high = clamp(F.array_max(corners.getField(axis)), F.lit(0.0), size)
            box[axis] = F.when(size > 0, clamp(low / size, 0.0, 1.0)).otherwise(F.lit(0.0))
            box["width" if axis == "x" else "height"] = F.when(size > 0, clamp((high - low) / size, 0.0, 1.0)).otherwise(F.lit(0.0))
        return F.struct(*[box[k].alias(k) for k in ("x", "y", "width", "height")])

    return let(F.array(*[base_point(a, b, width, height, g) for a in (x, x + w) for b in (y, y + h)]), boxed)


PARAMETER_MAP = "array<map<string,array<string>>>"


def affine_of_parameters(entry: Column) -> Column:
    """A transform parameter map as y = Ax + b; wrong type, too few values or text that is no number raise an error."""
    numbers = lambda key: F.transform(F.try_element_at(entry, F.lit(key)), lambda s: s.try_cast("double"))
    p, c = numbers("TransformParameters"), numbers("CenterOfRotationPoint")
    kind = F.try_element_at(F.try_element_at(entry, F.lit("Transform")), F.lit(1))
    bad = lambda v, n: F.coalesce((F.size(v) < n) | F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    problem = F.when(~kind.eqNullSafe(F.lit("AffineTransform")), "expected AffineTransform").when(bad(p, 6), "bad TransformParameters").when(bad(c, 2), "bad CenterOfRotationPoint")
    a = matrix(*[F.get(p, F.lit(i)) for i in range(4)])
    std = from_origin(a, vector(F.get(p, F.lit(4)), F.get(p, F.lit(5))), vector(F.get(c, F.lit(0)), F.get(c, F.lit(1))))
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("struct<a:struct<m00:double,m01:double,m10:double,m11:double>,b:struct<x:double,y:double>>")).otherwise(std)


def affine_of_json(text: Column) -> Column:
    """The map that a JSON list of transform parameter maps stands for, applied in order."""
    return chain(F.transform(F.from_json(text, PARAMETER_MAP), affine_of_parameters))


def transform_candidates(maps: Column) -> Column:
    """Array of (label, std): the chain forward and reversed, direct and inverted."""

    def of(p: Column) -> Column:
        named = {"forward": p["f"], "reverse": p["r"], "forward-inverse": inverted(p["f"]), "reverse-inverse": inverted(p["r"])}
        return F.array(*[F.struct(F.lit(k).alias("label"), v.alias("std")) for k, v in named.items()])

    return let(F.struct(chain(maps).alias("f"), chain(F.reverse(maps)).alias("r")), of)
