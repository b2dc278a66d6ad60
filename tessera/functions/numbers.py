"""Clamping, slices, rotations, playback and layout as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits of the display controls.
ZOOM, ROTATION_STEP, BRIGHTNESS, CONTRAST = (0.1, 10.0), 0.25, (0.0, 200.0), (0.0, 200.0)
#: Fixed steps of the controls.
STEPS = {"zoom": 0.01, "brightness": 1.0, "contrast": 1.0}
LEAST_GAP = 0.01


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within the bounds; NaN stays NaN."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(F.isnan(x.cast("double")), x).otherwise(F.greatest(low, F.least(high, x)))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def clamp_int(x: Column, low: Column | int, high: Column | int) -> Column:
    return clamp(truncated(x), low, high).cast("int")


def half_up(x: Column) -> Column:
    """Rounded with halves upwards, also below zero."""
    return F.floor(x + 0.5)


def normal_rotation(degrees: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360)) - 180


def instance_index(index: Column, count: Column, reverse: Column) -> Column:
    """The stored position of a shown one."""
    last = F.greatest(F.lit(0), count - 1)
    at = clamp(index, F.lit(0), last)
    return F.when(reverse, last - at).otherwise(at).cast("int")


def slice_index(count: Column, progress: Column, offset: Column) -> Column:
    last = F.greatest(F.lit(0), count - 1)
    return clamp(half_up(progress * last) + offset, F.lit(0), last).cast("int")


def progress_at(index: Column, count: Column, offset: Column) -> Column:
    """The progress that shows an index; 0 for a single slice."""
    return F.when(count > 1, clamp01((index - offset) / (count - 1))).otherwise(F.lit(0.0))


def wheel_progress(progress: Column, count: Column, steps: Column) -> Column:
    """Progress after a number of wheel steps."""
    at = slice_index(count, progress, F.lit(0))
    return progress_at(clamp(at + steps, F.lit(0), F.greatest(F.lit(0), count - 1)), count, F.lit(0))


def loop_bounds(start: Column, end: Column) -> Column:
    """Struct of start and end within [0, 1], LEAST_GAP apart (less at the very top)."""
    first = clamp01(start)
    return F.struct(first.alias("start"), clamp01(F.greatest(clamp01(end), first + LEAST_GAP)).alias("end"))


def ping_pong(position: Column, start: Column, end: Column) -> Column:
    """A position reflected at both bounds as often as needed: a triangle wave."""
    width = F.greatest(end - start, F.lit(1e-12))
    phase = F.pmod(position - start, 2 * width)
    return start + F.when(phase > width, 2 * width - phase).otherwise(phase)


def centred_pan(pan: Column, size: Column, click: Column) -> Column:
    """The pan that brings the clicked point to the middle."""
    return (size / 2 - click + pan * size) / size


def stepped_rotation(degrees: Column, steps: Column) -> Column:
    return normal_rotation(degrees + steps * ROTATION_STEP)


def stepped(control: str, value: Column, steps: Column) -> Column:
    """A control after steps up, or down if negative, within its limits."""
    limits = {"zoom": ZOOM, "brightness": BRIGHTNESS, "contrast": CONTRAST}[control]
    return clamp(value + steps * STEPS[control], *limits)


def repeat_interval(n: Column) -> Column:
    """Milliseconds before the n-th repeat of a held button."""
    return F.greatest(F.lit(30), 150 - 10 * n)


def viewer_size(width: Column, height: Column, margin: float = 0.0, least: float = 1.0) -> Column:
    """Side of the square viewer that fits an area."""
    return F.greatest(F.lit(least), F.floor(F.least(width, height) - margin))


def grid_layout(items: Column, width: Column, height: Column, gap: float, header: float) -> Column:
    """Struct of cols and cell_size: the first number of columns with the largest square cells."""

    def cell(cols: Column) -> Column:
        rows = F.ceil(items / cols)
        return F.least((width - (cols - 1) * gap) / cols, (height - rows * header - (rows - 1) * gap) / rows)

    tried = F.transform(F.sequence(F.lit(1), F.greatest(items, F.lit(1))), lambda c: F.struct(cell(c).alias("size"), (-c).alias("order")))
    best = F.array_max(F.filter(tried, lambda t: t["size"] > 0))
    size = F.coalesce(best["size"], F.lit(0.0))
    return F.struct(F.coalesce(-best["order"], F.lit(1)).cast("int").alias("cols"), F.floor(F.greatest(F.least(size, F.least(width, height - header)), F.lit(100.0))).alias("cell_size"))
