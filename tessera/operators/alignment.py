"""Alignment of slices between dates: scoring, the search with early stops, choice of transforms, settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, images
from ..functions.binding import let
from ..functions.numbers import half_up
from ..functions.registration import MAP, registration
from ..schemas import SETTINGS

STOP = 2
#: Slices that a task warps and scores at most, and dates up to which their maps are broadcast (some 200 bytes each).
PART_SLICES, BROADCAST_DATES = 4_000, 500_000


def start_slice(reference_index: Column, reference_count: Column, count: Column) -> Column:
    """The slice at the reference's relative position."""
    at = half_up(reference_index / F.greatest(F.lit(1), reference_count - 1) * (count - 1))
    return F.greatest(F.lit(0), F.least(count - 1, at)).cast("int")


def one_side(scores: Column, indices: Column, start_score: Column, stop: int) -> Column:
    """How many of the slices of one side, in order, are visited before falling scores stop the search."""
    state = F.struct(start_score.alias("last"), F.lit(0).alias("streak"), F.lit(0).alias("seen"), F.lit(False).alias("over"))

    def step(acc: Column, i: Column) -> Column:
        score = F.get(scores, i)
        streak = F.when(score < acc["last"], acc["streak"] + 1).otherwise(F.lit(0))
        next_ = F.struct(score.alias("last"), streak.alias("streak"), (acc["seen"] + 1).alias("seen"), (streak >= stop).alias("over"))
        return F.when(acc["over"], acc).otherwise(next_)

    return F.aggregate(indices, state, step, lambda acc: acc["seen"])


def searched(scores: Column, start: Column, stop: int = STOP) -> Column:
    """Struct of best_index, best_score and slices_checked of the two-sided search over all scores.

    The start is visited first, then left and right in turn; each side ends at the border or after stop
    falls in a row. A later visit must be strictly better. This is not the maximum of all scores.
    """
    n = F.size(scores)
    first = F.get(scores, start)
    left = F.when(start > 0, F.sequence(start - 1, F.lit(0))).otherwise(F.array().cast("array<int>"))
    right = F.when(start < n - 1, F.sequence(start + 1, n - 1)).otherwise(F.array().cast("array<int>"))
    to_left, to_right = one_side(scores, left, first, stop), one_side(scores, right, first, stop)
    visits = F.concat(
        F.array(F.struct(first.alias("score"), F.lit(0).alias("later"), start.alias("index"))),
        F.transform(F.slice(left, F.lit(1), to_left), lambda i, k: F.struct(F.get(scores, i).alias("score"), (-(2 * k + 1)).alias("later"), i.alias("index"))),
        F.transform(F.slice(right, F.lit(1), to_right), lambda i, k: F.struct(F.get(scores, i).alias("score"), (-(2 * k + 2)).alias("later"), i.alias("index"))),
    )
    best = F.array_max(visits)
    found = F.struct(best["index"].alias("best_index"), best["score"].alias("best_score"), F.size(visits).alias("slices_checked"))
    return F.when(n > 0, found).otherwise(F.struct(F.lit(0).alias("best_index"), F.lit(0.0).alias("best_score"), F.lit(0).alias("slices_checked")))


def scored(slices: DataFrame, reference: DataFrame, bins: int = 32, mask: Column | None = None, size: Column | None = None) -> DataFrame:
    """slices (key, position, pixels) with the mutual information of each with the one reference (reference_pixels).

    The reference is a table of one row, joined without a condition; without it there are no rows.
    """
    both = slices.join(F.broadcast(reference.limit(1)))
    return both.withColumn("score", images.mutual_information(F.col("reference_pixels"), F.col("pixels"), bins, mask, size)["nmi"])


def best_slices(scored_slices: DataFrame, key: str, reference_index: int, reference_count: int, stop: int = STOP) -> DataFrame:
    """The search's result for each key; a series' scores are one short array."""
    listed = scored_slices.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "score"))), lambda s: s["score"]).alias("scores"))
    start = start_slice(F.lit(reference_index), F.lit(reference_count), F.size("scores"))
    return listed.withColumn("found", searched(F.col("scores"), start, stop)).select(key, "found.*")


def chosen_candidate(rows: DataFrame) -> DataFrame:
    """Of rows (key, moving, resampled, size, maps) the transform candidate whose warp is nearest to the resampled image."""
    each = rows.withColumn("c", F.explode(geometry.transform_candidates(F.col("maps"))))
    centre = geometry.vector((F.col("size") - 1) / 2, (F.col("size") - 1) / 2)
    each = each.withColumn("about", geometry.about_origin(F.col("c.std"), centre))
    a = F.col("about.a")
    each = each.withColumn("warped", images.warp("moving", "size", a["m00"], a["m01"], a["m10"], a["m11"], F.col("about.t.x"), F.col("about.t.y")))
    each = each.withColumn("d", images.differences(F.col("resampled"), F.col("warped")))
    place = F.array_position(F.array(*map(F.lit, ("forward", "reverse", "forward-inverse", "reverse-inverse"))), F.col("c.label"))
    return each.groupBy("key").agg(F.min_by(F.struct(F.col("c.label").alias("label"), "about", F.col("d.mad").alias("mad"), F.col("d.max_abs").alias("max_abs")), F.struct("d.mad", place)).alias("best")).select("key", "best.*")


def slice_offset(index: Column, count: Column, progress: Column) -> Column:
    return index - half_up(progress * F.greatest(F.lit(0), count - 1))


def reversed_offset(offset: Column, best: Column, count: Column, reverse: Column) -> Column:
    """The offset that shows the same stored slice if the order is reversed."""
    return F.when(reverse & (count > 0), offset + (count - 1 - best) - best).otherwise(offset)


def aligned_geometry(reference: Column, a: Column, t: Column, size: Column) -> Column:
    """Panel geometry of a target that a registration (a, t about the centre) maps onto a reference with this geometry."""

    def of(p: Column) -> Column:
        view, origin = p["view"], p["view"]["origin"]
        both = geometry.composed(geometry.from_origin(view["a"], view["t"], origin), geometry.from_origin(p["a"], p["t"], origin))
        return let(geometry.about_origin(both, origin), lambda about: geometry.panel_geometry(about["a"], about["t"], p["size"]))

    return let(F.struct(geometry.panel_affine(reference, size).alias("view"), a.alias("a"), t.alias("t"), size.alias("size")), of)


def aligned_settings(reference_stats: Column, target_stats: Column, index: Column, count: Column, progress: Column, g: Column) -> Column:
    """All settings of an aligned panel."""

    def of(p: Column) -> Column:
        match, g = p["match"], p["g"]
        values = {"offset": slice_offset(index, count, progress).cast("double"), "reverse_slice_order": F.lit(False), "zoom": g["zoom"], "rotation": g["rotation"], "brightness": match["brightness"].cast("double"), "contrast": match["contrast"].cast("double")}
        values |= {k: g[k] for k in ("pan_x", "pan_y", "affine00", "affine01", "affine10", "affine11")} | {"progress": progress}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    return let(F.struct(images.intensity_match(reference_stats, target_stats).alias("match"), g.alias("g")), of)


def applied_results(results: DataFrame, settings: DataFrame, cells: DataFrame) -> DataFrame:
    """Settings to store of alignment results (date_iso, best_slice_index and settings).

    The slice order that is set for a date stays; where it is reversed, the offset is turned so that the
    same stored slice shows. settings: date_iso, reverse_slice_order; cells: date_iso, instance_count of the combo.
    """
    order = settings.select("date_iso", F.col("reverse_slice_order").alias("_reverse"))
    sizes = cells.select("date_iso", F.col("instance_count").alias("_count"))
    both = results.join(order, "date_iso", "left").join(sizes, "date_iso", "left").withColumn("_reverse", F.coalesce("_reverse", F.lit(SETTINGS["reverse_slice_order"][1])))
    offset = F.coalesce(reversed_offset(F.col("offset"), F.col("best_slice_index"), F.col("_count"), F.col("_reverse")), "offset")
    return both.withColumn("offset", offset).withColumn("reverse_slice_order", F.col("_reverse")).drop("_reverse", "_count")


def average_score(results: DataFrame, score: str = "best_score") -> DataFrame:
    """The mean score of the aligned dates; NaN without any."""
    return results.agg(F.coalesce(F.avg(score), F.lit(float("nan"))).alias("average"))


def aligned_dates(reference: DataFrame, slices: DataFrame, bins: int = 32, stop: int = STOP, mask: Column | None = None, pixels: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Alignment of all target dates to a reference, in one plan: seed, search, registration, settings.

    reference is one row: pixels, index, count, progress, geometry (a struct of panel geometry), brightness and contrast; slices: date_iso,
    position (from 0 within the date, without gaps), pixels, of the reference's side. The slice at the reference's place is
    registered first; its map warps all slices of the date for the search, and is refined on the slice found. Per date: best_slice_index,
    best_score, slices_checked, nmi_score (of the registered slice), registered (false where no map could be found: then the identity stands) and the
    computed settings. mask: a rectangle that the search leaves out. Dates without slices have no row.

    pixels adds the column of that name to slices that come without it: to all for the search, to one a date for the registrations.
    Slices are dealt by date and position, in as many parts as they need, so a date of any number of slices is scored by all tasks.
    """
    drawn = pixels or (lambda rows: rows)
    shown = images.displayed(F.col("pixels"), F.col("brightness"), F.col("contrast"))
    one = reference.select(F.col("pixels").alias("reference_pixels"), *[F.col(c).alias(f"_{c}") for c in ("index", "count", "progress", "geometry")], images.statistics(shown).alias("_stats"))
    one = F.broadcast(one.limit(1))
    counts = slices.groupBy("date_iso").agg(F.count("*").cast("int").alias("slices"))
    # Dates are few and each is long work: they are dealt over all tasks, whatever their size.
    deal = slices.sparkSession.sparkContext.defaultParallelism
    total = counts.agg(F.count("*").alias("dates"), F.coalesce(F.sum("slices"), F.lit(0)).alias("slices")).first()
    parts = max(deal, -(-total["slices"] // PART_SLICES))
    by_date = lambda rows: F.broadcast(rows) if total["dates"] <= BROADCAST_DATES else rows

    def placed(rows: DataFrame, place: str) -> DataFrame:
        """Rows a date, with the slice of the date at a place."""
        dates = rows.withColumnRenamed("date_iso", "_date")
        return slices.join(by_date(dates), (F.col("date_iso") == F.col("_date")) & (F.col("position") == F.col(place))).drop("_date").join(one).repartition(deal)

    starts = counts.join(one.select("_index", "_count")).select("date_iso", "slices", start_slice(F.col("_index"), F.col("_count"), F.col("slices")).alias("start"))
    seeds = drawn(placed(starts, "start")).select("date_iso", "slices", "start", registration("reference_pixels", "pixels").alias("seed"))
    size = F.sqrt(F.size("pixels")).cast("int")
    near = drawn(slices.join(by_date(seeds), "date_iso").repartition(parts, "date_iso", "position")).withColumn("pixels", images.warp("pixels", size, *[F.col(f"seed.{k}") for k in MAP]))
    scores = scored(near, one, bins, mask, size if mask is not None else None).select("date_iso", "position", "score", "slices", "start", "seed")
    listed = scores.groupBy("date_iso").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "score"))), lambda s: s["score"]).alias("scores"), *[F.first(c).alias(c) for c in ("slices", "start", "seed")])
    found = listed.select("date_iso", "slices", "seed", searched(F.col("scores"), F.col("start"), stop).alias("found")).select("date_iso", "slices", "seed", "found.*")
    best = drawn(placed(found, "best_index")).withColumn("m", registration("reference_pixels", "pixels", F.struct(*[F.col(f"seed.{k}") for k in MAP])))
    moved = images.warp("pixels", size, *[F.col(f"m.{k}") for k in MAP])
    best = best.withColumn("moved", moved).withColumn("nmi_score", images.mutual_information(F.col("reference_pixels"), F.col("moved"), bins)["nmi"])
    a, t = geometry.matrix(*[F.col(f"m.{k}") for k in ("m00", "m01", "m10", "m11")]), geometry.vector(F.col("m.tx"), F.col("m.ty"))
    best = best.withColumn("g", aligned_geometry(F.col("_geometry"), a, t, size.cast("double"))).withColumn("t_stats", images.statistics(F.col("moved")))
    settings = aligned_settings(F.col("_stats"), F.col("t_stats"), F.col("best_index"), F.col("slices"), F.col("_progress"), F.col("g"))
    return best.select("date_iso", F.col("best_index").alias("best_slice_index"), "best_score", "slices_checked", "nmi_score", F.col("m.registered").alias("registered"), settings.alias("s")).select("date_iso", "best_slice_index", "best_score", "slices_checked", "nmi_score", "registered", "s.*")
