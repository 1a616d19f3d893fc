"""Comparison of predicted with reference curves, point by point, in DataFrame operations.

Points are rows (figure_id, curve_id, role "pred" or "gt", ord, x, y). All joins are on the figure, so a pair of curves
meets only within its figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvemill.operators import nearest
from curvemill.staging import settled

#: Fixed value: a reference whose y values span no more than this is flat.
FLAT = 1e-12


def sorted_points(points: DataFrame) -> DataFrame:
    """Points with their place in the curve: stable order by x, then as they came."""
    return points.withColumn("place", F.row_number().over(W.partitionBy("figure_id", "role", "curve_id").orderBy("x", "ord")))


def curve_stats(points: DataFrame) -> DataFrame:
    """Number and extent of each curve's points."""
    return points.groupBy("figure_id", "role", "curve_id").agg(
        F.count("*").alias("n_points"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )


def pairs(points: DataFrame) -> DataFrame:
    """Every predicted with every reference curve of the same figure, with both extents: one scan, a row for each figure on the way."""
    names = ("curve_id", "n_points", "x_min", "x_max", "y_min", "y_max")
    side = lambda role: F.collect_list(F.when(F.col("role") == role, F.struct(*(F.col(c).alias(f"{role}_{c}") for c in names)))).alias(role)
    figures = curve_stats(points).groupBy("figure_id").agg(side("pred"), side("gt"))
    crossed = figures.select("figure_id", F.explode("pred").alias("p"), "gt").select("figure_id", "p", F.explode("gt").alias("g"))
    return crossed.select("figure_id", "p.*", "g.*")


def coverage(gt_low: Column, gt_high: Column, low: Column, high: Column) -> Column:
    """Share of the reference's x range that the prediction's covers; a single reference point is inside or not."""
    span = gt_high - gt_low
    inside = F.when((gt_low >= low) & (gt_low <= high), 1.0).otherwise(0.0)
    return F.when(span == 0, inside).otherwise(F.greatest(F.lit(0.0), F.least(gt_high, high) - F.greatest(gt_low, low)) / F.nullif(span, F.lit(0.0)))


def with_coverage(found: DataFrame) -> DataFrame:
    return found.withColumn("coverage", coverage(F.col("gt_x_min"), F.col("gt_x_max"), F.col("pred_x_min"), F.col("pred_x_max")))


KEYS = ("figure_id", "pred_curve_id", "gt_curve_id")


#: Points of a pair of curves that are sorted together; a pair with more of them is cut into ranges of x.
RANGE_POINTS = 100_000
STATS = tuple(f"{role}_{c}" for role in ("pred", "gt") for c in ("n_points", "x_min", "x_max", "y_min", "y_max"))


def interpolated(points: DataFrame, wanted: DataFrame | None = None, range_points: int = RANGE_POINTS) -> DataFrame:
    """Every reference point of a pair with the predicted y at its x: linear between neighbours, the edge's value beyond.

    An as-of join as a union: predicted and reference points of a pair are sorted by x together, and the nearest
    predicted points before and after come from a running last and first. The last of equal x counts before, as in a
    bracket search from the right. wanted limits the pairs (rows as pairs gives them); its other columns come along, so
    that nothing has to be joined to the samples again.

    A pair of more than range_points points is cut into ranges of equal width in x, which are sorted on their own. A
    range's summary is its first and its last predicted point; summaries, of which a pair has few, are combined from
    either side, and what comes out is carried into each range: the last point before it and the first one after it.
    """
    at = pairs(points) if wanted is None else wanted
    more = [c for c in at.columns if c not in (*KEYS, *STATS)]
    low, high = F.least("pred_x_min", "gt_x_min"), F.greatest("pred_x_max", "gt_x_max")
    many = F.ceil((F.col("pred_n_points") + F.col("gt_n_points")) / range_points)
    cut = (high > low) & (high - low < float("inf")) & (many > 1)
    at = at.select(*KEYS, *more, low.alias("low_"), (high - low).alias("span_"), F.when(cut, many).otherwise(1).cast("long").alias("ranges_"))
    within = F.when(F.col("ranges_") > 1, F.least(F.col("ranges_") - 1, F.floor((F.col("x") - F.col("low_")) / F.nullif(F.col("span_"), F.lit(0.0)) * F.col("ranges_")))).otherwise(0)
    dots = points.select("figure_id", "role", "curve_id", "ord", "x", "y")

    def met(of: DataFrame) -> DataFrame:
        ends = F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"{role}_curve_id").alias("curve_id")) for role in ("pred", "gt")))
        sides = of.withColumn("end", F.explode(ends)).select(*(c for c in of.columns), "end.*")
        both = sides.join(dots, ["figure_id", "role", "curve_id"]).withColumn("is_gt", (F.col("role") == "gt").cast("int"))
        return both.withColumns({"point": F.when(F.col("is_gt") == 0, F.struct("x", "y")), "range_": within})

    both = met(at)
    order = W.partitionBy(*KEYS, "range_").orderBy("x", "is_gt", "ord")
    both = both.withColumn("before", F.last("point", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    back = W.partitionBy(*KEYS, "range_").orderBy(F.desc("x"), F.desc("is_gt"), F.desc("ord"))
    both = both.withColumn("after", F.last("point", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))

    large = at.where("ranges_ > 1")
    place = F.struct("x", "ord")
    summaries = met(large).where("is_gt = 0").groupBy(*KEYS, "range_").agg(F.min_by("point", place).alias("first_"), F.max_by("point", place).alias("last_"))
    every = large.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges_") - 1)).alias("range_")).join(summaries, [*KEYS, "range_"], "left")
    line = W.partitionBy(*KEYS).orderBy("range_")
    carried = every.select(*KEYS, "range_", F.last("last_", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("prior_"), F.first("first_", ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("next_"))
    both = both.join(carried, [*KEYS, "range_"], "left").withColumns({"before": F.coalesce("before", "prior_"), "after": F.coalesce("after", "next_")})

    a, b = F.col("before"), F.col("after")
    slope = (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    value = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).when(a["x"] == F.col("x"), a["y"]).otherwise(slope * (F.col("x") - a["x"]) + a["y"])
    return both.where("is_gt = 1").select(*KEYS, *more, "ord", "x", F.col("y").alias("gt_y"), value.alias("pred_y"))


def point_errors(samples: DataFrame, *also: str) -> DataFrame:
    """Mean over the reference's points of the distance in y, by the reference's y_range (a column of samples); a flat one counts exact hits."""
    off = F.abs(F.col("pred_y") - F.col("gt_y"))
    error = F.when(F.col("y_range") <= FLAT, F.when(off <= FLAT, 0.0).otherwise(1.0)).otherwise(off / F.nullif(F.col("y_range"), F.lit(0.0)))
    return samples.groupBy(*KEYS, *also).agg(F.avg(error).alias("mean_error"))


def chamfer(points: DataFrame, found: DataFrame, block: int = nearest.BLOCK) -> DataFrame:
    """Mean of the nearest distances in both directions, x and y by the reference's ranges; found: pairs.

    Two curves of at most block points each are compared at once; longer ones by blocks, of which only those meet that
    can hold a nearest point (see nearest).
    """
    units = [F.when(F.col(f"gt_{c}_max") == F.col(f"gt_{c}_min"), 1.0).otherwise(F.col(f"gt_{c}_max") - F.col(f"gt_{c}_min")).alias(f"{c}_range") for c in "xy"]
    scale = settled(found.select("*", *units))
    short = (F.col("pred_n_points") <= block) & (F.col("gt_n_points") <= block)
    at_once = _chamfer_at_once(points, scale.where(short))
    return at_once if scale.where(~short).isEmpty() else at_once.unionByName(_chamfer_by_blocks(points, scale.where(~short), block))


def _chamfer_by_blocks(points: DataFrame, scale: DataFrame, block: int) -> DataFrame:
    side = lambda role: scale.select("figure_id", F.lit(role).alias("role"), F.col(f"{role}_curve_id").alias("curve_id"), *(F.col(f"{role}_{c}").alias(c) for c in ("n_points", "x_min", "x_max")))
    cut = settled(nearest.blocks(points, side("pred").unionByName(side("gt")).distinct(), block))
    there, back = (nearest.nearest_means(cut, scale, *roles) for roles in (("pred", "gt"), ("gt", "pred")))
    return there.join(back.withColumnRenamed("mean", "back"), list(KEYS)).select(*KEYS, ((F.col("mean") + F.col("back")) / 2).alias("chamfer"))


def _chamfer_at_once(points: DataFrame, scale: DataFrame) -> DataFrame:
    # whole curves as arrays, without the points of long ones
    ends = F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"{role}_curve_id").alias("curve_id")) for role in ("pred", "gt")))
    mine = scale.select("figure_id", F.explode(ends).alias("end")).select("figure_id", "end.*").distinct()
    packed = points.join(mine, ["figure_id", "role", "curve_id"], "left_semi").groupBy("figure_id", "role", "curve_id").agg(F.collect_list(F.struct("x", "y")).alias("points"))
    side = lambda role: packed.where(F.col("role") == role).select("figure_id", F.col("curve_id").alias(f"{role}_curve_id"), F.col("points").alias(role))
    rows = scale.select(*KEYS, "x_range", "y_range").join(side("pred"), ["figure_id", "pred_curve_id"]).join(side("gt"), ["figure_id", "gt_curve_id"])
    scaled = lambda role: F.transform(role, lambda p: F.struct((p["x"] / F.col("x_range")).alias("x"), (p["y"] / F.col("y_range")).alias("y")))
    rows = rows.select(*KEYS, scaled("pred").alias("pred"), scaled("gt").alias("gt"))
    square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    one_way = lambda a, b: F.aggregate(F.transform(a, lambda p: F.sqrt(F.array_min(F.transform(b, lambda q: square(p, q))))), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return rows.select(*KEYS, ((one_way("pred", "gt") + one_way("gt", "pred")) / 2).alias("chamfer"))


def in_log_space(points: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with x as log10 where the figure's reference scale is "log", and the figures that this is impossible for.

    scales: (figure_id, x_scale). One x that isn't positive spoils its whole figure: (figure_id, error).
    """
    scaled = points.join(scales, "figure_id", "left")
    log = F.coalesce(F.col("x_scale") == "log", F.lit(False))
    bad = scaled.where(log & (F.col("x") <= 0)).select("figure_id").distinct()
    good = scaled.join(bad, "figure_id", "left_anti").withColumn("x", F.when(log, F.log10("x")).otherwise(F.col("x"))).drop("x_scale")
    return good, bad.withColumn("error", F.lit("ValueError: log scale requires positive x"))


def compared(points: DataFrame) -> DataFrame:
    """All pairs with coverage, mean error (1 where nothing is covered) and distance: the error, at most 1."""
    found = with_coverage(pairs(points)).withColumn("y_range", F.col("gt_y_max") - F.col("gt_y_min"))
    errors = point_errors(interpolated(points, found.where("coverage > 0")), "coverage")
    apart = found.where("coverage <= 0").select(*KEYS, "coverage", F.lit(1.0).alias("mean_error"))
    return errors.unionByName(apart).select(*KEYS, "coverage", "mean_error", F.least("mean_error", F.lit(1.0)).alias("distance"))
