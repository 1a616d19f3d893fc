"""Panels of a figure: gaps and islands over the background shares of an image's rows and columns.

Pixels are rows (image_id, x, y, lum). Everything is grouped by image; the first step reduces an image to its rows and
columns, so what windows sort is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvemill.staging import settled

#: Tunables of the grid and their defaults.
DEFAULTS = {"background": 245, "gutter": 0.98, "min_gutter": 3, "min_content": 0.02, "max_panels": 26, "min_size": 0.05, "min_runs": 4, "max_cv": 0.3}


def profile(pixels: DataFrame, axis: str, background: int = 245) -> DataFrame:
    """Share of background pixels of each row ("y") or column ("x") of every image."""
    return pixels.groupBy("image_id", F.col(axis).alias("i")).agg(F.avg((F.col("lum") >= background).cast("double")).alias("share"))


#: Rows that are looked at together for runs.
SEGMENT = 4096


def runs(rows: DataFrame, keys: list[str], at: str, flag: Column, segment: int = SEGMENT) -> DataFrame:
    """Maximal runs of equal flags at consecutive numbers: keys, flag, lo, hi (end exclusive).

    Runs are found in segments of rows, so that a long column of them is many groups. A segment's summary is its first
    and last run (one and the same, if it has no other); only these can go on in the next segment, and only they are
    put together in order. The runs between them are final.
    """
    part = F.floor(F.col(at) / segment).alias("_segment")
    flagged = rows.withColumns({"flag": flag, "_segment": part})
    ordered = W.partitionBy(*keys, "_segment").orderBy(at)
    island = F.row_number().over(ordered) - F.row_number().over(W.partitionBy(*keys, "_segment", "flag").orderBy(at))
    local = flagged.withColumn("_island", F.col(at) - F.row_number().over(ordered) + island).groupBy(*keys, "_segment", "flag", "_island").agg(F.min(at).alias("lo"), (F.max(at) + 1).alias("hi"))
    outer = (F.col("lo") == F.col("_segment") * segment) | (F.col("hi") == (F.col("_segment") + 1) * segment)
    line = W.partitionBy(*keys).orderBy("lo")
    goes_on = F.lag(F.struct("flag", "hi")).over(line) == F.struct("flag", F.col("lo").alias("hi"))
    edges = local.where(outer).withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(line))
    merged = edges.groupBy(*keys, "flag", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    columns = [*keys, "flag", "lo", "hi"]
    return local.where(~outer).select(*columns).unionByName(merged.select(*columns))


def bands(shares: DataFrame, gutter: float = 0.98, min_gutter: int = 3, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Content bands (lo, hi) of a profile, split by gutters of at least min_gutter; shorter gaps belong to the content around them."""
    first = runs(shares, [*keys], "i", F.col("share") >= gutter)
    gap = F.col("flag") & (F.col("hi") - F.col("lo") >= min_gutter)
    # runs come alternately, so what lies between two real gutters is one band
    grouped = first.withColumn("gap", gap).withColumn("_band", F.sum(gap.cast("int")).over(W.partitionBy(*keys).orderBy("lo")))
    return grouped.where("not gap").groupBy(*keys, "_band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_band")


def sized_bands(profiles: DataFrame, lengths: DataFrame, options: dict) -> DataFrame:
    """Bands of profiles (image_id, axis, i, share) that are wide enough for their axis (image_id, axis, length), with their index, and how many there are."""
    keys = ["image_id", "axis"]
    found = bands(profiles, options["gutter"], options["min_gutter"], tuple(keys))
    kept = found.join(lengths, keys).where(F.col("hi") - F.col("lo") >= options["min_size"] * F.col("length"))
    one = W.partitionBy(*keys)
    return kept.withColumn("index", F.row_number().over(one.orderBy("lo")) - 1).withColumn("n", F.count("*").over(one)).drop("length")


def run_variation(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of each cell, from the profile of its rows (keys, i, content): number of content runs and their heights' coefficient of variation."""
    found = runs(cells, keys, "i", F.col("content")).where("flag").withColumn("height", F.col("hi") - F.col("lo"))
    return found.groupBy(*keys).agg(F.count("*").alias("n_runs"), (F.stddev_pop("height") / F.avg("height")).alias("cv"))


def _line_counts(pixels: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Content of each line of each cell, from a summed-area table: (image_id, y_index, x_index, the bands' ends, i, n_line, n_content).

    Contents are summed along each line once; a band's share of a line is the sum at its right end less the one before
    its left end. So pixels meet no cells: of a line only what stands at the ends of bands goes on.
    """
    along = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    table = pixels.withColumn("sum", F.sum(F.col("content").cast("int")).over(along))
    ends = cols.withColumn("end", F.explode(F.array(F.struct((F.col("x_hi") - 1).alias("x"), F.lit(1).alias("sign")), F.struct((F.col("x_lo") - 1).alias("x"), F.lit(-1).alias("sign")))))
    shares = table.join(ends.select("image_id", "x_index", "x_lo", "x_hi", "end.*"), ["image_id", "x"]).groupBy("image_id", "y", "x_index", "x_lo", "x_hi").agg(F.sum(F.col("sum") * F.col("sign")).alias("n_content"))
    inside = rows.withColumn("y", F.explode(F.sequence("y_lo", F.col("y_hi") - 1)))
    return shares.join(inside, ["image_id", "y"]).withColumnRenamed("y", "i").withColumn("n_line", F.col("x_hi") - F.col("x_lo"))


def panel_grid(pixels: DataFrame, **changes: float) -> DataFrame:
    """Panels of every image: label, row, col and box (x0, y0, x1, y1); the whole image where there is no grid.

    A cell of a row band and a column band counts if it has content and doesn't look like lines of text. With none
    or too many of them the image is one panel. Labels are dense in reading order; row and col number the bands. Images
    are complete: every x and y up to the largest has a pixel.

    Profiles, bands and lines of cells are each used in several places, so they are computed once and kept; in one plan
    all that they come from would be repeated at each of these places.
    """
    o = DEFAULTS | changes
    profiles = settled(profile(pixels, "y", o["background"]).withColumn("axis", F.lit("y")).unionByName(profile(pixels, "x", o["background"]).withColumn("axis", F.lit("x"))))
    lengths = profiles.groupBy("image_id", "axis").agg((F.max("i") + 1).alias("length"))
    banded = settled(sized_bands(profiles, lengths, o))
    rows, cols = (banded.where(F.col("axis") == a).select("image_id", *(F.col(c).alias(f"{a}_{c}") for c in ("lo", "hi", "index", "n"))) for a in ("y", "x"))
    grid_of = rows.select("image_id", "y_n").distinct().join(cols, "image_id").where("x_n > 1 or y_n > 1").drop("y_n", "x_n")
    lines = settled(_line_counts(pixels.select("image_id", "x", "y", (F.col("lum") < o["background"]).alias("content")), rows.drop("y_n"), grid_of))
    keys = ["image_id", "y_index", "x_index"]
    filled = lines.groupBy(*keys, "y_lo", "y_hi", "x_lo", "x_hi").agg((F.sum("n_content") / F.sum("n_line")).alias("share")).where(F.col("share") >= o["min_content"])
    texture = run_variation(lines.select(*keys, "i", ((F.col("n_line") - F.col("n_content")) / F.col("n_line") < o["gutter"]).alias("content")), keys)
    panels = filled.join(texture, keys, "left").where(f"not coalesce(n_runs >= {o['min_runs']} and cv <= {o['max_cv']}, false)")
    one = W.partitionBy("image_id")
    panels = panels.withColumn("n_panels", F.count("*").over(one)).where(F.col("n_panels") <= o["max_panels"])
    labelled = panels.withColumn("label", F.chr(96 + F.row_number().over(one.orderBy("y_index", "x_index"))))
    size = lengths.groupBy("image_id").agg(*(F.max(F.when(F.col("axis") == a, F.col("length"))).alias(c) for a, c in (("x", "w"), ("y", "h"))))
    # an image without a panel is one
    box = {"label": ("label", F.lit("a")), "row": ("y_index", F.lit(0)), "col": ("x_index", F.lit(0)), "x0": ("x_lo", F.lit(0)), "y0": ("y_lo", F.lit(0)), "x1": ("x_hi", F.col("w")), "y1": ("y_hi", F.col("h"))}
    return size.join(labelled, "image_id", "left").select("image_id", *(F.coalesce(c, whole).alias(name) for name, (c, whole) in box.items()))


def cropped(pixels: DataFrame, panels: DataFrame) -> DataFrame:
    """The pixels of each panel, placed from its corner."""
    joined = pixels.join(panels, "image_id").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return joined.select("image_id", "label", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "lum")


def outcomes(split: DataFrame) -> DataFrame:
    """A row for each image of panels with error rows (image_id, label, error): number of panels, null for an image that couldn't be split."""
    return split.groupBy("image_id").agg(F.when(F.count("error") == 0, F.count("label")).alias("n_panels"))


def rates(found: DataFrame) -> DataFrame:
    """One row over outcomes: images, failures, images of several panels and of one, and the share of the former in what was split."""
    failed, multi = F.count_if(F.col("n_panels").isNull()), F.count_if(F.col("n_panels") > 1)
    return found.agg(F.count("*").alias("n_images"), failed.alias("n_failed"), multi.alias("n_multi"), F.count_if(F.col("n_panels") <= 1).alias("n_single"), (multi / F.greatest(F.lit(1), F.count("*") - failed)).alias("multi_rate"))


def histogram(panels: DataFrame) -> DataFrame:
    """How many images have how many panels."""
    return panels.groupBy("image_id").agg(F.count("*").alias("n_panels")).groupBy("n_panels").agg(F.count("*").alias("n_images"))
