"""Curves from an image's coloured pixels: a series for each hue, the median of its pixels in every column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvemill.functions.geometry import coloured, hue, hue_name, to_data

#: Least pixels of a series, and least columns of a curve.
MIN_PIXELS, MIN_COLUMNS = 15, 2


def coloured_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b) that are coloured, with the name of their hue."""
    rgb = [F.col(c) for c in "rgb"]
    return pixels.where(coloured(*rgb)).withColumn("series_label", hue_name(hue(*rgb)))


def column_medians(found: DataFrame) -> DataFrame:
    """A row for each column of a series: exact median of y, with the series' numbers of pixels and columns and the box of all the image's pixels.

    The pixels are read once; what windows sort afterwards are columns.
    """
    columns = found.groupBy("image_id", "series_label", "x").agg(F.median("y").alias("median_y"), F.count("*").alias("n"), F.min("y").alias("least_y"), F.max("y").alias("most_y"))
    image, series = W.partitionBy("image_id"), W.partitionBy("image_id", "series_label")
    box = {"x0": F.min("x").over(image), "y0": F.min("least_y").over(image), "x1": F.max("x").over(image) + 1, "y1": F.max("most_y").over(image) + 1}
    boxed = columns.withColumns({name: value.cast("double") for name, value in box.items()})
    return boxed.withColumns({"n_pixels": F.sum("n").over(series), "n_columns": F.count("*").over(series)}).drop("n", "least_y", "most_y")


def traced(pixels: DataFrame, axes: DataFrame) -> DataFrame:
    """Points (image_id, series_label, px, x, y) in data coordinates; axes has image_id, x_lo, x_hi, y_lo, y_hi, x_scale, y_scale.

    The box of all coloured pixels is taken for the plot area. A series in a single column isn't a curve.
    """
    curves = column_medians(coloured_pixels(pixels)).where((F.col("n_pixels") >= MIN_PIXELS) & (F.col("n_columns") >= MIN_COLUMNS))
    rows = curves.join(axes, "image_id")
    c = F.col
    x, y = to_data(c("x").cast("double"), c("median_y"), (c("x0"), c("y0"), c("x1"), c("y1")), (c("x_lo"), c("x_hi")), (c("y_lo"), c("y_hi")), c("x_scale"), c("y_scale"))
    return rows.select("image_id", "series_label", c("x").alias("px"), x.alias("x"), y.alias("y"))
