"""Pixels to data coordinates, and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hue ranges in degrees, half open; red wraps around.
HUES = (("red", 340, 20), ("orange", 20, 45), ("yellow", 45, 70), ("green", 70, 170), ("cyan", 170, 200), ("blue", 200, 260), ("purple", 260, 340))
#: Least saturation of a coloured pixel, and luminance from which a pixel is background.
SATURATION, BACKGROUND = 40, 245


def fraction(value: Column, low: Column, high: Column) -> Column:
    """Where value lies between low and high; 0 if these are equal."""
    return F.when(high == low, 0.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def on_scale(part: Column, low: Column, high: Column, scale: Column) -> Column:
    """The data value at a part of an axis, linear or logarithmic."""
    log = F.pow(F.lit(10.0), F.log10(low) + part * (F.log10(high) - F.log10(low)))
    return F.when(scale == "log", log).otherwise(low + part * (high - low))


def to_data(px: Column, py: Column, box: tuple, x_range: tuple, y_range: tuple, x_scale: Column, y_scale: Column) -> tuple[Column, Column]:
    """Data coordinates of a pixel; box is (x0, y0, x1, y1), and y grows downward in it."""
    x0, y0, x1, y1 = box
    return on_scale(fraction(px, x0, x1), *x_range, x_scale), on_scale(1 - fraction(py, y0, y1), *y_range, y_scale)


def calibration_error(x_range: tuple, y_range: tuple, x_scale: Column, y_scale: Column) -> Column:
    """What is wrong with a calibration: a logarithmic axis needs positive ends."""
    bad = lambda r, s: (s == "log") & ((r[0] <= 0) | (r[1] <= 0))
    return F.when(bad(x_range, x_scale) | bad(y_range, y_scale), "ValueError: log scale requires a positive range")


def saturation(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def coloured(r: Column, g: Column, b: Column) -> Column:
    return (saturation(r, g, b) > SATURATION) & ((r + g + b) / 3.0 < BACKGROUND)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees on the colour circle, by the first of r, g, b that is the greatest and how far the other two lie below it.

    The channels and their shades are bound as lambda variables, so that an expression around it doesn't grow with them.
    """
    level = F.array(*(c.cast("double") / 255.0 for c in (r, g, b)))
    spread = lambda v: F.array_max(v) - F.array_min(v)
    shades = lambda v: F.transform(v, lambda c: (F.array_max(v) - c) / F.when(spread(v) == 0, 1.0).otherwise(spread(v)))

    def degrees(v: Column, shade: Column) -> Column:
        top = (F.array_position(v, F.array_max(v)) - 1).cast("int")
        part = (2.0 * top + F.get(shade, F.pmod(top + 2, F.lit(3)))) - F.get(shade, F.pmod(top + 1, F.lit(3)))
        # around the circle before it is cut to a turn: a sixth of a negative part rounds to another side of 340
        return F.pmod(F.pmod(part, F.lit(6.0)) / 6.0, F.lit(1.0)) * 360.0

    return F.get(F.transform(F.array(level), lambda v: F.get(F.transform(F.array(shades(v)), lambda shade: degrees(v, shade)), F.lit(0))), F.lit(0))


def hue_name(degrees: Column) -> Column:
    """The name of the range that degrees lie in; they are computed once."""

    def inside(at: Column, low: int, high: int) -> Column:
        return (at >= low) & (at < high) if low < high else (at >= low) | (at < high)

    return F.get(F.transform(F.array(degrees), lambda at: F.coalesce(*(F.when(inside(at, low, high), label) for label, low, high in HUES))), F.lit(0))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Brightness in single precision, cut to a whole number."""
    return F.floor(F.lit(0.299).cast("float") * r.cast("float") + F.lit(0.587).cast("float") * g.cast("float") + F.lit(0.114).cast("float") * b.cast("float")).cast("int")
