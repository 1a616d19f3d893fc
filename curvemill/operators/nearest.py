"""Nearest points of one curve to another's, by blocks of points and bounds on their distances.

Equal points of a curve are one with a weight. A curve is cut into columns of equal width in x. A column is cut once more
in x where that makes its parts less tall, as along a line, else (scattered points) into levels of equal height of its own
extent in y. A cell with many more than BLOCK points is cut both ways in its own extent, twice if need be; so a block of
about BLOCK points is small both ways, also where points lie dense. Blocks side by side are groups, about as many as a
group has blocks. For a block of the one curve every group of the other has a least
and a greatest possible distance, from their boxes; a group whose least is above another's greatest can't hold a nearest
point of any of the block's points. The same decides among the blocks of the groups that are left, and only then points
meet. A curve of any length is rows of bounded size, so that it takes as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from curvemill.staging import settled

#: Points of a block; one where many lie together may have twice as many, what is more is dealt into several.
BLOCK = 64
CURVE = ("figure_id", "role", "curve_id")
_BOX = ("x0", "x1", "y0", "y1")


def _boxes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def _place(value: str, low: Column, span: Column, n: Column) -> Column:
    """Number of the part, of n equal ones of an extent, that a value lies in."""
    return F.when((span > 0) & (span < float("inf")), F.least(n - 1, F.floor((F.col(value) - low) / F.nullif(span, F.lit(0.0)) * n))).otherwise(0).cast("long")


def _parted(placed: DataFrame, size: int, part: Column) -> DataFrame:
    """Placed points, those of parts of more than 2 * size points with a part within: a column from n_ and the ends x0_ to y1_."""
    keys = [*CURVE, "cell", "part"]
    full = placed.groupBy(*keys).agg(F.count("*").alias("n_"), *(f(c).alias(f"{c}{i}_") for c in "xy" for i, f in enumerate((F.min, F.max)))).where(F.col("n_") > 2 * size)
    return placed.join(full, keys, "left").withColumn("part", F.col("part") * 2**20 + F.coalesce(part + 1, F.lit(0)).cast("long")).select(*placed.columns)


def blocks(points: DataFrame, curves: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of the points of curves (figure_id, role, curve_id, x_min, x_max): cell, part and group numbers, box and sorted points, n of each."""
    dots = settled(points.join(curves.select(*CURVE), list(CURVE), "left_semi").groupBy(*CURVE, "x", "y").agg(F.count("*").alias("n")))
    wide = dots.groupBy(*CURVE).agg(F.ceil(F.sqrt(F.ceil(F.count("*") / size))).alias("wide"))  # columns, and parts of each
    mine = curves.select(*CURVE, "x_min", (F.col("x_max") - F.col("x_min")).alias("x_span")).join(wide, list(CURVE))
    thin = _place("x", F.col("x_min"), F.col("x_span"), F.col("wide") * F.col("wide"))
    columns = dots.join(mine, list(CURVE)).select(*CURVE, "x", "y", "n", "wide", thin.alias("thin"), F.floor(thin / F.col("wide")).alias("column"))
    parts = columns.groupBy(*CURVE, "column", "thin").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    tall = (F.avg(F.col("high") - F.col("low")) > (F.max("high") - F.min("low")) / 2).alias("tall")
    extents = parts.groupBy(*CURVE, "column").agg(F.min("low").alias("y_min"), (F.max("high") - F.min("low")).alias("y_span"), tall)
    level = _place("y", F.col("y_min"), F.col("y_span"), F.col("wide"))
    # cells of columns cut in x have negative numbers
    cell = F.when(F.col("tall"), F.col("column") * F.col("wide") + level).otherwise(-1 - F.col("thin")).alias("cell")
    placed = columns.join(extents, [*CURVE, "column"]).select(*CURVE, "x", "y", "n", cell, F.lit(0).cast("long").alias("part"))

    side = F.ceil(F.sqrt(F.col("n_") / size))
    within = lambda c: _place(c, F.col(f"{c}0_"), F.col(f"{c}1_") - F.col(f"{c}0_"), side)
    for _ in range(2):
        placed = _parted(settled(placed), size, within("x") * side + within("y"))
    # what still lies together is dealt by chance, by part and not by curve, so that a long curve is many tasks'
    dealt = _parted(settled(placed), size, F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n_") / size)))
    made = settled(dealt.groupBy(*CURVE, "cell", "part").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.array_sort(F.collect_list(F.struct("x", "y", "n"))).alias("points")
    ))

    # groups: slabs of blocks side by side in x, cut into as many pieces in y; a curve's boxes are sorted, not its points
    curve = W.partitionBy(*CURVE)
    boxes = made.select(*CURVE, "cell", "part", "x0", "y0").withColumn("all", F.count("*").over(curve)).withColumn("near", F.ceil(F.sqrt(F.ceil(F.sqrt("all")))))
    slab = F.floor((F.row_number().over(curve.orderBy("x0", "cell", "part")) - 1) * F.col("near") / F.col("all"))
    slabs = boxes.withColumn("slab", slab).withColumn("mine", F.count("*").over(W.partitionBy(*CURVE, "slab")))
    piece = F.floor((F.row_number().over(W.partitionBy(*CURVE, "slab").orderBy("y0", "cell", "part")) - 1) * F.col("near") / F.col("mine"))
    grouped = slabs.select(*CURVE, "cell", "part", (F.col("slab") * F.col("near") + piece).cast("long").alias("group"))
    return made.join(grouped, [*CURVE, "cell", "part"])


def _apart(a: str, b: Column) -> Column:
    """Square of the least distance of two boxes, in the pair's units."""
    gap = lambda c: F.greatest(F.lit(0.0), b[f"{c}0"] - F.col(f"{a}.{c}1"), F.col(f"{a}.{c}0") - b[f"{c}1"]) / F.col(f"{c}_range")
    return gap("x") * gap("x") + gap("y") * gap("y")


def _across(a: str, b: Column) -> Column:
    """Square of the greatest distance of points in two boxes."""
    far = lambda c: F.greatest(b[f"{c}1"] - F.col(f"{a}.{c}0"), F.col(f"{a}.{c}1") - b[f"{c}0"]) / F.col(f"{c}_range")
    return far("x") * far("x") + far("y") * far("y")


KEYS = ("figure_id", "pred_curve_id", "gt_curve_id")


def meetings(cut: DataFrame, pairs: DataFrame, of: str, to: str) -> DataFrame:
    """Blocks of each pair's one curve (of: "pred" or "gt") with those of the other (to) that can hold a nearest point: the pair, its units, from, own and others (points)."""
    keys = [*KEYS]
    mine = cut.where(F.col("role") == of).select("figure_id", F.col("curve_id").alias(f"{of}_curve_id"), F.struct("cell", "part").alias("from"), F.struct(*_BOX).alias("a"), F.col("points").alias("own"))
    other = cut.where(F.col("role") == to).withColumnRenamed("curve_id", f"{to}_curve_id")
    place = ["figure_id", f"{to}_curve_id"]
    tops = _boxes(other, *place, "group").groupBy(*place).agg(F.collect_list(F.struct("group", *_BOX)).alias("tops"))
    kids = other.groupBy(*place, "group").agg(F.collect_list(F.struct("cell", "part", *_BOX)).alias("kids"))
    rows = pairs.select(*keys, "x_range", "y_range").join(mine.drop("own"), ["figure_id", f"{of}_curve_id"]).join(tops, place)
    # rounding must not drop the block that gives the bound
    slack = lambda bound: bound * (1 + 1e-9)
    rows = rows.withColumn("most", F.array_min(F.transform("tops", lambda b: _across("a", b))))
    rows = rows.withColumn("group", F.explode(F.transform(F.filter("tops", lambda b: _apart("a", b) <= slack(F.col("most"))), lambda b: b["group"]))).drop("tops")
    # the best bound of any block in any of the groups left
    one = W.partitionBy(*keys, "from")
    rows = rows.join(kids, [*place, "group"]).withColumn("most", F.min(F.least("most", F.array_min(F.transform("kids", lambda b: _across("a", b))))).over(one))
    rows = rows.withColumn("b", F.explode(F.filter("kids", lambda b: _apart("a", b) <= slack(F.col("most"))))).select(*keys, "x_range", "y_range", "from", "b.cell", "b.part")
    with_own = rows.join(mine.drop("a"), ["figure_id", f"{of}_curve_id", "from"])
    return with_own.join(other.select(*place, "cell", "part", F.col("points").alias("others")), [*place, "cell", "part"])


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of meeting blocks (KEYS, from, x_range, y_range, own, others) the square of each own point's least distance (d), and its weight (n)."""
    for batch in batches:
        (own, others), units = (batch[c].flatten() for c in ("own", "others")), [batch[f"{c}_range"].to_numpy(zero_copy_only=False) for c in "xy"]
        (mine, theirs) = ([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"] for flat in (own, others))
        ends, ends_of = (batch[c].offsets.to_numpy() - batch[c].offsets[0].as_py() for c in ("own", "others"))
        least, missing = np.empty(len(own)), np.zeros(len(own), bool)
        # without a value there is no distance; one that isn't a number is the greatest
        null, null_of = (np.asarray(flat.field("x").is_null()) | np.asarray(flat.field("y").is_null()) for flat in (own, others))
        for i in range(len(batch)):
            at, to = slice(ends[i], ends[i + 1]), slice(ends_of[i], ends_of[i + 1])
            dx, dy = ((m[at, None] - t[None, to]) / unit[i] for m, t, unit in zip(mine, theirs, units, strict=True))
            least[at] = np.fmin.reduce(dx * dx + dy * dy, axis=1)
            missing[at] = null[at] | null_of[to].all()
        lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for values in (pa.array(least, mask=missing), own.field("n")))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*KEYS, "from")), *lists], [*KEYS, "from", "d", "n"])


def nearest_means(cut: DataFrame, pairs: DataFrame, of: str, to: str) -> DataFrame:
    """Mean distance of the points of each pair's one curve (of: "pred" or "gt") to the nearest of the other's (to).

    cut: blocks of both; pairs: (figure_id, pred_curve_id, gt_curve_id, x_range, y_range), whose ranges are the units.
    """
    met = meetings(cut, pairs, of, to).select(*KEYS, "from", *(F.col(f"{c}_range").cast("double") for c in "xy"), "own", "others")
    schema = met.select(*KEYS, "from").schema.add("d", ArrayType(DoubleType())).add("n", ArrayType(LongType()))
    least = met.mapInArrow(_least, schema).select(*KEYS, "from", F.posexplode(F.arrays_zip("d", "n")).alias("at", "p")).select(*KEYS, "from", "at", "p.*")
    points = least.groupBy(*KEYS, "from", "at").agg(F.min("d").alias("d"), F.first("n").alias("n"))
    return points.groupBy(*KEYS).agg((F.sum(F.sqrt("d") * F.col("n")) / F.sum(F.when(F.col("d").isNotNull(), F.col("n")))).alias("mean"))
