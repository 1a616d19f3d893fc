"""Readers of curve tables, registries, results, manifests and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.functions.references import work_license
from curvemill.sources import schemas
from curvemill.sources.order import with_read_order


def csv_table(spark: SparkSession, path: str, schema: str, one_line: bool = False) -> DataFrame:
    """A headed CSV, gzip or plain; columns are found by the header's names.

    Values may hold line breaks in quotes, for which a file has to be read in one go. Where none does (one_line), plain
    files are split among tasks; compressed ones never are.
    """
    return spark.read.options(header=True, multiLine=not one_line, escape='"', enforceSchema=False).schema(schema).csv(path)


def curve_rows(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """Curve rows with ord, their number in the order of the files."""
    return with_read_order(csv_table(spark, path, schemas.CURVE_ROWS, one_line))


def paper_rows(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """Papers' rows with ord, their number in the order of the files."""
    return with_read_order(csv_table(spark, path, schemas.PAPERS, one_line))


def papers_by_doi(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Papers with their lower-case doi; of several with the same one the last stays."""
    from curvemill.operators.tables import last_wins

    return last_wins(rows.withColumn("doi", F.lower("DOI")), ["doi"], [order])


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that hold an object or an array of objects, over several lines."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Verified pairings; a missing scale is linear."""
    return with_default_scales(json_rows(spark, path, schemas.REGISTRY))


def with_default_scales(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit("linear")) for c in ("x_scale", "y_scale")})


def results(spark: SparkSession, folder: str) -> DataFrame:
    return json_rows(spark, f"{folder}/*.json", schemas.RESULT)


def works(responses: DataFrame, column: str = "body") -> DataFrame:
    """Licenses from works-API responses: doi, is_oa, license_id, pdf_url; a work without doi is skipped."""
    work = responses.select(F.explode(F.from_json(column, schemas.WORKS)["results"]).alias("w")).select("w.*").where("doi is not null and doi <> ''")
    return work.select(
        F.regexp_replace("doi", r"^https://doi\.org/", "").alias("doi"), F.col("open_access.is_oa").alias("is_oa"),
        work_license(F.col("primary_location.license"), F.col("locations")).alias("license_id"),
        F.coalesce(F.nullif(F.col("best_oa_location.pdf_url"), F.lit("")), F.col("primary_location.pdf_url")).alias("pdf_url"),
    )


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def file_names(files: DataFrame) -> DataFrame:
    """Sorted names of the files in each folder."""
    part = F.split("path", "/")
    return files.select(F.get(part, F.size(part) - 2).alias("folder"), F.element_at(part, -1).alias("name")).groupBy("folder").agg(F.sort_array(F.collect_list("name")).alias("names"))


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels (image_id, x, y, r, g, b) of the images in a folder, read by Spark's own decoder (blue first, row by row; one channel is grey)."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    at = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("int")
    colour = lambda k: F.when(F.col("nChannels") >= 3, byte(k)).otherwise(byte(0))
    return at.select(F.element_at(F.split("origin", "/"), -1).alias("image_id"), (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), colour(2).alias("r"), colour(1).alias("g"), colour(0).alias("b"))


def synthetic_charts(spark: SparkSession, size: int = 200) -> tuple[DataFrame, DataFrame]:
    """Three charts with known curves: pixels (image_id, x, y, r, g, b) and points (figure_id, curve_id, role, ord, x, y)."""
    rows = spark.range(size * size).select((F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))
    near = lambda line: F.abs(F.col("y") - line) <= 1
    fall, rise = F.col("x"), size - 1 - F.col("x")
    chart = lambda name, colour: rows.select(F.lit(name).alias("image_id"), "x", "y", colour.alias("c")).select("image_id", "x", "y", *(F.get("c", i).alias(n) for i, n in enumerate("rgb")))
    rgb = lambda *v: F.array(*map(F.lit, v))
    red, blue, black, white = rgb(255, 0, 0), rgb(0, 0, 255), rgb(0, 0, 0), rgb(255, 255, 255)
    pixels = chart("single", F.when(near(fall), red).otherwise(white)).union(chart("two", F.when(near(fall), red).when(near(rise), blue).otherwise(white))).union(chart("log", F.when(near(fall), black).otherwise(white)))
    known = spark.range(11).select(F.col("id").alias("ord"), F.col("id").cast("double").alias("x"))
    curve = lambda f, c, y: known.select(F.lit(f).alias("figure_id"), F.lit(c).alias("curve_id"), F.lit("gt").alias("role"), "ord", "x", y.alias("y"))
    points = curve("single", "red", 10 - F.col("x")).union(curve("two", "red", 10 - F.col("x"))).union(curve("two", "blue", F.col("x"))).union(curve("log", "black", 10 - F.col("x")).withColumn("x", F.pow(F.lit(10.0), F.col("x") / 5)))
    return pixels, points
