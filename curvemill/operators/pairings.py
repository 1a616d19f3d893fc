"""Verified pairings of figures with images: their curves, panels and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ground_truth(pairings: DataFrame, parsed: DataFrame) -> DataFrame:
    """Curves of each pairing by figure_id alone, in one scan for all; unusable and empty ones are dropped."""
    usable = parsed.where("error is null and size(x_values) > 0")
    return pairings.join(usable.drop("paper_id"), "figure_id")


def with_license(pairings: DataFrame, papers: DataFrame) -> DataFrame:
    """Pairings whose paper is known, with its license; a missing or empty one counts as cc-by."""
    return pairings.join(papers.select("paper_id", F.coalesce(F.nullif(F.col("license_id"), F.lit("")), F.lit("cc-by")).alias("license_id")), "paper_id")


def with_panel(pairings: DataFrame, panels: DataFrame) -> DataFrame:
    """Pairings that name a panel with its box; one that names a panel that isn't there gets an error."""
    found = pairings.join(panels.withColumn("_found", F.lit(True)), (pairings.image_id == panels.image_id) & (pairings.panel_label == panels.label), "left").drop(panels.image_id)
    missing = F.col("panel_label").isNotNull() & F.col("_found").isNull()
    return found.withColumn("error", F.when(missing, F.concat(F.lit("KeyError: no panel "), "panel_label"))).drop("_found", "label")


def bare_names(pairings: DataFrame) -> DataFrame:
    """Pairings whose image is a bare file name, which has to be fetched."""
    return pairings.where("image_path is not null and not contains(image_path, '/')")


def with_images(pairings: DataFrame, images: DataFrame) -> DataFrame:
    """Bare-named pairings with the extracted image of that name; those without one are skipped."""
    return bare_names(pairings).join(images, [pairings.paper_id == images.paper_id, pairings.image_path == images.name]).drop(images.paper_id)


def papers_with_images(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers that count extracted images and have files (folder, names)."""
    return papers.where("coalesce(n_images, 0) > 0").join(files.withColumnRenamed("folder", "paper_id"), "paper_id")


def page_images(images: DataFrame, least_pixels: int = 22500) -> DataFrame:
    """Of (doc, page, source, width, height) the large embedded images, and a page's render where it has none."""
    large = images.where((F.col("source") == "embedded") & (F.col("width") * F.col("height") >= least_pixels))
    return large.unionByName(images.where("source = 'page_render'").join(large.select("doc", "page"), ["doc", "page"], "left_anti"))


def with_ordinals(images: DataFrame) -> DataFrame:
    """Images (doc, page, number) with their ordinal in the document, from 0."""
    return images.withColumn("ordinal", F.row_number().over(W.partitionBy("doc").orderBy("page", "number")) - 1)


def dataset_version(n_real: Column) -> Column:
    """The name of a data set by how many real figures it has."""
    return F.concat(F.lit("v0-eval-pilot-n"), n_real.cast("string"))
