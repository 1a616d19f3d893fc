"""From licensed papers and their curve rows to a manifest of papers, figures and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvemill.functions.licensing import NEEDS_REVIEW, REDISTRIBUTABLE, license_status
from curvemill.functions.references import series_label
from curvemill.functions.split import assign_split


def classified(dois: DataFrame, lookup: DataFrame) -> DataFrame:
    """dois (doi) with license_id, is_oa and license_status from lookup; one that isn't there needs review."""
    found = dois.join(lookup.withColumn("_found", F.lit(True)), "doi", "left")
    status = F.when(F.col("_found").isNull(), NEEDS_REVIEW).otherwise(license_status(F.col("license_id"), F.col("is_oa")))
    return found.withColumn("license_status", status).drop("_found")


def parsed_curve_rows(rows: DataFrame) -> DataFrame:
    """Curve rows with x and y as arrays from their JSON text, a label, and an error where they can't be used (not JSON, something in them that is no number, unequal lengths).

    A number in quotes is one too.
    """
    numbers = lambda c: F.transform(F.from_json(F.col(c), "array<string>"), lambda v: v.try_cast("double"))
    out = rows.withColumns({"x_values": numbers("x"), "y_values": numbers("y"), "series_label": series_label(F.col("prop_y"), F.col("unit_y"))})
    broken = lambda c: F.col(c).isNull() | F.exists(c, lambda v: v.isNull())
    error = F.when(broken("x_values") | broken("y_values"), "malformed array").when(F.size("x_values") != F.size("y_values"), "lengths differ")
    return out.withColumn("error", error)


def without_spoilt_papers(parsed: DataFrame) -> DataFrame:
    """One bad row takes the curves of its whole paper; rows without sid are one paper. Only ids meet, not the curves."""
    bad = parsed.where("error is not null").select(F.col("sid").alias("_bad")).distinct()
    return parsed.join(bad, F.col("sid").eqNullSafe(F.col("_bad")), "left_anti").drop("error")


def must_be_usable(parsed: DataFrame) -> DataFrame:
    """Fails on a row with an error, and says which paper it is of."""
    told = F.concat(F.lit("malformed curve row of paper "), F.coalesce(F.col("sid").cast("string"), F.lit("(none)")), F.lit(": "), "error")
    return parsed.where(F.assert_true(F.col("error").isNull(), told).isNull()).drop("error")


def figures(curve_rows: DataFrame, held_out_ratio: float = 0.2) -> DataFrame:
    """A row for each figure of a paper: the name that came first, and the paper's split."""
    named = curve_rows.groupBy("paper_id", "figure_id").agg(F.min_by("figure_name", "ord").alias("figure_reference"), F.min("ord").alias("first_ord"), F.count("*").alias("n_curves"))
    return named.withColumn("split", assign_split(F.col("paper_id"), held_out_ratio))


def curves(curve_rows: DataFrame) -> DataFrame:
    """A row for each curve; its number counts through the paper, from 0, in order of the figures' first rows and then of arrival.

    Rows of equal ord are told apart by their other columns, so that the numbers don't depend on how they arrive.
    """
    first = F.min("ord").over(W.partitionBy("paper_id", "figure_id"))
    rest = [c for c in curve_rows.columns if c not in ("paper_id", "figure_id", "ord")]
    order = W.partitionBy("paper_id").orderBy("first_", "figure_id", "ord", *rest)
    numbered = curve_rows.withColumn("first_", first).withColumn("number", F.row_number().over(order) - 1).drop("first_")
    return numbered.withColumn("curve_id", F.concat_ws("-", "paper_id", "figure_id", "number"))


def gated(papers: DataFrame) -> DataFrame:
    """Only redistributable papers enter; a row that slips through fails the job."""
    return papers.where(F.col("license_status") == REDISTRIBUTABLE)


def downloadable(papers: DataFrame) -> DataFrame:
    """Redistributable papers that name a PDF."""
    return gated(papers).where("coalesce(pdf_url, '') <> ''")


def without_pdf_url(papers: DataFrame) -> DataFrame:
    """Papers whose pdf_url is null, empty or white space, which no one asks for."""
    return papers.where(r"regexp_replace(coalesce(pdf_url, ''), '\\s', '') = ''")


def total_size(rows: DataFrame, column: str) -> DataFrame:
    """How many elements the lists of a column have together."""
    return rows.agg(F.coalesce(F.sum(F.size(F.coalesce(column, F.array()))), F.lit(0)).alias("total"))


def must_be_redistributable(papers: DataFrame) -> DataFrame:
    """Fails on any other paper."""
    return papers.where(F.assert_true(F.col("license_status") == REDISTRIBUTABLE, F.lit("a paper's license isn't redistributable")).isNull())


def build(papers: DataFrame, rows: DataFrame, held_out_ratio: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Figures and curves of the redistributable papers; a paper without rows has none."""
    mine = gated(papers).select("paper_id").join(rows, "paper_id")
    return figures(mine, held_out_ratio), curves(mine)


def paper_counts(papers: DataFrame, figs: DataFrame, crvs: DataFrame) -> DataFrame:
    """Every paper with its numbers of figures and curves, 0 where it has none."""
    n_f = figs.groupBy("paper_id").agg(F.count("*").alias("n_figures"))
    n_c = crvs.groupBy("paper_id").agg(F.count("*").alias("n_curves"))
    return papers.join(n_f, "paper_id", "left").join(n_c, "paper_id", "left").fillna(0, ["n_figures", "n_curves"])


def nested(papers: DataFrame, figs: DataFrame, crvs: DataFrame) -> DataFrame:
    """Papers with an array of figures, each with an array of its curves, in order. A paper's figures are one row by design."""
    inner = crvs.groupBy("paper_id", "figure_id").agg(F.array_sort(F.collect_list(F.struct("number", "curve_id", "n_points"))).alias("curves"))
    outer = figs.join(inner, ["paper_id", "figure_id"], "left").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first_ord", "figure_id", "figure_reference", "curves"))).alias("figures"))
    return papers.join(outer, "paper_id", "left")


def summary(papers: DataFrame) -> DataFrame:
    """One row: papers, those with a PDF, share of PDFs that came, papers with images, images."""
    ok = F.count_if(F.col("pdf_status") == "ok")
    return papers.agg(
        F.count_distinct("paper_id").alias("n_papers"), F.count("pdf_status").alias("n_attempted"), ok.alias("n_ok"),
        (ok / F.greatest(F.lit(1), F.count("pdf_status"))).alias("ok_rate"),
        F.count_if(F.coalesce(F.col("n_images"), F.lit(0)) > 0).alias("n_with_images"), F.sum(F.coalesce(F.col("n_images"), F.lit(0))).alias("n_images"),
        F.avg(F.when(F.col("pdf_status") == "ok", F.col("n_images"))).alias("mean_images_per_ok"),
    )


def status_counts(papers: DataFrame) -> DataFrame:
    """How many papers have each pdf_status, those of earlier runs among them; papers that were never asked for have none."""
    return papers.where("pdf_status is not null").groupBy("pdf_status").agg(F.count("*").alias("n"))


def verified(pairings: DataFrame) -> DataFrame:
    """Pairings that may be scored: verified and not excluded."""
    return pairings.where("status = 'verified' and excluded_reason is null")


def verified_exists(wanted: DataFrame, pairings: DataFrame) -> DataFrame:
    """Those of wanted (paper_id, figure_id) that have a verified pairing, excluded or not."""
    return wanted.join(pairings.where("status = 'verified'").select("paper_id", "figure_id"), ["paper_id", "figure_id"], "left_semi")
