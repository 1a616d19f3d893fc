"""Scores of figures and of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.operators.assignment import Solver, matched_curves, solve_first
from curvemill.operators.curves import compared


def figure_scores(points: DataFrame, figures: DataFrame, solver: Solver = solve_first) -> DataFrame:
    """A row for each of figures (figure_id), with or without curves: match rate, mean distance and coverage of the matched, and their summary."""
    curves = points.select("figure_id", "role", "curve_id").distinct()
    return scores_of(matched_curves(compared(points), curves, solver), figures)


def scores_of(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Scores from matched and unmatched curves."""
    by = rows.groupBy("figure_id").agg(
        F.count_if(F.expr("pred_curve_id is not null")).alias("n_pred"), F.count_if(F.expr("gt_curve_id is not null")).alias("n_gt"),
        F.count_if(F.expr("not is_miss and not is_false_positive")).alias("n_matched"), F.avg("distance").alias("distance_"), F.avg("coverage").alias("coverage_"),
    )
    all_ = figures.select("figure_id").join(by, "figure_id", "left").fillna(0, ["n_pred", "n_gt", "n_matched"])
    empty = (F.col("n_pred") == 0) & (F.col("n_gt") == 0)
    rate = F.when(empty, 1.0).otherwise(F.col("n_matched") / F.greatest("n_pred", "n_gt", F.lit(1)))
    distance = F.when(empty, 0.0).otherwise(F.coalesce("distance_", F.lit(1.0)))
    covered = F.when(empty, 1.0).otherwise(F.coalesce("coverage_", F.lit(0.0)))
    scored = all_.select("figure_id", "n_pred", "n_gt", rate.alias("match_rate"), distance.alias("mean_distance"), covered.alias("mean_coverage"))
    return scored.withColumn("summary_score", (F.col("match_rate") + (1 - F.col("mean_distance")) + F.col("mean_coverage")) / 3)


def with_errors(scores: DataFrame, errors: DataFrame) -> DataFrame:
    """Figures of errors (figure_id, error) score nothing, whatever else was found for them."""
    joined = scores.drop("error").join(errors, "figure_id", "left")
    failed = F.col("error").isNotNull()
    zero = {"match_rate": 0.0, "mean_distance": 1.0, "mean_coverage": 0.0, "summary_score": 0.0}
    return joined.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in zero.items()})


def dataset_score(scores: DataFrame) -> DataFrame:
    """Unweighted means over all figures; those that failed count."""
    return scores.agg(F.count("*").alias("n_figures"), F.avg("summary_score").alias("mean_summary_score"))
