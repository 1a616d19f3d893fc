"""Ranking of models by their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from curvemill.operators.tables import chunks

PENDING = "pending_external_run"


def ranked(results: DataFrame) -> DataFrame:
    """results (model_id, model_name, status, mean_summary_score, n_figures, dataset_version, run_at, note) with rank: scored before pending, best first, ties by model_id.

    Pending rows have no score, figures, version or time. Ranks come from ranges of the order, not from one task.
    """
    pending = F.col("status") == PENDING
    blank = {c: F.when(~pending, F.col(c)) for c in ("mean_summary_score", "n_figures", "dataset_version", "run_at")}
    score = F.col("mean_summary_score")
    order = F.struct(pending.alias("pending"), score.isNull().alias("none"), (-score).alias("worse"), "model_id")
    placed = chunks(results.withColumns(blank).withColumn("_order", order), "_order", 1, "rank").drop("_order")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int"))


def latest(board: DataFrame) -> DataFrame:
    """Version and time of the latest scored run, by text order; of equal times the better rank."""
    scored = board.where("status = 'scored'")
    best = F.max_by(F.struct("dataset_version", "run_at"), F.struct("run_at", -F.col("rank")))
    return scored.agg(best.alias("b")).select("b.dataset_version", "b.run_at")


def html(board: DataFrame) -> str:
    """A page with the board; it has a row for each model, so it is made on the driver."""
    from html import escape

    def line(r: Row) -> str:
        if r.status == PENDING:
            told = ["", "", "", f"waits for an external run. {r.note or ''}"]
        else:
            told = [f"{r.mean_summary_score:.3f}", str(r.n_figures), r.dataset_version or "", r.run_at or ""]
        return "".join(f"<td>{escape(x)}</td>" for x in (str(r["rank"]), r.model_name, *told))

    top = latest(board).first()
    caption = f"Data set {top.dataset_version}, {top.run_at}" if top and top.run_at else "Nothing has been scored"
    head = "".join(f"<th>{x}</th>" for x in ("Rank", "Model", "Score", "Figures", "Data set", "Run"))
    body = "".join(f"<tr>{line(r)}</tr>" for r in board.orderBy("rank").collect())
    return f"<!doctype html><meta charset=utf-8><title>Leaderboard</title><table><caption>{escape(caption)}</caption><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
