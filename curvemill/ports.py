"""Where users plug in their own models, metrics and matchers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, UserDefinedTableFunction

from curvemill.functions.responses import parsed_series, prompt
from curvemill.operators.assignment import Solver, solve_first
from curvemill.operators.curves import in_log_space
from curvemill.operators.scoring import figure_scores, with_errors
from curvemill.staging import settled

#: A model gets a task (a row as a dict) and gives its curves as (label, x values, y values).
Model = Callable[[dict], list[tuple[str, list[float], list[float]]]]
POINTS = "figure_id string, curve_id string, ord long, x double, y double, error string"
_POINTS = StructType().add("figure_id", "string").add("curve_id", "string").add("ord", "long").add("x", "double").add("y", "double").add("error", "string")


def _curves(figure_id: str, found: list, first: int = 0) -> list[tuple]:
    """Points of a model's curves as rows; one without points or with unequal numbers of x and y is an error."""
    out = []
    for n, (label, xs, ys) in enumerate(found, first):
        if len(xs) == 0:
            raise ValueError("a curve needs at least one point")
        out += [(figure_id, f"{n}:{label}", i, float(a), float(b), None) for i, (a, b) in enumerate(zip(xs, ys, strict=True))]
    return out


def run_model(tasks: DataFrame, model: Model) -> DataFrame:
    """Points of the model's curves for each task (figure_id, ...); a task that fails has one row with the error. For tasks of a figure each; model_function also takes several."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for task in frame.to_dict("records"):
                try:
                    rows = _curves(task["figure_id"], model(task))
                except Exception as e:  # whatever a model raises concerns its figure alone
                    rows = [(task["figure_id"], None, None, None, None, f"{type(e).__name__}: {e}")]
                out += rows
            yield pd.DataFrame(out, columns=["figure_id", "curve_id", "ord", "x", "y", "error"]).astype({"ord": "Int64"})

    return tasks.mapInPandas(run, POINTS)


def model_function(model: Model) -> UserDefinedTableFunction:
    """The model as a table function of a table of tasks: any columns, figure_id among them.

    Its result is declared for the table that it gets, and asks for each figure's tasks together: their curves are
    numbered through, and an error in one of them voids the figure, which then has one row with the error.
    """

    class Points:
        @staticmethod
        def analyze(tasks: AnalyzeArgument) -> AnalyzeResult:
            if not tasks.isTable:
                raise ValueError("give the tasks as TABLE(...)")
            if "figure_id" not in tasks.dataType.names:
                raise ValueError(f"tasks need a column figure_id; they have {', '.join(tasks.dataType.names)}")
            return AnalyzeResult(_POINTS, partitionBy=[PartitioningColumn("figure_id")])

        def __init__(self):
            self.rows, self.curves, self.figure, self.error = [], 0, None, None

        def eval(self, task: Row):
            self.figure = None if task["figure_id"] is None else str(task["figure_id"])
            if self.error is None:
                try:
                    found = list(model(task.asDict(recursive=True)))
                    self.rows += _curves(self.figure, found, self.curves)
                    self.curves += len(found)
                except Exception as e:  # whatever a model raises concerns its figure alone
                    self.error = f"{type(e).__name__}: {e}"

        def terminate(self):
            yield from self.rows if self.error is None else [(self.figure, None, None, None, None, self.error)]

    return F.udtf(Points)


def register_model(spark: SparkSession, name: str, model: Model) -> None:
    """Makes the model a table function for SQL: SELECT * FROM name(TABLE(tasks)) gives its points."""
    spark.udtf.register(name, model_function(model))


def evaluated(found: DataFrame, truth: DataFrame, tasks: DataFrame, solver: Solver = solve_first) -> DataFrame:
    """Scores of a model's points and errors (as POINTS) against truth (figure_id, curve_id, ord, x, y), a row for each figure of tasks (figure_id, and x_scale if scales differ).

    A figure whose model failed, or whose points can't be put on its logarithmic axis, scores nothing and says why.
    """
    figures = tasks.select(F.col("figure_id").cast("string").alias("figure_id")).distinct()
    points = found.where("error is null").select("figure_id", "curve_id", F.lit("pred").alias("role"), "ord", "x", "y")
    points = points.unionByName(truth.select(F.col("figure_id").cast("string").alias("figure_id"), "curve_id", F.lit("gt").alias("role"), "ord", "x", "y").join(figures, "figure_id", "left_semi"))
    errors = found.where("error is not null").select("figure_id", "error")
    if "x_scale" in tasks.columns:
        scales = tasks.groupBy(F.col("figure_id").cast("string").alias("figure_id")).agg(F.max("x_scale").alias("x_scale"))
        points, bad = in_log_space(points, scales)
        errors = errors.unionByName(bad)
    return with_errors(figure_scores(points, figures, solver), errors.groupBy("figure_id").agg(F.min("error").alias("error")))


def evaluate(tasks: DataFrame, truth: DataFrame, model: Model, solver: Solver = solve_first) -> DataFrame:
    """From tasks to scores: runs the model once on every task, then scores what it gave (see evaluated)."""
    points = model_function(model)(tasks.asTable())
    return evaluated(settled(points), truth, tasks, solver)


#: A client of a language model gets the model's name, an image's bytes (None for none) and a prompt, and gives an answer.
Client = Callable[[str, bytes | None, str], str]


def llm_points(tasks: DataFrame, complete: Client, model_name: str) -> DataFrame:
    """Points from a language model: tasks (figure_id, image, x_lo, x_hi, x_scale, y_lo, y_hi) to prompts, the injected client's answers, and their usable series. A figure for which the client raises has one row with the error."""

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for figure, image, text in zip(frame["figure_id"], frame["image"], frame["prompt"], strict=True):
                try:
                    out.append((figure, complete(model_name, None if image is None else bytes(image), text), None))
                except Exception as e:  # whatever a client raises concerns its figure alone
                    out.append((figure, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["figure_id", "response", "error"])

    asked = tasks.select(F.col("figure_id").cast("string").alias("figure_id"), F.col("image").cast("binary").alias("image"), prompt(*(F.col(c) for c in ("x_lo", "x_hi", "x_scale", "y_lo", "y_hi"))).alias("prompt"))
    answered = asked.mapInPandas(answer, "figure_id string, response string, error string")
    # a failure is one point of no curve, so that answers are gone through once only
    points = F.flatten(F.transform(parsed_series(F.col("response")), lambda s, n: F.transform(F.arrays_zip(s["x"], s["y"]), lambda p, i: F.struct(F.concat_ws(":", n.cast("string"), s["label"]).alias("curve_id"), i.cast("long").alias("ord"), p["x"].alias("x"), p["y"].alias("y")))))
    none = F.array(F.lit(None).cast("struct<curve_id:string,ord:bigint,x:double,y:double>"))
    rows = answered.select("figure_id", "error", F.explode(F.when(F.col("error").isNotNull(), none).otherwise(points)).alias("p"))
    return rows.select("figure_id", "p.curve_id", "p.ord", "p.x", "p.y", "error")


def evaluate_llm(tasks: DataFrame, truth: DataFrame, complete: Client, model_name: str, solver: Solver = solve_first) -> DataFrame:
    """From tasks with images to scores: asks the client once for each figure, then scores its answers (see evaluated)."""
    return evaluated(settled(llm_points(tasks, complete, model_name)), truth, tasks, solver)


#: A splitter gets an image's bytes and gives its panels as (label, x0, y0, x1, y1).
Splitter = Callable[[bytes], list[tuple[str, int, int, int, int]]]


def split_panels(images: DataFrame, splitter: Splitter) -> DataFrame:
    """Panels of images (image_id, content) by a user's splitter; an image that it fails on has one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for image, content in zip(frame["image_id"], frame["content"], strict=True):
                try:
                    out += [(image, *panel, None) for panel in splitter(bytes(content))]
                except Exception as e:  # whatever a splitter raises concerns its image alone
                    out.append((image, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            names = ["image_id", "label", "x0", "y0", "x1", "y1", "error"]
            yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(names[2:6], "Int32"))

    return images.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInPandas(run, "image_id string, label string, x0 int, y0 int, x1 int, y1 int, error string")


def pair_metric(pairs: DataFrame, distance: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """pairs with a user's distance; one that says no more than this counts as full coverage and as its own chamfer distance."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(distance=distance(frame).astype(float))

    found = pairs.drop("distance").mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in pairs.drop("distance").dtypes) + ", distance double") if kinds else pairs
    return found.withColumns({"coverage": F.lit(1.0), "mean_error": F.col("distance"), "chamfer": F.col("distance")})
