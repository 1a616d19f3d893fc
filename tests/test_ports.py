"""Models from tasks to scores: table function, language model client, errors of single figures."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from curvemill import ports
from curvemill.functions.responses import parsed_series

TRUTH = "figure_id string, curve_id string, ord long, x double, y double"


def truth(spark, figures):
    return spark.createDataFrame([(f, "g", i, float(i), float(i * i)) for f in figures for i in range(4)], TRUTH)


def perfect(task):
    return [("s", [0, 1, 2, 3], [0, 1, 4, 9])]


def test_one_call_from_tasks_to_scores(spark):
    def model(task):
        return {"good": perfect, "raises": lambda t: 1 / 0, "empty": lambda t: [("s", [], [])], "uneven": lambda t: [("s", [1, 2], [1])], "none": lambda t: [], "late": lambda t: (x for x in [perfect(t)[0], 1])}[task["kind"]](task)

    kinds = ["good", "raises", "empty", "uneven", "none", "late"]
    tasks = spark.createDataFrame([(k, k, bytearray(b"png")) for k in kinds], "figure_id string, kind string, image binary")
    rows = {r.figure_id: (round(r.summary_score, 9), r.error) for r in ports.evaluate(tasks, truth(spark, [*kinds, "of no task"]), model).collect()}
    assert rows.keys() == set(kinds)
    assert rows["good"] == (1.0, None) and rows["none"] == (0.0, None)
    assert rows["raises"] == (0.0, "ZeroDivisionError: division by zero")
    assert rows["empty"] == (0.0, "ValueError: a curve needs at least one point")
    assert rows["uneven"][0] == rows["late"][0] == 0 and rows["uneven"][1].startswith("ValueError: zip()") and rows["late"][1].startswith("TypeError")


def test_a_figures_tasks_are_one_partition(spark):
    tasks = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1), ("g", 0), (None, 1)], "figure_id string, n int").repartition(4)
    rows = ports.model_function(lambda t: [("s", [t["n"]], [6 / t["n"]])])(tasks.asTable()).collect()
    assert {r.curve_id for r in rows if r.figure_id == "f"} == {"0:s", "1:s"} and sorted(r.y for r in rows if r.figure_id == "f") == [3.0, 6.0]
    assert [(r.curve_id, r.error) for r in rows if r.figure_id == "g"] == [(None, "ZeroDivisionError: division by zero")]
    assert [r.y for r in rows if r.figure_id is None] == [6.0]


def test_the_table_is_looked_at(spark):
    spark.range(2).createOrReplaceTempView("no_figures")
    ports.register_model(spark, "some_model", perfect)
    with pytest.raises(AnalysisException, match="figure_id"):
        spark.sql("SELECT * FROM some_model(TABLE(no_figures))")
    with pytest.raises(AnalysisException, match="TABLE"):
        spark.sql("SELECT * FROM some_model('f')")


def test_logarithmic_figures(spark):
    tasks = spark.createDataFrame([("good", "log", 1.0), ("bad", "log", 0.0), ("linear", "linear", 0.0)], "figure_id string, x_scale string, least double")
    known = spark.createDataFrame([(f, "g", i, x, float(i)) for f in ("good", "bad", "linear") for i, x in enumerate((1.0, 10.0, 100.0))], TRUTH)
    rows = {r.figure_id: (round(r.summary_score, 6), r.error) for r in ports.evaluate(tasks, known, lambda t: [("s", [t["least"], 100.0], [0.0, 2.0])]).collect()}
    assert rows["good"] == (1.0, None) and rows["bad"] == (0.0, "ValueError: log scale requires positive x") and rows["linear"][1] is None


def test_a_model_is_asked_once(spark, tmp_path):
    def model(task):
        with open(f"{tmp_path}/{task['figure_id']}", "a") as f:
            f.write("x")
        return perfect(task)

    tasks = spark.createDataFrame([(str(i),) for i in range(6)], "figure_id string").repartition(3)
    scores = ports.evaluate(tasks, truth(spark, map(str, range(6))), model)
    assert scores.count() == 6 and scores.where("summary_score = 1").count() == 6
    assert [p.read_text() for p in tmp_path.iterdir()] == ["x"] * 6


def test_language_model(spark):
    answers = {
        b"good": "```json\n" + json.dumps({"series": [7, {"label": "a", "x": [0, "1", 2, 3], "y": [0, 1, 4, 9]}, {"x": [1]}, {"label": "z", "x": [1, 2], "y": [1]}]}) + "\n```",
        b"prose": "I can't read this", b"object": '{"series": {"x": [1]}}',
    }

    def complete(model, image, prompt):
        assert model == "some-model" and "from 0.0 to 3.0 (linear scale)" in prompt
        if image is None:
            raise ConnectionError("no image")
        return answers[image]

    images = [("good", bytearray(b"good")), ("prose", bytearray(b"prose")), ("object", bytearray(b"object")), ("down", None), ("unknown", bytearray(b"?"))]
    tasks = spark.createDataFrame([(f, i, 0.0, 3.0, "linear", 0.0, 9.0) for f, i in images], "figure_id string, image binary, x_lo double, x_hi double, x_scale string, y_lo double, y_hi double")
    rows = {r.figure_id: (round(r.summary_score, 6), r.error) for r in ports.evaluate_llm(tasks, truth(spark, [f for f, _ in images]), complete, "some-model").collect()}
    assert rows == {"good": (1.0, None), "prose": (0.0, None), "object": (0.0, None), "down": (0.0, "ConnectionError: no image"), "unknown": (0.0, "KeyError: b'?'")}


@pytest.mark.parametrize(("said", "want"), [
    ('{"series":[7,{"label":"b","x":[1],"y":[2]}]}', [("b", [1.0], [2.0])]), ('{"series":[{"x":["1.5"],"y":[2]}]}', [("", [1.5], [2.0])]),
    ('{"series":[{"label":5,"x":[1,null],"y":[2,3]},null,[],"x",{"label":"c","x":[1,2],"y":[3,4e2]}]}', [("c", [1.0, 2.0], [3.0, 400.0])]), ('{"series":[]}', []), ("[1]", []), ("", []), (None, []),
])
def test_entries_are_read_one_by_one(spark, said, want):
    row = spark.createDataFrame([(said,)], "t string").select(parsed_series(F.col("t")).alias("s")).first()
    assert [(s.label, list(s.x), list(s.y)) for s in row.s] == want
