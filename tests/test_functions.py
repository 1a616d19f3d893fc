import pytest
from pyspark.sql import functions as F

from curvemill.functions import geometry, references, responses
from curvemill.functions.licensing import license_status
from curvemill.functions.split import assign_split


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_licenses(spark):
    rows = [("cc-by", None, None), ("CC-BY", False, None), ("cc-by-4.0", None, None), (" cc0\n", None, None), ("cc-by-nc", None, "cc-by"), ("cc-by-nd", True, None), ("publisher-specific", None, None), (None, None, None), ("", True, "cc-by"), ("  ", None, "cc-by-nc"), (None, False, "cc-by"), ("", False, None)]
    r, n, e = "REDISTRIBUTABLE", "NEEDS_REVIEW", "EXCLUDED"
    assert values(spark, license_status(F.col("l"), F.col("oa"), F.col("o")), rows, "l string, oa boolean, o string") == [r, r, r, r, e, e, e, n, r, n, e, e]


def test_split(spark):
    keys = spark.range(2000).select(F.concat(F.lit("paper-"), "id").alias("k"))
    share = keys.where(assign_split(F.col("k"), 0.2) == "held_out").count() / 2000
    assert 0.15 <= share <= 0.25
    assert keys.where(assign_split(F.col("k"), 0.0) == "held_out").count() == 0
    assert keys.where(assign_split(F.col("k"), 1.0) == "public").count() == 0
    for wrong in (1.5, -0.1):
        with pytest.raises(ValueError, match="within"):
            assign_split(F.col("k"), wrong)


def test_figure_references(spark):
    good = {"2(a)": ("2", "a"), "2a": ("2", "a"), "2_a": ("2", "a"), "2 (a)": ("2", "a"), "Fig. 2(a)": ("2", "a"), "Fig 2": ("2", None), "FIGURE 3 B": ("3", "b"), "12": ("12", None), " 4 ": ("4", None), "2(a": ("2", "a"), "fig. 10c": ("10", "c")}
    bad = ["", "  ", "not a figure", "Table 3", "S1", "Fig.2", "2ab", None]
    found = values(spark, references.figure_reference(F.col("r")), [(k,) for k in [*good, *bad]], "r string")
    assert [f and (f.number, f.panel) for f in found] == [*good.values(), *[None] * len(bad)]


def test_pdf_signature(spark):
    rows = [b"%PDF-1.4", b"\n\r \t%PDF", b"<html>", b"", b"%PD", b"\xef\xbb\xbf%PDF"]
    assert values(spark, references.is_pdf(F.col("b")), [(bytearray(r),) for r in rows], "b binary") == [True, True, False, False, False, False]


def test_names(spark):
    assert values(spark, references.image_name(F.col("p"), F.col("s"), F.col("n")), [(3, "embedded", 0), (12, "page_render", 1)], "p int, s string, n int") == ["p03_embedded_0.jpg", "p12_page_render_1.png"]
    assert values(spark, references.image_path(F.col("p"), "/r", "raw"), [("a.png",), ("x/a.png",)], "p string") == ["/r/raw/a.png", "/r/x/a.png"]
    assert values(spark, references.series_label(F.col("p"), F.col("u")), [("k", "W"), ("k", ""), (None, None)], "p string, u string") == ["k (W)", "k", ""]
    assert values(spark, references.bare_doi(F.col("d"), lower=True), [("https://doi.org/10.1/A",), ("10.1/b",), ("",), (None,)], "d string") == ["10.1/a", "10.1/b", None, None]


def calibrated(spark, rows):
    c = F.col
    frame = spark.createDataFrame(rows, "px double, py double, x0 double, y0 double, x1 double, y1 double, lo double, hi double, xs string, ys string")
    x, y = geometry.to_data(c("px"), c("py"), (c("x0"), c("y0"), c("x1"), c("y1")), (c("lo"), c("hi")), (c("lo"), c("hi")), c("xs"), c("ys"))
    return [(r.x, r.y) for r in frame.select(x.alias("x"), y.alias("y")).collect()]


def test_calibration(spark):
    box = (0.0, 0.0, 100.0, 200.0)
    rows = [(0.0, 200.0, *box, 1.0, 100.0, "linear", "linear"), (100.0, 0.0, *box, 1.0, 100.0, "linear", "linear"), (50.0, 100.0, *box, 1.0, 100.0, "log", "log"), (10.0, 10.0, 10.0, 10.0, 10.0, 10.0, 1.0, 100.0, "linear", "linear")]
    assert calibrated(spark, rows) == [(1, 1), (100, 100), (pytest.approx(10), pytest.approx(10)), (1, 100)]
    error = geometry.calibration_error((F.lit(-1), F.lit(100)), (F.lit(1), F.lit(2)), F.col("s"), F.lit("linear"))
    assert [e is None for e in values(spark, error, [("log",), ("linear",)], "s string")] == [False, True]


def test_hues(spark):
    rows = [(255, 0, 0), (255, 165, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (160, 0, 255), (255, 0, 60)]
    rgb = [F.col(c) for c in "rgb"]
    assert values(spark, geometry.hue_name(geometry.hue(*rgb)), rows, "r int, g int, b int") == ["red", "orange", "yellow", "green", "cyan", "blue", "purple", "red"]
    assert values(spark, geometry.coloured(*rgb), [(200, 200, 200), (255, 0, 0), (250, 240, 245), (10, 50, 10), (10, 51, 10)], "r int, g int, b int") == [False, True, False, False, True]


def test_hues_at_the_edge_of_red(spark):
    """Shades of exactly 340 degrees are rounded as the reference and the SQL do: around the circle first."""
    rows = [(155, 113, 127), (233, 155, 181), (60, 0, 20), (255, 0, 85), (255, 0, 0), (255, 0, 1)]
    found = values(spark, geometry.hue_name(geometry.hue(*(F.col(c) for c in "rgb"))), rows, "r int, g int, b int")

    def want(r, g, b):
        most, least = max(r, g, b) / 255, min(r, g, b) / 255
        degrees = ((most - b / 255) / (most - least) - (most - g / 255) / (most - least)) % 6 / 6 % 1 * 360
        return "red" if degrees >= 340 or degrees < 20 else "purple"

    assert found[:2] == ["purple", "purple"] and found == [want(*row) for row in rows]


def test_responses(spark):
    good = '{"series": [{"label": "a", "x": [1, 2], "y": [3, 4]}, {"label": "b", "x": [1], "y": [1, 2]}, {"label": "c", "x": [], "y": []}]}'
    rows = [(good,), (f"```json\n{good}\n```",), (f" ```\n{good}```\n",), ("nothing",), ('{"other": 1}',), (None,)]
    found = values(spark, responses.parsed_series(F.col("r")), rows, "r string")
    assert [[s.label for s in f] for f in found] == [["a"], ["a"], ["a"], [], [], []]
    assert "log scale" in values(spark, responses.prompt(*(F.col(c) for c in "abcde")), [(1.0, 2.0, "log", 3.0, 4.0)], "a double, b double, c string, d double, e double")[0]
