import json
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from curvemill import cli, ports
from curvemill.operators import leaderboard, manifest, pairings, panels, tables, tracing
from curvemill.sources import files, remote, schemas, sinks
from curvemill.streaming import ingest


def results(spark, rows):
    return spark.createDataFrame([(m, m, s, score, 3, "v0", run, "n") for m, s, score, run in rows], "model_id string, model_name string, status string, mean_summary_score double, n_figures long, dataset_version string, run_at string, note string")


def test_leaderboard(spark):
    board = leaderboard.ranked(results(spark, [("b", "scored", 0.2, "2026-01-01"), ("zeta", "scored", 0.5, "2026-03-01"), ("alpha", "scored", 0.5, "2026-03-01"), ("p", leaderboard.PENDING, 0.99, "2027"), ("a", "scored", 0.9, "2026-02-01")]))
    assert [(r["rank"], r.model_id, r.mean_summary_score) for r in board.orderBy("rank").collect()] == [(1, "a", 0.9), (2, "alpha", 0.5), (3, "zeta", 0.5), (4, "b", 0.2), (5, "p", None)]
    assert leaderboard.latest(board).first().run_at == "2026-03-01"
    page = leaderboard.html(board)
    assert "<td>0.900</td>" in page and "waits for an external run. n" in page
    assert "Nothing has been scored" in leaderboard.html(board.where("false"))


def grid_of(spark, width, height, dark, **changes):
    """Panels of an image whose pixels are dark where dark(x, y) says so."""
    rows = [("i", x, y, 0 if dark(x, y) else 255) for x in range(width) for y in range(height)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, lum int")
    return [(r.label, r["row"], r["col"], r.x0, r.y0, r.x1, r.y1) for r in panels.panel_grid(pixels, **changes).orderBy("row", "col").collect()]


def test_panel_grids(spark):
    whole = lambda w, h: [("a", 0, 0, 0, 0, w, h)]
    assert grid_of(spark, 40, 40, lambda x, y: True) == whole(40, 40)
    gap = lambda v: 16 <= v < 24
    assert [r[:3] for r in grid_of(spark, 40, 40, lambda x, y: not gap(x) and not gap(y))] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)]
    # a blank cell goes, and labels close up
    assert [r[:3] for r in grid_of(spark, 40, 40, lambda x, y: not gap(x) and not gap(y) and not (x < 16 and y > 20))] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1)]
    assert grid_of(spark, 40, 40, lambda x, y: x not in (20, 21)) == whole(40, 40)  # too narrow a gap
    assert grid_of(spark, 40, 40, lambda x, y: not 16 <= x < 24, max_panels=1) == whole(40, 40)
    assert [r[0] for r in grid_of(spark, 60, 40, lambda x, y: x < 28 or (x > 40 and y % 6 < 4))] == ["a"]  # the right one is text


def test_tracing_a_diagonal(spark):
    pixels, known = files.synthetic_charts(spark, 60)
    axes = spark.createDataFrame([("single", 0.0, 10.0, 0.0, 10.0, "linear", "linear"), ("two", 0.0, 10.0, 0.0, 10.0, "linear", "linear"), ("log", 1.0, 100.0, 0.0, 10.0, "log", "linear")], "image_id string, x_lo double, x_hi double, y_lo double, y_hi double, x_scale string, y_scale string")
    found = tracing.traced(pixels, axes)
    assert {(r[0], r[1]) for r in found.select("image_id", "series_label").distinct().collect()} == {("single", "red"), ("two", "red"), ("two", "blue")}
    assert all(abs(r.y - (10 - r.x)) < 0.5 for r in found.where("series_label = 'red'").collect())
    assert known.count() == 44


def test_tracing_counts_shades_at_the_edge_of_red(spark):
    """A series of 15 pixels, one of which is of exactly 340 degrees, which is rounded to purple."""
    shades = [(160, 0, 255)] * 14 + [(155, 113, 127)]
    pixels = spark.createDataFrame([("i", n % 3, n, *rgb) for n, rgb in enumerate(shades)], "image_id string, x int, y int, r int, g int, b int")
    axes = spark.createDataFrame([("i", 0.0, 3.0, 0.0, 15.0, "linear", "linear")], "image_id string, x_lo double, x_hi double, y_lo double, y_hi double, x_scale string, y_scale string")
    found = sorted((r.series_label, r.px, round(r.x, 6), round(r.y, 6)) for r in tracing.traced(pixels, axes).collect())
    assert found == [("purple", 0, 0.0, 9.0), ("purple", 1, 1.0, 8.0), ("purple", 2, 2.0, 7.0)]


def test_manifest(spark):
    papers = spark.createDataFrame([("p1", "REDISTRIBUTABLE"), ("p2", "EXCLUDED"), ("p3", "REDISTRIBUTABLE")], "paper_id string, license_status string")
    rows = spark.createDataFrame([("p1", "f2", "2(a)", 1), ("p1", "f1", "1", 2), ("p1", "f2", "late", 3), ("p2", "f9", "9", 4)], "paper_id string, figure_id string, figure_name string, ord long")
    figs, crvs = manifest.build(papers, rows)
    assert sorted((r.figure_id, r.figure_reference, r.n_curves) for r in figs.collect()) == [("f1", "1", 1), ("f2", "2(a)", 2)]
    assert [r.curve_id for r in crvs.orderBy("number").collect()] == ["p1-f2-0", "p1-f2-1", "p1-f1-2"]
    assert {(r.paper_id, r.n_curves) for r in manifest.paper_counts(manifest.gated(papers), figs, crvs).collect()} == {("p1", 3), ("p3", 0)}
    with pytest.raises(Exception, match="redistributable"):
        manifest.must_be_redistributable(papers).count()


def test_parsing_curve_rows(spark):
    rows = spark.createDataFrame([("s", "[1,2]", "[3,4]"), ("t", "not-json", "[1]"), ("u", "[1,2,3]", "[1,2]"), ("v", "[]", "[]"), ("u", "[1]", "[1]"), ("w", "[null]", "[1]")], "sid string, x string, y string").withColumns({"prop_y": F.lit("k"), "unit_y": F.lit("W")})
    parsed = manifest.parsed_curve_rows(rows)
    assert sorted((r.sid, r.error or "") for r in parsed.collect()) == [("s", ""), ("t", "malformed array"), ("u", ""), ("u", "lengths differ"), ("v", ""), ("w", "malformed array")]
    assert sorted(r.sid for r in manifest.without_spoilt_papers(parsed).collect()) == ["s", "v"]


def test_keyed_tables(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert show(tables.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert show(tables.not_yet_done(new, old, ["k"])) == [(3, "d")]
    assert show(tables.last_wins(old.union(new), ["k"], ["v"])) == [(1, "a"), (2, "c"), (3, "d")]
    numbered = tables.chunks(spark.range(101).repartition(5), "id", 40).groupBy("batch").count()
    assert show(numbered) == [(0, 40), (1, 40), (2, 21)]
    assert tables.chunks(spark.range(0), "id", 40).count() == 0


def test_chunks_of_ties_and_nulls(spark):
    rows = spark.range(5000).selectExpr("if(id % 7 > 0, id % 5, null) as k", "cast(id as string) as v")
    got = tables.chunks(rows, "k", 1).orderBy("batch").collect()
    assert [r.batch for r in got] == list(range(5000)) and len({r.v for r in got}) == 5000
    assert [r.k for r in got] == sorted((r.k for r in got), key=lambda k: (k is not None, k or 0))


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text('SID,DOI,figure_id,x,y,extra\n1,10.1/A,5,"[1,2]","[3,""4""]",z\n')
    row = files.csv_table(spark, str(tmp_path / "c.csv"), "SID string, DOI string, figure_id string, x string, y string, extra string").first()
    assert (row.x, row.y) == ("[1,2]", '[3,"4"]')
    (tmp_path / "r.json").write_text(json.dumps([{"paper_id": "1", "figure_id": "2", "x_range": [1, 2], "status": "verified"}, {"paper_id": "3", "x_scale": "log"}]))
    assert [(r.paper_id, r.x_scale, r.y_scale, r.x_range) for r in files.registry(spark, str(tmp_path / "r.json")).orderBy("paper_id").collect()] == [("1", "linear", "linear", [1.0, 2.0]), ("3", "log", "linear", None)]
    image = sinks.png(3, 2, bytes([0, 10, 20, 30, 40, 255]))
    sinks.write_files(spark.createDataFrame([("a.png", bytearray(image))], "name string, content binary"), str(tmp_path / "img"))
    pixels = sorted((r.y, r.x, r.r) for r in files.image_pixels(spark, str(tmp_path / "img")).collect())
    assert pixels == [(0, 0, 0), (0, 1, 10), (0, 2, 20), (1, 0, 30), (1, 1, 40), (1, 2, 255)]
    assert files.file_names(files.binary_files(spark, str(tmp_path / "img"))).first().names == ["a.png"]
    crops = spark.createDataFrame([("i", "a", 0, 0, 7), ("i", "a", 1, 0, 9)], "image_id string, label string, x int, y int, lum int")
    assert bytes(sinks.panel_images(crops).first().image) == sinks.png(2, 1, bytes([7, 9]))
    scores = spark.createDataFrame([("f", 0.5, 1.0, 0.5, 0.0)], "figure_id string, summary_score double, match_rate double, mean_distance double, mean_coverage double")
    sinks.write_table(sinks.result_document(scores, "m", "M", "v1", "2026").coalesce(1), str(tmp_path / "res"), "json")
    back = spark.read.schema(schemas.RESULT).json(str(tmp_path / "res")).first()
    assert (back.model_id, back.n_figures, back.per_figure[0].mean_curve_distance) == ("m", 1, 0.5)
    with pytest.raises(PermissionError):
        sinks.upload("x")
    with pytest.raises(NotImplementedError):
        sinks.upload("x", "token")


def test_license_lookups(spark):
    def transport(url):
        if "bad" in url:
            raise URLError("down")
        return json.dumps({"results": [{"doi": "https://doi.org/d1", "open_access": {"is_oa": True}, "primary_location": {"license": None}, "locations": [{"license": None}, {"license": "cc-by"}]}, {"doi": None}]}).encode()

    dois = spark.createDataFrame([("d1",), ("d2",)], "doi string")
    found = remote.lookups(dois, transport, "http://api")
    got = files.works(found).first()
    assert (got.doi, got.is_oa, got.license_id) == ("d1", True, "cc-by")
    cache = remote.with_cache(files.works(found).where("false"), files.works(found), dois)
    assert sorted((r.doi, r.license_id or "") for r in cache.collect()) == [("d1", "cc-by"), ("d2", "")]
    failed = remote.lookups(spark.createDataFrame([("bad",)], "doi string"), transport, "http://api").first()
    assert failed.body is None and "URLError" in failed.error
    assert remote.works_url("http://a", ["x", "y"], "m@e") == "http://a?filter=doi%3Ax%7Cy&per-page=2&mailto=m%40e"


def test_pdf_downloads(spark):
    def transport(url):
        if url == "403":
            raise HTTPError(url, 403, "no", {}, None)
        if url == "reset":
            raise ConnectionResetError("reset")
        return b"\n%PDF-1" if url == "ok" else b"<html>"

    rows = spark.createDataFrame([("a", None), ("b", "  "), ("c", "ok"), ("d", "page"), ("e", "403"), ("f", "reset")], "id string, pdf_url string")
    assert {r.id: r.status for r in remote.fetched_pdfs(rows, transport).collect()} == {"a": "no_pdf_url", "b": "no_pdf_url", "c": "ok", "d": "not_a_pdf", "e": "http_error", "f": "connection_error"}


def test_extracted_images(spark):
    def pages(content):
        if content == b"broken":
            raise ValueError("no")
        yield 1, [(b"small", 50, 50), (b"large", 200, 200)], (b"page1", 900, 900)
        yield 2, [(b"small", 50, 50)], (b"page2", 900, 900)

    rows = remote.extracted_images(spark.createDataFrame([("x", bytearray(b"pdf")), ("y", bytearray(b"broken"))], "id string, content binary"), pages).collect()
    assert sorted((r.id, r.page or 0, r.source or "", bytes(r.image or b"")) for r in rows) == [("x", 1, "embedded", b"large"), ("x", 2, "page_render", b"page2"), ("y", 0, "", b"")]
    assert next(r.error for r in rows if r.id == "y") == "ValueError: no"


def test_plugged_models(spark):
    tasks = spark.createDataFrame([("f", 1), ("g", 0)], "figure_id string, n int")
    rows = ports.run_model(tasks, lambda t: [("s", [1, 2], [3 / t["n"], 4])]).collect()
    assert sorted((r.figure_id, r.y if r.error is None else r.error) for r in rows if r.figure_id == "f") == [("f", 3.0), ("f", 4.0)]
    assert [r.error for r in rows if r.figure_id == "g"] == ["ZeroDivisionError: division by zero"]
    ports.register_model(spark, "curves_of", lambda t: [("s", [1.0], [float(len(t["payload"]))])])
    spark.createDataFrame([("f", "abc")], "figure_id string, payload string").createOrReplaceTempView("some_tasks")
    assert spark.sql("SELECT y FROM curves_of(TABLE(some_tasks))").first().y == 3.0
    pairs = spark.createDataFrame([("f", "a", "b", 0.25)], "figure_id string, pred_curve_id string, gt_curve_id string, d double")
    assert ports.pair_metric(pairs, lambda frame: frame["d"] * 2).first().chamfer == 0.5


def test_incremental_ingest(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(source)
    put([(1, "a"), (2, "b"), (2, "b")])
    assert ingest.ingest(spark, source, "k int, v string", table, state, ["k"]) == 2
    put([(2, "z"), (3, "c")])
    assert ingest.ingest(spark, source, "k int, v string", table, state, ["k"]) == 3
    assert ingest.ingest(spark, source, "k int, v string", table, state, ["k"]) == 3


def test_pairings(spark):
    pairs = spark.createDataFrame([("p", "i", "a", "x.png"), ("q", "i", "z", "d/x.png"), ("r", "j", None, None)], "paper_id string, image_id string, panel_label string, image_path string")
    boxes = spark.createDataFrame([("i", "a", 1)], "image_id string, label string, x0 int")
    assert {r.paper_id: (r.x0, r.error) for r in pairings.with_panel(pairs, boxes).collect()} == {"p": (1, None), "q": (None, "KeyError: no panel z"), "r": (None, None)}
    names = spark.createDataFrame([("p", "x.png", 7), ("q", "x.png", 8)], "paper_id string, name string, size int")
    assert [(r.paper_id, r["size"]) for r in pairings.with_images(pairs, names).collect()] == [("p", 7)]
    papers = spark.createDataFrame([("p", "", 1), ("q", "cc0", 0)], "paper_id string, license_id string, n_images int")
    assert {r.paper_id: r.license_id for r in pairings.with_license(pairs, papers).collect()} == {"p": "cc-by", "q": "cc0"}
    assert pairings.papers_with_images(papers, spark.createDataFrame([("p", ["a"]), ("q", ["b"])], "folder string, names array<string>")).count() == 1


def test_command_line(capsys):
    assert cli.main(["version"]) == 0
    assert json.loads(capsys.readouterr().out)["tool"] == "curvemill"
    cli.main(["capabilities", "--format", "text"])
    assert "commands: capabilities, version" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_plugged_splitters_and_rates(spark):
    def split(content):
        if content == b"bad":
            raise ValueError("no image")
        return [("a", 0, 0, 1, 1), ("b", 1, 0, 2, 1)][: len(content)]

    images = spark.createDataFrame([("i", bytearray(b"x")), ("j", bytearray(b"xy")), ("k", bytearray(b"bad")), ("l", bytearray(b""))], "image_id string, content binary")
    found = ports.split_panels(images, split)
    assert sorted((r.image_id, r.label or "", r.error or "") for r in found.collect()) == [("i", "a", ""), ("j", "a", ""), ("j", "b", ""), ("k", "", "ValueError: no image")]
    rates = panels.rates(panels.outcomes(found)).first()
    assert (rates.n_images, rates.n_failed, rates.n_multi, rates.n_single, rates.multi_rate) == (3, 1, 1, 1, 0.5)
    assert panels.rates(panels.outcomes(found.where("false"))).first().multi_rate == 0


def test_half_samples(spark):
    rows = spark.range(20).withColumn("multi", F.col("id") < 3)
    got = tables.half_sample(rows, "id", F.col("multi"), 1, 11).collect()
    assert (sum(r.multi for r in got), len(got)) == (3, 9)
    assert len(tables.half_sample(rows.where("multi"), "id", F.col("multi"), 1, 4).collect()) == 2


def test_papers_to_download(spark):
    rows = [("a", "REDISTRIBUTABLE", "http://x"), ("b", "REDISTRIBUTABLE", ""), ("c", "EXCLUDED", "http://y"), ("d", "REDISTRIBUTABLE", None), ("e", "REDISTRIBUTABLE", " \n")]
    papers = spark.createDataFrame(rows, "paper_id string, license_status string, pdf_url string")
    ids = lambda df: [r.paper_id for r in df.orderBy("paper_id").collect()]
    assert ids(manifest.downloadable(papers)) == ["a", "e"]
    assert ids(manifest.without_pdf_url(papers)) == ["b", "d", "e"]
    assert manifest.total_size(spark.createDataFrame([([1, 2],), (None,), ([],)], "names array<int>"), "names").first().total == 2
    images = spark.createDataFrame([("d", 2, 1), ("d", 1, 5), ("e", 1, 1)], "doc string, page int, number int")
    assert sorted((r.doc, r.page, r.ordinal) for r in pairings.with_ordinals(images).collect()) == [("d", 1, 0), ("d", 2, 1), ("e", 1, 0)]
