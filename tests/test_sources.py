"""Kept tables, lookups and sources that fail at times."""

import json
import os
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from curvemill.operators import manifest
from curvemill.sources import remote, sinks
from curvemill.sources.snapshots import Snapshots, run_in_batches
from curvemill.sources.works_source import WorksSource, source_with

SCHEMA = "paper_id string, pdf_status string"


def papers(spark, n=10):
    return spark.createDataFrame([(f"p{i}", ("ok", "http_error", None)[i % 3]) for i in range(n)], SCHEMA)


def rows_of(table):
    return sorted((r.paper_id, r.pdf_status or "") for r in table.read().collect())


def test_batches_are_whole_and_repeats_harmless(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/t", SCHEMA)
    assert table.batch() == 0 and table.read().count() == 0 and table.cleared() == 0
    assert table.commit(1, papers(spark, 3)) and not table.commit(1, papers(spark, 9)) and table.commit(4, papers(spark).where("paper_id > 'p2'"))
    want = sorted((r.paper_id, r.pdf_status or "") for r in papers(spark).collect())
    assert rows_of(table) == want and table.batch() == 4
    assert table.upsert(5, spark.createDataFrame([("p1", "ok"), ("new", None)], SCHEMA), ["paper_id"])
    changed = sorted({**dict(want), "p1": "ok", "new": ""}.items())
    assert rows_of(table) == changed
    assert table.cleared() == 4 and rows_of(table) == changed and rows_of(Snapshots(spark, f"{tmp_path}/t/", SCHEMA)) == changed


def test_two_writers_of_one_batch(spark, tmp_path):
    one, other = (Snapshots(spark, f"{tmp_path}/t", SCHEMA) for _ in range(2))
    one.commit(1, papers(spark, 2))
    told = other._told
    other._told = lambda batch, parts: (one.commit(2, papers(spark, 1)), told(batch, parts))[1]
    assert not other.commit(2, papers(spark, 9))
    assert one.read().count() == 3 and one.cleared() == 1


@pytest.mark.parametrize("fails_at", range(6))
def test_a_broken_run_is_resumed(spark, tmp_path, fails_at):
    """It breaks in the work of a batch, or when the batch was written and isn't entered yet."""
    calls = {"n": 0}

    def breaking(f):
        def run(*a):
            calls["n"] += 1
            if calls["n"] == fails_at + 1:
                raise OSError("lost")
            return f(*a)

        return run

    todo = papers(spark).withColumn("extra", F.lit(1))
    work = lambda rows: rows.select("paper_id", "pdf_status")
    table = Snapshots(spark, f"{tmp_path}/t", SCHEMA)
    table._told = breaking(table._told)
    with pytest.raises(OSError, match="lost"):
        run_in_batches(todo, "paper_id", 4, breaking(work), table)
    resumed = Snapshots(spark, f"{tmp_path}/t", SCHEMA)
    assert resumed.read().count() == 4 * (fails_at // 2)
    found = run_in_batches(todo, "paper_id", 4, work, resumed)
    assert rows_of(resumed) == sorted((r.paper_id, r.pdf_status or "") for r in papers(spark).collect())
    assert {(r.pdf_status, r.n) for r in manifest.status_counts(found).collect()} == {("ok", 4), ("http_error", 3)}
    assert run_in_batches(todo, "paper_id", 4, lambda rows: 1 / 0, resumed).count() == 10


def service(folder, down=()):
    """A transport that knows even numbers, notes what it is asked, and fails for some."""

    def transport(url):
        ids = parse_qs(urlparse(url).query)["filter"][0].removeprefix("doi:").split("|")
        with open(f"{folder}/{abs(hash(url))}-{os.getpid()}", "a") as f:
            f.write(",".join(ids) + "\n")
        if set(ids) & set(down):
            raise ConnectionError("down")
        if "10.1/garbage" in ids:
            return b"<html>"
        even = [i for i in ids if i[-1].isdigit() and int(i[-1]) % 2 == 0]
        return json.dumps({"results": [{"doi": f"https://doi.org/{i.upper()}", "open_access": {"is_oa": True}, "primary_location": {"license": "cc-by", "pdf_url": f"http://x/{i[-1]}"}} for i in even]}).encode()

    return transport


def asked_of(folder):
    return sorted(i for f in folder.iterdir() for line in f.read_text().split() for i in line.split(","))


def test_kept_lookups(spark, tmp_path):
    (log := tmp_path / "log").mkdir()
    cache = Snapshots(spark, f"{tmp_path}/cache", remote.CACHE)
    dois = lambda *numbers: spark.createDataFrame([(f"10.1/A{n}",) for n in numbers] + [(None,)], "doi string")
    got = {r.doi: (r.license_id, r.is_oa, r.pdf_url) for r in remote.looked_up(dois(1, 2), cache, service(log), "http://api").collect()}
    assert got == {"10.1/a1": (None, None, None), "10.1/a2": ("cc-by", True, "http://x/2")}
    got = {r.doi for r in remote.looked_up(dois(2, 1, 3, 4), cache, service(log, ["10.1/a4"]), "http://api").collect()}
    assert got == {"10.1/a1", "10.1/a2"}  # the new ones' batch failed
    got = {r.doi: r.license_id for r in remote.looked_up(dois(3, 4, 1), cache, service(log), "http://api").collect()}
    assert got == {"10.1/a3": None, "10.1/a4": "cc-by", "10.1/a1": None}
    assert cache.read().count() == 4 and asked_of(log) == sorted(["10.1/a1", "10.1/a2"] + 2 * ["10.1/a3", "10.1/a4"])
    assert remote.looked_up(dois(1, 2, 3), cache, service(log, ["10.1/a1"]), "http://api").count() == 3 and cache.batch() == 2
    assert {(r.doi, r.pdf_url) for r in remote.pdf_urls(dois(5, 6), service(log), "http://api").collect()} == {("10.1/A5", None), ("10.1/A6", "http://x/6"), (None, None)}


def test_works_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(source_with(service(tmp_path, ["10.1/b3"]), "tested_works"))
    ids = [f"10.1/b{n}" for n in range(7)] + ["10.1/garbage"]
    rows = spark.read.format("tested_works").option("base", "http://api").option("dois", json.dumps(ids)).option("batch", "2").load()
    assert rows.rdd.getNumPartitions() == 4
    got = {r.doi: (r.status, json.loads(r.work)["primary_location"]["license"] if r.work else r.error) for r in rows.collect()}
    assert got == {
        "10.1/b0": ("found", "cc-by"), "10.1/b1": ("unknown", None), "10.1/b2": ("failed", "ConnectionError: down"), "10.1/b3": ("failed", "ConnectionError: down"), "10.1/b4": ("found", "cc-by"), "10.1/b5": ("unknown", None),
        "10.1/b6": ("failed", got["10.1/b6"][1]), "10.1/garbage": ("failed", got["10.1/garbage"][1]),
    }
    assert got["10.1/b6"][1].startswith("JSONDecodeError")


def test_filters_say_what_is_looked_up(spark, tmp_path):
    spark.dataSource.register(source_with(service(tmp_path), "filtered_works"))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("filtered_works").option("base", "http://api").load()
        got = load().where(F.col("doi").isin("10.1/c2", "10.1/c5") & (F.col("status") == "found")).collect()
        assert [r.doi for r in got] == ["10.1/c2"] and set(asked_of(tmp_path)) == {"10.1/c2", "10.1/c5"}
        assert load().where("doi = '10.1/c4'").first().status == "found"
        with pytest.raises(Exception, match="say which ids"):
            load().collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert WorksSource.name() == "works"


def test_a_damaged_image_is_left_out(spark):
    def pages(content):
        def broken():
            raise ValueError("xref")

        yield 1, [lambda: (b"good", 300, 300), broken, (b"plain", 200, 200), lambda: (b"small", 9, 9)], broken
        yield 2, [broken], lambda: (b"page", 10, 10)
        if content == b"bad":
            yield 3, [broken], broken

    rows = remote.extracted_images(spark.createDataFrame([("x", bytearray(b"fine")), ("y", bytearray(b"bad"))], "id string, content binary"), pages).collect()
    assert sorted((r.id, r.page or 0, bytes(r.image or b"")) for r in rows if r.id == "x") == [("x", 1, b"good"), ("x", 1, b"plain"), ("x", 2, b"page")]
    assert [r.error for r in rows if r.id == "y" and r.error] == ["ValueError: xref"]


def names_in(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_named_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 2}/f{i}.bin", bytearray(b"x" * i)) for i in range(9)], "name string, content binary").repartition(4)
    sinks.write_files(rows, f"{tmp_path}/out")
    want = sorted(f"d{i % 2}/f{i}.bin" for i in range(9))
    assert names_in(tmp_path / "out") == want and (tmp_path / "out/d1/f7.bin").read_bytes() == b"x" * 7
    failing = rows.withColumn("content", F.when(F.col("name") == "d1/f7.bin", F.raise_error(F.lit("no"))).otherwise(F.lit(b"new")))
    for bad in (failing, rows.withColumn("name", F.lit("same")), rows.withColumn("name", F.lit("../out")), rows.withColumn("name", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match=r"no|same name|no name"):
            sinks.write_files(bad, f"{tmp_path}/out")
        assert names_in(tmp_path / "out") == want and (tmp_path / "out/d0/f2.bin").read_bytes() == b"xx"
        assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []
    sinks.write_files(rows.where("name = 'd0/f2.bin'").withColumn("content", F.lit(None).cast("binary")), f"file://{tmp_path}/out", overwrite=True)
    assert names_in(tmp_path / "out") == ["d0/f2.bin"] and (tmp_path / "out/d0/f2.bin").read_bytes() == b""


def test_a_review_sample(spark, tmp_path):
    images = spark.createDataFrame([(f"/data/p{i}/fig.{i}.png", bytearray(b"png%d" % i)) for i in range(6)], "image_id string, content binary")
    two = [(f"/data/p{i}/fig.{i}.png", "ab"[k], 4 * k, 0, 4 * k + 4, 3) for i in range(6) for k in range(2 if i < 2 else 1)]
    panels = spark.createDataFrame(two, "image_id string, label string, x0 int, y0 int, x1 int, y1 int")
    pixels = images.select("image_id").crossJoin(spark.range(8).selectExpr("cast(id as int) as x")).crossJoin(spark.range(3).selectExpr("cast(id as int) as y")).withColumn("lum", F.col("x") * 10)
    sinks.write_files(sinks.panel_sample_files(images, panels, pixels, 1, 5), str(tmp_path))
    listed = json.loads((tmp_path / "sample_manifest.json").read_text())
    assert sorted(x["n_panels"] for x in listed) == [1, 1, 1, 2, 2] and {x["paper_id"] for x in listed if x["n_panels"] == 2} == {"p0", "p1"}
    want = {"sample_manifest.json"} | {f"sample/{x['paper_id']}__fig.{x['paper_id'][1]}__{kind}.png" for x in listed for kind in ("original", "panel_a", *(["panel_b"] if x["n_panels"] == 2 else []))}
    assert set(names_in(tmp_path)) == want
    assert (tmp_path / "sample/p0__fig.0__original.png").read_bytes() == b"png0"
    assert (tmp_path / "sample/p0__fig.0__panel_b.png").read_bytes() == sinks.png(4, 3, bytes([40, 50, 60, 70] * 3))
