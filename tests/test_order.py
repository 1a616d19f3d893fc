"""Rows keep the order of their files, however these are read."""

import csv
import gzip
import random

import pytest

from curvemill.operators import manifest
from curvemill.sources import files, schemas
from curvemill.sources.order import with_read_order

HEAD = [c.split()[0] for c in schemas.CURVE_ROWS.split(", ")]


def written(folder, packed, n_files=5, n_rows=400, breaks=False):
    """Curve rows in files; all of them in order."""
    rng = random.Random(2)
    every = []
    for k in range(n_files):
        path = f"{folder}/rows-{k}.csv" + (".gz" if packed else "")
        with (gzip.open if packed else open)(path, "wt", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(HEAD)
            for i in range(0 if k == 3 else n_rows):
                row = dict.fromkeys(HEAD, "") | {"SID": str(rng.randint(1, 9)), "figure_id": str(rng.randint(1, 4)), "figure_name": f"{k}({'abc'[i % 3]})", "DOI": f"10.1/{rng.randint(1, 30)}", "comments": 'two\nlines, "quoted"' if breaks and i % 7 == 0 else "x" * rng.randint(0, 90)}
                out.writerow(row.values())
                every.append(row)
    return every


@pytest.mark.parametrize(("packed", "breaks", "one_line"), [(False, False, True), (False, True, False), (True, True, False), (True, False, True)])
@pytest.mark.parametrize("split", ["4k", "64m"])
def test_order_of_several_files(spark, tmp_path, packed, breaks, one_line, split):
    want = written(tmp_path, packed, breaks=breaks)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = files.curve_rows(spark, str(tmp_path), one_line)
        assert split == "64m" or packed or not one_line or rows.rdd.getNumPartitions() > 5
        got = sorted((r.ord, r.SID, r.figure_id, r.figure_name, r.DOI, r.comments or "") for r in rows.collect())
        mine = rows.select("SID", "figure_id", "figure_name", "ord").withColumnRenamed("SID", "paper_id")
        numbers = {(r.ord, r.curve_id) for r in manifest.curves(mine).collect()}
        names = {(r.paper_id, r.figure_id): r.figure_reference for r in manifest.figures(mine).collect()}
        last = {r.doi: r.ord for r in files.papers_by_doi(rows.select("DOI", "ord")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(i, r["SID"], r["figure_id"], r["figure_name"], r["DOI"], r["comments"]) for i, r in enumerate(want)]
    firsts, by_paper = {}, {}
    for i, r in enumerate(want):
        firsts.setdefault((r["SID"], r["figure_id"]), (i, r["figure_name"]))
        by_paper.setdefault(r["SID"], []).append((i, r["figure_id"]))
    assert names == {k: name for k, (_, name) in firsts.items()}
    ordered = {p: sorted(rows, key=lambda x: (firsts[p, x[1]][0], x[0])) for p, rows in by_paper.items()}
    assert numbers == {(i, f"{p}-{f}-{n}") for p, rows in ordered.items() for n, (i, f) in enumerate(rows)}
    assert last == {r["DOI"]: i for i, r in enumerate(want)}


def test_order_of_parquet_and_of_nothing(spark, tmp_path):
    spark.range(0, 3000, 1, 3).withColumnRenamed("id", "_ord_id_").write.parquet(f"{tmp_path}/p")
    rows = with_read_order(spark.read.parquet(f"{tmp_path}/p")).collect()
    assert sorted(r.ord for r in rows) == list(range(3000)) and all(r.ord == r["_ord_id_"] for r in rows)
    written(tmp_path, False, n_files=1, n_rows=0)
    assert files.curve_rows(spark, f"{tmp_path}/rows-0.csv").count() == 0
