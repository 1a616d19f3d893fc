"""Runs of rows, whatever the segments in which they are looked at."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from curvemill.operators import panels
from curvemill.plans import catalog


@pytest.mark.parametrize("segment", [1, 2, 5, 64, 4096])
def test_runs_in_segments(spark, segment):
    rng = random.Random(7)
    images = {f"i{n}": [rng.random() < share for _ in range(n)] for n, share in ((1, 1), (3, 0), (64, 1), (130, 0.5), (200, 0.95), (128, 0.02))}
    images["gap"] = None
    rows = [(k, i, f) for k, flags in images.items() if flags for i, f in enumerate(flags)] + [("gap", i, True) for i in (0, 1, 4, 5, 6, 70)]
    found = panels.runs(spark.createDataFrame(rows, "image_id string, i int, b boolean"), ["image_id"], "i", F.col("b"), segment)
    want = {("gap", True, 0, 2), ("gap", True, 4, 7), ("gap", True, 70, 71)}
    for k, flags in images.items():
        at = 0
        for flag, run in itertools.groupby(flags or []):
            n = len(list(run))
            want.add((k, flag, at, at + n))
            at += n
    got = [(r.image_id, r.flag, r.lo, r.hi) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["panel_grid", "panel_crop", "panel_histogram", "panel_rates", "panel_sample", "sample_half"])
def test_plans_stay_small(spark, name):
    """What a grid comes from isn't repeated at each place where it is used: the driver holds such plans in many versions."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 12
