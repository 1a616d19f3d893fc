import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.operators import assignment, curves, nearest, scoring

KEYS = ["figure_id", "pred_curve_id", "gt_curve_id"]


def points(spark, figures):
    """{figure: {role: {curve: (xs, ys)}}} as rows."""
    rows = [(f, c, role, i, float(x), float(y)) for f, roles in figures.items() for role, cs in roles.items() for c, (xs, ys) in cs.items() for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "figure_id string, curve_id string, role string, ord long, x double, y double")


def pair(pred, gt):
    return {"pred": {"p": pred}, "gt": {"g": gt}}


def test_points_are_sorted_stably(spark):
    found = curves.sorted_points(points(spark, {"f": {"gt": {"a": ((3, 1, 2, 1), (30, 10, 20, 11))}}}))
    assert [r.y for r in found.orderBy("place").collect()] == [10, 11, 20, 30]


CASES = {
    "perfect": (((1, 2, 3), (1, 4, 9)), ((1, 2, 3), (1, 4, 9)), 1.0, 0.0),
    "no_overlap": (((100, 200), (1, 1)), ((0, 10), (0, 1)), 0.0, 1.0),
    "touching": (((10, 20), (1, 1)), ((0, 10), (0, 1)), 0.0, 1.0),
    "gt_point_inside": (((0, 10), (5, 5)), ((5,), (5,)), 1.0, 0.0),
    "gt_point_outside": (((0, 10), (5, 5)), ((50,), (5,)), 0.0, 1.0),
    "single_prediction": (((5,), (5,)), ((0, 10), (0, 10)), 0.0, 1.0),
    "flat_hit": (((0, 10), (3, 3)), ((0, 5, 10), (3, 3, 3)), 1.0, 0.0),
    "flat_miss": (((0, 10), (4, 4)), ((0, 5, 10), (3, 3, 3)), 1.0, 1.0),
    "half_covered": (((0, 5), (0, 5)), ((0, 10), (0, 10)), 0.5, 0.25),
    "clamped": (((0, 10), (900, 900)), ((0, 10), (0, 1)), 1.0, 1.0),
}


def test_pair_distances(spark):
    pts = points(spark, {k: pair(p, g) for k, (p, g, _, _) in CASES.items()})
    found = {r.figure_id: (r.coverage, r.distance) for r in curves.compared(pts).collect()}
    assert found == {k: (pytest.approx(c), pytest.approx(d)) for k, (_, _, c, d) in CASES.items()}


def test_interpolation_like_numpy(spark):
    rng = np.random.default_rng(5)
    figures = {}
    for n in range(20):
        px = np.sort(rng.integers(0, 12, rng.integers(2, 9))).astype(float)
        gx = np.sort(rng.integers(-3, 15, 6)).astype(float)
        figures[str(n)] = pair((px, rng.random(len(px))), (gx, rng.random(6)))
    pts = points(spark, figures)
    rows = curves.interpolated(pts).collect()
    for r in rows:
        px, py = figures[r.figure_id]["pred"]["p"]
        if (px == r.x).sum() <= 1 and px[0] < px[-1] and not (r.x < px[0] and (px == px[0]).sum() > 1):
            assert r.pred_y == pytest.approx(np.interp(r.x, px, py), abs=1e-12)
    assert len(rows) == 120


@pytest.mark.parametrize("range_points", [1, 2, 7, 40])
def test_ranges_give_the_same_samples(spark, range_points):
    rng = np.random.default_rng(6)
    side = lambda n, top: (rng.integers(0, top, n), rng.random(n))
    figures = {str(k): {"pred": {c: side(rng.integers(1, 30), top) for c in "ab"}, "gt": {c: side(rng.integers(1, 30), top) for c in "xy"}} for k, top in enumerate((1, 5, 40, 1000, 10**9))}
    figures["gap"] = {"pred": {"a": ((0, 1, 10**6), (0, 1, 2))}, "gt": {"x": (range(0, 10**6, 30_000), range(34))}}
    pts = points(spark, figures)
    samples = lambda **k: sorted(map(tuple, curves.interpolated(pts, **k).select(*KEYS, "ord", "pred_y").collect()))
    whole = samples()
    assert samples(range_points=range_points) == whole and len(whole) > 200


def test_chamfer(spark):
    found = curves.chamfer(pts := points(spark, {"a": pair(((0, 1), (0, 1)), ((0, 1), (0, 1))), "b": pair(((0, 1), (1, 2)), ((0, 1), (0, 1))), "c": pair(((5,), (5,)), ((5,), (6,)))}), curves.pairs(pts))
    assert {r.figure_id: round(r.chamfer, 9) for r in found.collect()} == {"a": 0.0, "b": 1.0, "c": 1.0}


def nearest_by_hand(pred, gt):
    (px, py), (gx, gy) = (np.array(c, float) for c in (pred, gt))
    xr, yr = np.ptp(gx) or 1.0, np.ptp(gy) or 1.0
    d = np.hypot((px[:, None] - gx[None, :]) / xr, (py[:, None] - gy[None, :]) / yr)
    return (d.min(axis=1).mean() + d.min(axis=0).mean()) / 2


@pytest.mark.parametrize("block", [1, 4, 64])
def test_chamfer_by_blocks(spark, block):
    rng = np.random.default_rng(9)
    shapes = {
        "wide": lambda n: (rng.random(n) * 1e6, rng.random(n)), "same_x": lambda n: (np.full(n, 3.0), rng.random(n)), "ties": lambda n: (rng.integers(0, 4, n), rng.integers(0, 3, n)), "clumped": lambda n: (np.concatenate([[1e9], rng.random(n - 1)]), rng.random(n)),
        "line": lambda n: (np.arange(n), np.sin(np.arange(n) / 9)), "point": lambda n: (np.ones(1), np.ones(1)),
    }
    sizes = (150, 40) if block < 64 else (400, 30)
    figures = {f"{a}-{b}-{n}": pair(shapes[a](n), shapes[b](sum(sizes) - n)) for a in shapes for b in shapes for n in sizes}
    pts = points(spark, figures)
    found = {r.figure_id: r.chamfer for r in curves.chamfer(pts, curves.pairs(pts), block).collect()}
    assert found == {f: pytest.approx(nearest_by_hand(r["pred"]["p"], r["gt"]["g"]), rel=1e-9, abs=1e-12) for f, r in figures.items()}


def test_long_curves_meet_few_blocks(spark):
    n = 6400
    x = np.arange(n)
    pts = points(spark, {"f": pair((x, np.sin(x / 300)), (x + 0.25, np.sin(x / 300)))})
    found = curves.pairs(pts)
    units = found.select(*KEYS, F.lit(float(n)).alias("x_range"), F.lit(2.0).alias("y_range"))
    stats = curves.curve_stats(pts)
    cut = nearest.blocks(pts, stats, 64).cache()
    assert cut.count() == 200 and cut.agg(F.max(F.size("points"))).first()[0] <= 128
    mean = nearest.nearest_means(cut, units, "pred", "gt").first()["mean"]
    assert mean == pytest.approx(nearest_by_hand((x / n, np.sin(x / 300) / 2), ((x + 0.25) / n, np.sin(x / 300) / 2)), rel=0.5)
    assert nearest.meetings(cut, units, "pred", "gt").count() <= 100 * 6


def test_blocks_of_scattered_points_meet_few(spark):
    rng = np.random.default_rng(3)
    dots = [("f", role, "c", i, float(x), float(y)) for role in ("pred", "gt") for i, (x, y) in enumerate(rng.random((6400, 2)))]
    pts = spark.createDataFrame(dots, "figure_id string, role string, curve_id string, ord int, x double, y double").cache()
    cut = nearest.blocks(pts, curves.curve_stats(pts), 64).cache()
    units = spark.createDataFrame([("f", "c", "c", 1.0, 1.0)], "figure_id string, pred_curve_id string, gt_curve_id string, x_range double, y_range double")
    assert nearest.meetings(cut, units, "pred", "gt").count() <= 25 * cut.where("role = 'pred'").count()


def test_dense_and_equal_points_meet_few(spark):
    """Points that lie ever denser towards the bottom, each of them four times."""
    rng = np.random.default_rng(4)
    curves_of = {role: np.repeat(np.stack([rng.random(1600), rng.exponential(0.1, 1600)], axis=1), 4, axis=0) for role in ("pred", "gt")}
    dots = [("f", role, "c", i, float(x), float(y)) for role, of in curves_of.items() for i, (x, y) in enumerate(of)]
    pts = spark.createDataFrame(dots, "figure_id string, role string, curve_id string, ord int, x double, y double").cache()
    cut = nearest.blocks(pts, curves.curve_stats(pts), 16).cache()
    units = spark.createDataFrame([("f", "c", "c", 1.0, 1.0)], "figure_id string, pred_curve_id string, gt_curve_id string, x_range double, y_range double")
    compared = nearest.meetings(cut, units, "pred", "gt").agg(F.sum(F.size("own") * F.size("others"))).first()[0]
    assert compared <= 6400 * 200
    pred, gt = (curves_of[role] for role in ("pred", "gt"))
    want = np.hypot(*(pred[:, None, k] - gt[None, :, k] for k in (0, 1))).min(axis=1).mean()
    assert nearest.nearest_means(cut, units, "pred", "gt").first()["mean"] == pytest.approx(want)


def test_log_scale_spoils_figures_with_other_x(spark):
    pts = points(spark, {"good": pair(((1, 100), (0, 2)), ((1, 10, 100), (0, 1, 2))), "bad": pair(((0, 100), (0, 2)), ((1, 10, 100), (0, 1, 2))), "linear": pair(((0, 1), (0, 1)), ((0, 1), (0, 1)))})
    scales = spark.createDataFrame([("good", "log"), ("bad", "log"), ("linear", "linear")], "figure_id string, x_scale string")
    good, bad = curves.in_log_space(pts, scales)
    assert {r.figure_id: round(r.distance, 9) for r in curves.compared(good).collect()} == {"good": 0.0, "linear": 0.0}
    scores = scoring.with_errors(scoring.figure_scores(good, scales), bad)
    assert {r.figure_id: (round(r.summary_score, 9), r.error is None) for r in scores.collect()} == {"good": (1.0, True), "bad": (0.0, False), "linear": (1.0, True)}


@pytest.mark.parametrize("seed", range(12))
def test_assignment_by_permutations(seed):
    rng = np.random.default_rng(seed)
    for _ in range(8):
        rows, columns = rng.integers(1, 6, 2).tolist()
        cost = rng.integers(0, 4, (rows, columns)) / 3
        small, large = sorted((rows, columns))
        turned = cost if rows <= columns else cost.T
        best = min(sum(turned[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), small))
        for match in (assignment.solve(cost), assignment.solve_first(cost)):
            assert assignment.total(cost, match) == pytest.approx(best)
            used = match[match >= 0].tolist()
            assert len(used) == len(set(used)) == small
        # every way to give the rows a column each, or none (last) where there are too few
        choices = [*range(columns), *[columns] * max(0, rows - columns)]
        costs = np.hstack([cost, np.zeros((rows, 1))])
        first = min(p for p in set(itertools.permutations(choices, rows)) if math.isclose(sum(costs[i, c] for i, c in enumerate(p)), best, abs_tol=1e-9))
        assert tuple(assignment.solve_first(cost).tolist()) == tuple(c if c < columns else -1 for c in first)


@pytest.mark.parametrize("kind", ["random", "equal", "few values", "shifted"])
def test_assignment_of_many_curves(kind):
    rng = np.random.default_rng(3)
    cost = {"random": rng.random((200, 200)), "equal": np.full((200, 200), 0.1), "few values": rng.integers(0, 3, (200, 150)) / 3, "shifted": (np.arange(200)[:, None] + np.arange(200)[None, :]) % 200 / 200}[kind]
    began = time.perf_counter()
    match = assignment.solve_first(cost)
    assert time.perf_counter() - began < 5  # 0.1 to 0.6 s on an idle machine
    assert assignment.total(cost, match) == pytest.approx(assignment.total(cost, assignment.solve(cost)))
    if kind == "equal":
        assert match.tolist() == list(range(200))
    # no two rows can change columns at no cost with the first gaining
    for a, b in itertools.combinations(range(150), 2):
        if min(match[a], match[b]) >= 0 and match[b] < match[a]:
            assert cost[a, match[b]] + cost[b, match[a]] > cost[a, match[a]] + cost[b, match[b]] + 1e-12


def test_figure_scores(spark):
    line, other = ((0, 10), (0, 10)), ((0, 10), (9, 10))
    pts = points(spark, {
        "perfect": {"pred": {"1": line}, "gt": {"1": line}}, "missed": {"gt": {"1": line}}, "extra": {"pred": {"1": line, "2": other}, "gt": {"1": line}}, "only_pred": {"pred": {"1": line}},
        "crossed": {"pred": {"a": ((0, 10), (10, 10)), "b": ((0, 10), (0, 0))}, "gt": {"a": ((0, 10), (0, 0)), "b": ((0, 10), (10, 10))}},
    })
    figures = spark.createDataFrame([(f,) for f in ("perfect", "missed", "extra", "only_pred", "crossed", "empty")], "figure_id string")
    found = {r.figure_id: (round(r.match_rate, 6), round(r.summary_score, 6)) for r in scoring.figure_scores(pts, figures).collect()}
    assert found == {"perfect": (1.0, 1.0), "missed": (0.0, 0.0), "extra": (0.5, round(2.5 / 3, 6)), "only_pred": (0.0, 0.0), "crossed": (1.0, 1.0), "empty": (1.0, 1.0)}
    total = scoring.dataset_score(scoring.figure_scores(pts, figures)).first()
    assert total.n_figures == 6 and total.mean_summary_score == pytest.approx((3 + 2.5 / 3) / 6)


def test_completion_marks_both_sides(spark):
    pts = points(spark, {"f": {"pred": {"a": ((0, 1), (0, 1)), "b": ((0, 1), (5, 6))}, "gt": {"a": ((0, 1), (0, 1))}}, "g": {"gt": {"z": ((0, 1), (0, 1))}}})
    rows = assignment.completed(assignment.assign(curves.compared(pts)), curves.curve_stats(pts)).collect()
    assert sorted((r.figure_id, r.pred_curve_id or "", r.gt_curve_id or "", r.is_miss, r.is_false_positive) for r in rows) == [("f", "a", "a", False, False), ("f", "b", "", False, True), ("g", "", "z", True, False)]
    assert curves.compared(pts.where(F.lit(False))).count() == 0


def test_a_plugged_matcher_decides(spark):
    pts = points(spark, {"f": {"pred": {"a": ((0, 1), (0, 1)), "b": ((0, 1), (5, 6))}, "gt": {"a": ((0, 1), (0, 1)), "c": ((0, 1), (5, 6))}}})
    crossed = lambda cost: np.array([1, -1])
    rows = assignment.matched_curves(curves.compared(pts), curves.curve_stats(pts), crossed).collect()
    assert sorted((r.pred_curve_id or "", r.gt_curve_id or "", r.is_miss, r.is_false_positive) for r in rows) == [("", "a", True, False), ("a", "c", False, False), ("b", "", False, True)]
    assert scoring.figure_scores(pts, pts.select("figure_id").distinct(), crossed).first().match_rate == 0.5
    own = {(r.pred_curve_id, r.gt_curve_id): r.distance for r in assignment.matched_curves(curves.compared(pts), curves.curve_stats(pts)).collect()}
    assert own == {("a", "a"): 0.0, ("b", "c"): 0.0}
