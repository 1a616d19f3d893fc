"""Optimal one-to-one matching of predicted and reference curves within each figure.

Spark has no assignment join, so each figure's cost matrix is solved in a grouped map. A figure has tens of curves;
its matrix is what one task holds. Of equal optima the one with the lexicographically least reference numbers, in the
order of the predictions, is taken, so that results do not depend on a solver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How far above its bound a pair may be and still count as part of some optimum; rounding is far below.
TIGHT = 1e-10


def _with_prices(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row that owns each column of a square matrix in a least-cost matching, and prices of rows and columns: none of their sums is above a pair's cost, those of matched pairs equal it (shortest augmenting paths)."""
    n = len(cost)
    rows, columns = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for row in range(n):
        least, via = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, bool)
        at, column, reach = row, -1, 0.0
        visited = []
        while True:
            slack = reach + cost[at] - rows[at] - columns
            better = ~done & (slack < least)
            least[better], via[better] = slack[better], at
            column = int(np.where(done, np.inf, least).argmin())
            reach = least[column]
            done[column] = True
            visited.append(column)
            if owner[column] < 0:
                break
            at = owner[column]
        rows[row] += reach
        inner = np.array(visited[:-1], np.int64)
        rows[owner[inner]] += reach - least[inner]
        columns[inner] -= reach - least[inner]
        while column >= 0:  # turn the path around
            at = via[column]
            owner[column], column = at, int(np.flatnonzero(owner == at)[0]) if at != row else -1
    return owner, rows, columns


def _square(cost: np.ndarray) -> np.ndarray:
    """cost with rows or columns of zeros, up to as many of both."""
    n = max(cost.shape)
    out = np.zeros((n, n))
    out[: cost.shape[0], : cost.shape[1]] = cost
    return out


def solve(cost: np.ndarray) -> np.ndarray:
    """For each row the column it is assigned, -1 for none, at least total cost (rows and columns may differ in number)."""
    owner, _, _ = _with_prices(_square(cost))
    taken = np.empty(len(owner), np.int64)
    taken[owner] = np.arange(len(owner))
    return np.where(taken < cost.shape[1], taken, -1)[: cost.shape[0]]


def total(cost: np.ndarray, match: np.ndarray) -> float:
    some = match >= 0
    return float(cost[np.flatnonzero(some), match[some]].sum())


def solve_first(cost: np.ndarray) -> np.ndarray:
    """Of the optima of solve, the least in lexicographic order of the rows' columns; a row without one comes last.

    One solve: by the prices, the optima are the matchings within the pairs that cost no more than their prices. Row by
    row, the least column is taken that an alternating path through such pairs of later rows can free; a search from the
    row's present column backwards finds all columns for which there is one.
    """
    square = _square(cost)
    n = len(square)
    owner, rows, columns = _with_prices(square)
    tight = square - rows[:, None] - columns[None, :] <= TIGHT
    taken = np.empty(n, np.int64)
    taken[owner] = np.arange(n)
    tight[np.arange(n), taken] = True
    for row in range(min(cost.shape[0], n)):
        had = taken[row]
        # to[r]: the column that r moves to when its own is wanted, on the way to the column that row gives up
        to = np.full(n, -1)
        open_rows = np.arange(n) > row
        wave = np.array([had])
        while len(wave):
            reached = np.flatnonzero(open_rows & tight[:, wave].any(axis=1))
            to[reached] = wave[tight[np.ix_(reached, wave)].argmax(axis=1)]
            open_rows[reached] = False
            wave = taken[reached]
        free = tight[row] & (to[owner] >= 0)
        free[had] = True
        column = int(np.flatnonzero(free)[0])
        while column != had:  # each owner on the way gives its column to the one before
            giver = owner[column]
            owner[column], taken[row] = row, column
            row, column = giver, to[giver]
        owner[had], taken[row] = row, had
    return np.where(taken < cost.shape[1], taken, -1)[: cost.shape[0]]


#: A solver gets a cost matrix (predictions by references) and gives each row its column, or -1.
Solver = Callable[[np.ndarray], np.ndarray]


def _matched(rows: pa.Table, solver: Solver) -> np.ndarray:
    """Numbers of a figure's pair rows that the solver takes."""
    names = [np.unique(rows[f"{side}_curve_id"].to_numpy(zero_copy_only=False), return_inverse=True) for side in ("pred", "gt")]
    (pred, i), (gt, j) = names
    cost, at = np.ones((len(pred), len(gt))), np.full((len(pred), len(gt)), -1)
    cost[i, j], at[i, j] = rows["distance"].to_numpy(), np.arange(len(rows))
    match = np.asarray(solver(cost))
    some = np.flatnonzero(match >= 0)
    return at[some, match[some]]


def assign(costs: DataFrame, solver: Solver = solve_first) -> DataFrame:
    """Those of all pairs (figure_id, pred_curve_id, gt_curve_id, distance, ...) that are matched, with all their columns."""
    return costs.groupBy("figure_id").applyInArrow(lambda rows: rows.take(pa.array(_matched(rows, solver))), costs.schema)


def matched_curves(costs: DataFrame, curves: DataFrame, solver: Solver = solve_first) -> DataFrame:
    """Matched pairs with distance and coverage, predictions that got no reference (false positives) and references that got none (misses).

    One grouped map over each figure's pairs (costs) and curves (figure_id, role, curve_id); a plugged-in solver decides.
    """
    pairs = costs.select("figure_id", "pred_curve_id", "gt_curve_id", "distance", "coverage")
    side = lambda role: F.when(F.col("role") == role, F.col("curve_id")).alias(f"{role}_curve_id")
    alone = curves.select("figure_id", side("pred"), side("gt"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("coverage"))

    def one(rows: pa.Table) -> pa.Table:
        crossed = rows.filter(pc.and_(rows["pred_curve_id"].is_valid(), rows["gt_curve_id"].is_valid()))
        parts = [crossed.take(pa.array(_matched(crossed, solver)))] if len(crossed) else []
        taken = [set(parts[0][c].to_pylist()) if parts else set() for c in ("pred_curve_id", "gt_curve_id")]
        for here, there, used in (("pred_curve_id", "gt_curve_id", taken[0]), ("gt_curve_id", "pred_curve_id", taken[1])):
            lonely = rows.filter(rows[there].is_null())
            parts.append(lonely.filter(pa.array([x not in used for x in lonely[here].to_pylist()], pa.bool_())))
        return pa.concat_tables(parts)

    both = pairs.unionByName(alone)
    return with_marks(both.groupBy("figure_id").applyInArrow(one, both.schema))


def with_marks(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"is_miss": F.col("pred_curve_id").isNull(), "is_false_positive": F.col("gt_curve_id").isNull()})


def completed(matched: DataFrame, curves: DataFrame) -> DataFrame:
    """matched, from wherever, with the curves that no one got: predictions without a reference (false positives), references without one (misses)."""
    side = lambda role: curves.where(F.col("role") == role).select("figure_id", F.col("curve_id").alias(f"{role}_curve_id"))
    lonely = lambda role: side(role).join(matched, ["figure_id", f"{role}_curve_id"], "left_anti")
    rest = lonely("pred").unionByName(lonely("gt"), allowMissingColumns=True)
    return with_marks(matched.unionByName(rest, allowMissingColumns=True))
