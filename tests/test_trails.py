"""Trails against plain loops, and what their plan does once."""

import numpy as np
import pytest

from tests.test_one_order import plan_of
from tests.test_tracking import CELL
from waymark.operators import recordings as rec
from waymark.plans import render


def tracks(spark, n=170):
    rng = np.random.default_rng(4)
    rows = []
    for tag in range(4):
        for i in range(n):
            x = float(rng.integers(0, 99)) if rng.random() < (0.0, 0.2, 0.9, 0.5)[tag] and not 60 < i < 130 * (tag == 3) else None
            rows.append(("s", 3 * i + 1, i, tag, x, None if x is None or rng.random() < 0.1 else float(i), int(x is not None)))
    return rows, spark.createDataFrame(rows, CELL)


@pytest.mark.parametrize(("length", "skip"), [(50, 4), (15, 0), (25, 3), (7, 7), (1, 0)])
def test_trails_are_the_positions_behind(spark, length, skip):
    rows, cells = tracks(spark)
    want, lines = {}, {}
    for _, _, i, tag, *_ in rows:
        if i > length + skip:
            behind = [(r[4], r[5], 1 if r[2] - (i - length) < 10 else 2 if r[2] - (i - length) < 20 else 3) for r in rows if r[3] == tag and i - length <= r[2] <= i - skip and r[4] is not None and r[5] is not None]
            want[tag, i] = behind
            lines |= {(tag, i, t): [p[:2] for p in behind if p[2] == t] for t in {p[2] for p in behind}}
    found = rec.trails(cells, length, skip).where("trail IS NOT NULL").collect()
    assert {(r["tag_id"], r["pos"]): [tuple(p) for p in r["trail"]] for r in found} == want
    drawn = render.render_plan(cells, None, None, render.RenderParams(length=length, skip=skip)).where("kind = 'trail'").collect()
    assert {(r["tag_id"], (r["frame"] - 1) // 3, r["thickness"]): [tuple(p) for p in r["points"]] for r in drawn} == lines and len(drawn) == len(lines)


def test_cells_are_read_once_and_lists_made_by_blocks(spark):
    cells = tracks(spark)[1]
    plan = plan_of(render.render_plan(cells))
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 2  # the cells, and the list of colours
    assert "RowFrame, -50, -4)" not in plan and plan_of(rec.trails(cells)).count("Sort [") == 1
