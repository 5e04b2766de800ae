"""Kernels with boxes on a whole table, against plain loops over dictionaries."""

import math
import os
from collections import defaultdict

import pytest

from waymark import catalog
from waymark.operators import chains
from waymark.operators import matching as mt
from waymark.operators import metrics as me
from waymark.operators import trajectory as tr
from waymark.operators.lineage import settle
from waymark.plans.clean import clean_cells
from waymark.schema import CleanParams
from waymark.sources import views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
NONE, ORIGINAL, INTERPOLATED, INFERRED = range(4)


class Loops:
    """One recording: ``at[tag][pos]`` is [x, y, kind], and boxes by position in the order of their ids."""

    def __init__(self, cells, boxes, reach):
        self.at, self.reach = defaultdict(dict), reach
        for r in cells:
            self.at[r["tag_id"]][r["pos"]] = [r["center_x"], r["center_y"], r["ass_type"]]
        self.tags, self.last = sorted(self.at), max((p for t in self.at.values() for p in t), default=-1)
        self.boxes = defaultdict(list)
        for b in sorted(boxes, key=lambda b: b["box_id"]):
            if 0 <= b["frame"] <= self.last:
                self.boxes[b["frame"]].append((b["box_id"], b["center_x"], b["center_y"]))

    def chain(self, direction, taken=None, banned=frozenset(), allowed=None, misses_most=10):
        anchor, misses, fills = {}, {}, []
        for pos in range(self.last + 1) if direction == "forward" else range(self.last, -1, -1):
            waiting = []
            for t in self.tags:
                x, y, kind = self.at[t][pos]
                if kind in (ORIGINAL, INFERRED):
                    anchor[t], misses[t] = (x, y), 0
                elif t in anchor and (allowed is None or t in allowed):
                    waiting.append(t)
            pairs = []
            for t in waiting:
                for k, (box, x, y) in enumerate(self.boxes[pos]):
                    d = math.sqrt((anchor[t][0] - x) ** 2 + (anchor[t][1] - y) ** 2)
                    if d <= self.reach and (t, box) not in banned:
                        pairs.append((d, t, k, box, x, y))
            matched, used = set(), set()
            for d, t, _, box, x, y in sorted(pairs):
                if t in matched or box in used or (taken is not None and box in taken):
                    continue
                self.at[t][pos] = [x, y, INFERRED]
                fills.append((t, pos, box, direction, round(d, 9)))
                anchor[t], misses[t] = (x, y), 0
                matched.add(t)
                used.add(box)
                if taken is not None:
                    taken.add(box)
            for t in waiting:
                if t not in matched:
                    misses[t] += 1
                    if misses[t] >= misses_most:
                        del anchor[t]
        return fills

    def in_use(self):
        spots = {(p, c[0], c[1]) for t in self.tags for p, c in self.at[t].items() if c[2] == INFERRED}
        return {box for p, bs in self.boxes.items() for box, x, y in bs if (p, x, y) in spots}

    def prune(self, fills):
        """Clear the stretch between originals around each claim on a box that two tags claimed; the cleared, the bans and the tags."""
        by_box = defaultdict(set)
        for t, pos, box, *_ in fills:
            by_box[pos, box].add(t)
        claims = {(t, pos, box) for t, pos, box, *_ in fills if len(by_box[pos, box]) > 1}
        cleared = set()
        for t, pos, _ in claims:
            if self.at[t][pos][2] == ORIGINAL:
                continue
            for step in (-1, 1):
                p = pos
                while 0 <= p <= self.last and self.at[t][p][2] != ORIGINAL:
                    cleared.add((t, p))
                    p += step
        for t, p in cleared:
            self.at[t][p] = [None, None, NONE]
        return cleared, {(t, box) for t, _, box in claims}, {t for t, _ in cleared}

    def recover(self, min_gap=10):
        taken, before, fills = self.in_use(), {t: {p: list(c) for p, c in self.at[t].items()} for t in self.tags}, []
        for t in self.tags:
            known = [p for p in range(self.last + 1) if before[t][p][0] is not None]
            for left, right in zip(known, known[1:], strict=False):
                if right - left - 1 <= min_gap:
                    continue
                here = {}
                for way, start, stop in ((1, left, right), (-1, right, left)):
                    x, y = before[t][start][:2]
                    vx = vy = 0.0
                    behind = start - way
                    if 0 <= behind <= self.last and before[t][behind][0] is not None:
                        vx, vy = x - before[t][behind][0], y - before[t][behind][1]
                    for pos in range(start + way, stop, way):
                        new = here.get(pos)
                        if new is None:
                            free = [(math.hypot(bx - (x + vx), by - (y + vy)), k, box, bx, by) for k, (box, bx, by) in enumerate(self.boxes[pos]) if math.hypot(bx - x, by - y) <= self.reach and box not in taken]
                            if free:
                                _, _, box, bx, by = min(free)
                                taken.add(box)
                                fills.append((t, pos, box, "forward" if way > 0 else "backward", round(math.hypot(bx - x, by - y), 9)))
                                self.at[t][pos] = [bx, by, INFERRED]
                                new = (bx, by)
                        if new is not None:
                            here[pos] = new
                            vx, vy = way * (new[0] - x), way * (new[1] - y)
                            x, y = new
        return fills

    def interpolate(self, limit):
        for t in self.tags:
            known = [p for p in range(self.last + 1) if self.at[t][p][0] is not None]
            for a, b in zip(known, known[1:], strict=False):
                (ax, ay, _), (bx, by, _) = self.at[t][a], self.at[t][b]
                for p in range(a + 1, b):
                    if p - a <= limit or b - p <= limit:
                        self.at[t][p] = [ax + (bx - ax) * (p - a) / (b - a), ay + (by - ay) * (p - a) / (b - a), INTERPOLATED if self.at[t][p][2] == NONE else self.at[t][p][2]]

    def drop_jumps(self, most):
        for t in self.tags:
            c = self.at[t]
            far = lambda p, c=c: p > 0 and c[p][0] is not None and c[p - 1][0] is not None and math.sqrt((c[p][0] - c[p - 1][0]) ** 2 + (c[p][1] - c[p - 1][1]) ** 2) > most
            over = [far(p) for p in range(self.last + 1)]
            cut, p = set(), 0
            while p <= self.last:
                if not over[p]:
                    p += 1
                    continue
                end = p
                while end <= self.last and over[end]:
                    end += 1
                originals = [q for q in range(p, end) if c[q][2] == ORIGINAL]
                cut.update(q for q in range(p, end) if not originals or q != originals[-1])
                if p and c[p - 1][2] == INTERPOLATED:
                    cut.add(p - 1)
                p = end
            for q in cut:
                c[q] = [None, None, NONE]


@pytest.fixture(scope="module")
def tables(spark):
    params = CleanParams(**(catalog.PARAMS.__dict__ | {"min_detections": 100}))
    found = views.detections(spark, DATA)
    cells = settle(mt.with_reach(clean_cells(found, None, params).drop("distance"), me.pixel_scale(found), 2.0))
    return settle(tr.step_distance(cells)), settle(views.boxes(spark, DATA)), found


def loops(tables):
    cells, boxes = tables[0].collect(), tables[1].collect()
    sources = sorted({r["source"] for r in cells})
    return {s: Loops([r for r in cells if r["source"] == s], [b for b in boxes if b["source"] == s], next(r["reach"] for r in cells if r["source"] == s)) for s in sources}


def fills_of(df):
    return sorted((r["source"], r["tag_id"], r["pos"], r["box_id"], r["direction"], round(r["distance"], 9)) for r in df.collect())


def test_chain_prune_and_rechain(spark, tables):
    cells, boxes, _ = tables
    fills = settle(mt.chain_fill(cells, boxes))
    plain = loops(tables)
    first = {s: r.chain("forward") + r.chain("backward") for s, r in plain.items()}
    assert fills_of(fills) == sorted((s, *f) for s, fs in first.items() for f in fs) and sum(map(len, first.values())) > 300
    pruned, bans = mt.prune_ambiguous(mt.apply_fills(cells, fills), mt.ambiguous_claims(fills))
    pruned = settle(pruned)
    cut = {s: r.prune(first[s]) for s, r in plain.items()}
    assert sorted((r["source"], r["tag_id"], r["pos"]) for r in pruned.where("n_pruned = 1").collect()) == sorted((s, *c) for s, (cleared, _, _) in cut.items() for c in cleared)
    assert sorted(tuple(r) for r in bans.select("source", "tag_id", "box_id").collect()) == sorted((s, *b) for s, (_, banned, _) in cut.items() for b in banned)
    assert sum(len(c[0]) for c in cut.values()) > 20
    again = mt.rechain(pruned.drop("allowed"), mt.ban_boxes(boxes, bans))
    want = []
    for s, r in plain.items():
        taken = r.in_use()
        want += [(s, *f) for way in ("forward", "backward") for f in r.chain(way, taken, cut[s][1])]
    assert fills_of(again) == sorted(want)
    assert fills_of(chains.rechain(pruned.drop("allowed"), boxes, settle(bans))) == sorted(want)


def test_rechain_of_affected_tags_only(spark, tables):
    cells, boxes, _ = tables
    fills = settle(mt.chain_fill(cells, boxes))
    pruned, bans = mt.prune_ambiguous(mt.apply_fills(cells, fills), mt.ambiguous_claims(fills))
    plain, want = loops(tables), []
    for s, r in plain.items():
        made = r.chain("forward") + r.chain("backward")
        _, banned, affected = r.prune(made)
        taken = r.in_use()
        want += [(s, *f) for way in ("forward", "backward") for f in r.chain(way, taken, banned, affected)]
    assert fills_of(mt.rechain(pruned, mt.ban_boxes(boxes, bans))) == sorted(want)


def test_long_gap_recovery(spark, tables):
    cells, boxes, _ = tables
    want = sorted((s, *f) for s, r in loops(tables).items() for f in r.recover())
    assert fills_of(mt.recover_long_gaps(cells, boxes)) == want and len(want) > 40
    assert fills_of(chains.recover_long_gaps(cells, boxes)) == want


@pytest.mark.parametrize("recover", [True, False])
def test_the_whole_plan(spark, tables, recover):
    _, boxes, found = tables
    params = CleanParams(**(catalog.PARAMS.__dict__ | {"min_detections": 100, "recover_long_gaps": recover, "final_jump_pass": recover}))
    got = {(r["source"], r["tag_id"], r["pos"]): (r["center_x"], r["center_y"], r["ass_type"]) for r in clean_cells(found, boxes, params).collect()}
    kept = settle(tr.stamp_original(tr.min_detections(tr.dense_grid(tr.resolve_duplicates(found), params.n_frames), params.min_detections)))
    reach = {r["source"]: 2.0 * r["tag_px"] for r in me.pixel_scale(found).collect()}
    rows, box_rows = kept.collect(), boxes.collect()
    n = 0
    for s in sorted({r["source"] for r in rows}):
        r = Loops([x for x in rows if x["source"] == s], [b for b in box_rows if b["source"] == s], reach[s])
        r.interpolate(params.interp_limit)
        r.drop_jumps(params.max_jump)
        _, banned, _ = r.prune(r.chain("forward") + r.chain("backward"))
        taken = r.in_use()
        for way in ("forward", "backward"):
            r.chain(way, taken, banned)
        r.drop_jumps(params.max_jump)
        if recover:
            r.recover(params.min_gap)
            r.drop_jumps(params.max_jump)
        r.interpolate(params.interp_limit)
        for t in r.tags:
            for p, (x, y, kind) in r.at[t].items():
                gx, gy, gk = got[s, t, p]
                assert gk == kind and (x is None) == (gx is None) and (x is None or abs(x - gx) < 1e-9 and abs(y - gy) < 1e-9), (s, t, p, got[s, t, p], (x, y, kind))
                n += 1
    assert n == len(got)
