"""Live counts of visible tags, steps between detections, and forward matching, on streams.

Batch stays the source of truth: interpolation, the backward pass and pruning
need frames to come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def visible_per_window(detections: DataFrame, time: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Detections and roughly distinct tags in tumbling windows; rows later than ``late`` are dropped."""
    w = detections.withWatermark(time, late).groupBy("source", F.window(time, width).alias("w"))
    return w.agg(F.count("*").alias("n_detections"), F.approx_count_distinct("tag_id").alias("n_tags")).select("source", F.col("w.start").alias("window_start"), "n_detections", "n_tags")


_STATE = "frame array<int>, tag array<long>, x array<double>, y array<double>"
_STEP = "source string, frame int, tag_id long, center_x double, center_y double, step double"


def live_steps(detections: DataFrame) -> DataFrame:
    """Each detection with the distance to its tag's last one, kept as state by source.

    Within a batch rows go in frame order; a row older than the state gets a null
    step.  The state has one entry a tag.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {t: (f, x, y) for f, t, x, y in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["frame", "tag_id"], kind="stable")
        steps = []
        for f, t, x, y in rows[["frame", "tag_id", "center_x", "center_y"]].itertuples(index=False):
            before = last.get(t)
            fresh = before is None or f > before[0]
            steps.append(((x - before[1]) ** 2 + (y - before[2]) ** 2) ** 0.5 if before and fresh else None)
            if fresh:
                last[t] = (f, x, y)
        state.update(([int(v[0]) for v in last.values()], [int(t) for t in last], [float(v[1]) for v in last.values()], [float(v[2]) for v in last.values()]))
        yield rows.assign(source=key[0], step=steps)[["source", "frame", "tag_id", "center_x", "center_y", "step"]]

    return detections.groupBy("source").applyInPandasWithState(step, _STEP, _STATE, "append", GroupStateTimeout.NoTimeout)


_EVENTS = "frame int, ms long, is_box boolean, id long, x double, y double"
_ANCHORS = "tag_id long, frame int, x double, y double"
LIVE_FILLS = "source string, frame int, tag_id long, box_id long, center_x double, center_y double, distance double"


class ForwardMatching(StatefulProcessor):
    """The forward pass of chain filling, frame by frame as frames become complete.

    State of a source: events of frames that aren't complete yet, and each tag's
    anchor while a chain can still go on from it.  A frame is complete when the
    watermark passes its time: an event-time timer then matches its open tags
    and boxes as the batch does, nearest pairs first, then by tag, then by box.
    """

    def __init__(self, reach: float, max_misses: int = 10, limit: int = 0):
        self.reach = reach
        self.within = min(max(max_misses, 1), limit + 1) if limit > 0 else max(max_misses, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENTS)
        self.anchors = handle.getListState("anchors", _ANCHORS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ms = (batch["ts"].astype("int64") // {"s": 10**-3, "ms": 1, "us": 10**3, "ns": 10**6}[np.datetime_data(batch["ts"].dtype)[0]]).astype("int64")
            events = list(zip(batch["frame"].tolist(), ms.tolist(), batch["is_box"].tolist(), batch["id"].tolist(), batch["center_x"].tolist(), batch["center_y"].tolist(), strict=True))
            self.events.appendList(events)
            for at in set(ms.tolist()):
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        events = list(self.events.get()) if self.events.exists() else []
        due = sorted((e for e in events if e[1] <= until), key=lambda e: e[0])
        anchors = {a[0]: (a[1], a[2], a[3]) for a in self.anchors.get()} if self.anchors.exists() else {}
        made, k = [], 0
        while k < len(due):
            frame, here = due[k][0], []
            while k < len(due) and due[k][0] == frame:
                here.append(due[k])
                k += 1
            made += self._frame(key[0], frame, here, anchors)
        last = max((e[0] for e in due), default=0)
        self._keep(self.events, [e for e in events if e[1] > until])
        self._keep(self.anchors, [(t, *a) for t, a in anchors.items() if last - a[0] < self.within])
        if made:
            yield pd.DataFrame(made, columns=[c.split()[0] for c in LIVE_FILLS.split(", ")])

    @staticmethod
    def _keep(state, rows: list) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()  # a list in the store isn't empty

    def _frame(self, source: str, frame: int, events: list, anchors: dict) -> list[tuple]:
        seen = {}
        for e in sorted((e for e in events if not e[2]), key=lambda e: e[3]):
            seen.setdefault(e[3], (frame, e[4], e[5]))
        anchors.update(seen)
        boxes = sorted(((e[3], e[4], e[5]) for e in events if e[2]), key=lambda b: b[0])
        tags = [t for t in sorted(anchors) if t not in seen and frame - anchors[t][0] <= self.within]
        if not tags or not boxes:
            return []
        at, to = np.array([anchors[t][1:] for t in tags], float), np.array([b[1:] for b in boxes], float)
        gap = at[:, None, :] - to[None, :, :]
        distance = np.sqrt((gap * gap).sum(-1))
        a, b = np.nonzero(distance <= self.reach)
        made, matched, used = [], set(), set()
        for k in np.lexsort((b, a, distance[a, b])):
            i, j = int(a[k]), int(b[k])
            if i not in matched and j not in used:
                matched.add(i)
                used.add(j)
                made.append((source, frame, tags[i], *boxes[j], float(distance[i, j])))
                anchors[tags[i]] = (frame, *boxes[j][1:])
        return made

    def close(self) -> None:
        pass


def live_fills(events: DataFrame, reach: float, max_misses: int = 10, limit: int = 0, late: str = "10 seconds") -> DataFrame:
    """Fills (``LIVE_FILLS``) of a stream of events: source, frame, ``ts``, is_box, ``id`` (of the tag or box), center_x, center_y.

    A frame's events share their ``ts``, and later frames have later ones; what
    comes over ``late`` after its time is dropped.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = events.withWatermark("ts", late).groupBy("source")
    return keyed.transformWithStateInPandas(ForwardMatching(reach, max_misses, limit), LIVE_FILLS, "append", "eventTime")
