"""Column functions: geometry of boxes and quads, scores, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.schema import CORNERS


def box_center(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]


def corner_points(columns=CORNERS) -> Column:
    """Corners as an array of (x, y) structs."""
    return F.array(*[F.struct(F.col(columns[k]).alias("x"), F.col(columns[k + 1]).alias("y")) for k in range(0, 8, 2)])


def legacy_corner(nested: Column, corner: int, axis: int) -> Column:
    """One coordinate of corners stored as nested arrays; null if the shape is wrong."""
    ok = (F.size(nested) == 4) & F.forall(nested, lambda p: F.size(p) == 2)
    value = F.get(F.get(nested, F.lit(corner)), F.lit(axis)).cast("double")
    return F.when(ok & ~F.isnan(value), value)


def _xy(columns) -> tuple[list[Column], list[Column]]:
    return [F.col(c).cast("double") for c in columns[::2]], [F.col(c).cast("double") for c in columns[1::2]]


def quad_area(columns=CORNERS) -> Column:
    """Shoelace area."""
    x, y = _xy(columns)
    return F.abs(reduce(lambda a, b: a + b, [x[k] * y[(k + 1) % 4] - x[(k + 1) % 4] * y[k] for k in range(4)])) / 2


def quad_sides(columns=CORNERS) -> Column:
    x, y = _xy(columns)
    return F.array(*[F.sqrt((x[(k + 1) % 4] - x[k]) * (x[(k + 1) % 4] - x[k]) + (y[(k + 1) % 4] - y[k]) * (y[(k + 1) % 4] - y[k])) for k in range(4)])


def quad_angles(columns=CORNERS) -> Column:
    """Inner angles in degrees; null at a corner with a side of length 0."""
    x, y = _xy(columns)
    out = []
    for k in range(4):
        ax, ay, bx, by = x[k - 1] - x[k], y[k - 1] - y[k], x[(k + 1) % 4] - x[k], y[(k + 1) % 4] - y[k]
        norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        cosine = F.greatest(F.least((ax * bx + ay * by) / F.when(norm > 0, norm), F.lit(1.0)), F.lit(-1.0))
        out.append(F.degrees(F.acos(cosine)))
    return F.array(*out)


def side_ratio(sides: Column) -> Column:
    """Shortest side over longest; 0 if all are 0."""
    longest = F.array_max(sides)
    return F.when(longest > 0, F.array_min(sides) / longest).otherwise(0.0)


def rotation_direction(columns=CORNERS) -> Column:
    """Direction from the first corner to the second, in [0, 2 pi)."""
    x, y = _xy(columns)
    return F.pmod(F.atan2(y[1] - y[0], x[1] - x[0]), F.lit(2 * 3.141592653589793))


def obb_line(class_id: Column, columns, width: Column, height: Column) -> Column:
    """Label line of an oriented box: class and normalised corners with six decimals."""
    x, y = _xy(columns)
    values = [v for k in range(4) for v in (x[k] / width, y[k] / height)]
    return F.format_string("%d" + " %.6f" * 8, class_id, *values)


def axis_line(class_id: Column, columns, width: Column, height: Column) -> Column:
    """Label line of the upright box around a quad: class, centre and size, normalised."""
    x, y = _xy(columns)
    lo_x, hi_x, lo_y, hi_y = F.least(*x), F.greatest(*x), F.least(*y), F.greatest(*y)
    return F.format_string("%d" + " %.6f" * 4, class_id, (lo_x + hi_x) / 2 / width, (lo_y + hi_y) / 2 / height, (hi_x - lo_x) / width, (hi_y - lo_y) / height)


def recall_score(recall: Column, false_rate: Column, hallucination_rate: Column, difficulty: Column, ms: Column | None = None, speed_weight: float = 0.0, floor: float = 0.05) -> Column:
    """Recall with penalties; time counts only above the recall floor."""
    base = recall - 0.1 * false_rate - 0.05 * hallucination_rate + 0.02 * difficulty
    return base if ms is None else base - F.when(recall > floor, speed_weight * ms / 100.0).otherwise(0.0)


def yield_score(hits: Column, multi: Column, n: Column) -> Column:
    return F.when(n > 0, hits / n - 0.2 * multi / n).otherwise(0.0)


def image_score(distinct: Column, duplicates: Column) -> Column:
    return distinct - 0.2 * duplicates


def max_tag_id(family: Column) -> Column:
    """Highest id taken for real: the default family has 238 ids, others are left wide."""
    return F.when(family == "tag36ARTag", 237).otherwise(999)


def video_key(parent: Column, stem: Column) -> Column:
    return F.concat_ws("__", parent, stem)


def crop_name(frame: Column, crop: Column) -> Column:
    return F.format_string("f%06d_c%03d", frame, crop)


def mm(pixels: Column, mm_per_px: Column) -> Column:
    return pixels * mm_per_px


def duration_text(seconds: Column) -> Column:
    """``7.3s`` under a minute, else ``4m 05s`` or ``2h 04m 05s``."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    minutes = F.format_string("%dm %02ds", m, rest)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(h > 0, F.format_string("%dh %02dm %02ds", h, m, rest)).otherwise(minutes)


def _clock(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds).cast("long"), F.lit(0))
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def progress_line(current: Column, total: Column, elapsed: Column) -> Column:
    """``current/total [elapsed<remaining, rate it/s]``; without elapsed time the rate is 0."""
    rate = F.when(elapsed > 0, current / F.nullif(elapsed, F.lit(0.0))).otherwise(0.0)
    left = F.when((rate > 0) & (total > current), (total - current) / F.nullif(rate, F.lit(0.0))).otherwise(0.0)
    return F.format_string("%d/%d [%s<%s, %.2fit/s]", current, total, _clock(elapsed), _clock(left), rate)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
