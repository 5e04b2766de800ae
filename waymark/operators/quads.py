"""Quads: thresholds, classification, review decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import functions as g
from waymark.operators import quantiles as q
from waymark.operators.near import near_pairs

RATIO_MIN, DEDUP_PX = 0.6, 10.0


def measured(quads: DataFrame) -> DataFrame:
    """Quads with area, smallest and largest angle and side, and side ratio."""
    q = quads.withColumns({"area": g.quad_area(), "_angles": g.quad_angles(), "_sides": g.quad_sides()})
    return q.withColumns({
        "angle_min": F.array_min("_angles"), "angle_max": F.array_max("_angles"),
        "side_min": F.array_min("_sides"), "side_max": F.array_max("_sides"), "ratio": g.side_ratio(F.col("_sides")),
    }).drop("_angles", "_sides")


def seed_thresholds(quads: DataFrame) -> DataFrame:
    """One row of limits: percentiles 1 and 99 of areas and angles, 0.1 and 99.9 of sides; null without quads."""
    values = quads.select(F.explode(F.concat(
        F.array(F.struct(F.lit("area").alias("measure"), g.quad_area().alias("v"))),
        F.transform(g.quad_angles(), lambda v: F.struct(F.lit("angle").alias("measure"), v.alias("v"))),
        F.transform(g.quad_sides(), lambda v: F.struct(F.lit("side").alias("measure"), v.alias("v"))),
    )).alias("m")).select("m.measure", "m.v")
    found = q.quantiles(values, ["measure"], "v", {"p1": 0.01, "p99": 0.99, "low": 0.001, "high": 0.999})
    of = lambda measure, c: F.max(F.when(F.col("measure") == measure, F.col(c)))
    return found.agg(
        of("area", "p1").alias("area_min"), of("area", "p99").alias("area_max"),
        of("angle", "p1").alias("angle_min"), of("angle", "p99").alias("angle_max"),
        of("side", "low").alias("side_min"), of("side", "high").alias("side_max"),
        F.lit(RATIO_MIN).alias("ratio_min"), F.lit(DEDUP_PX).alias("dedup_px"),
    )


def nearest_valid(quads: DataFrame, valid: DataFrame, radius: float = DEDUP_PX) -> DataFrame:
    """Quads with ``nearest``, the distance to the nearest valid centre (source, frame, center_x, center_y) within ``radius``; null if there is none."""
    own = quads.select("source", "frame", "quad_id", "center_x", "center_y").withColumn("_r", F.lit(float(radius)))
    met = near_pairs(own, valid.select("source", "frame", "center_x", "center_y").withColumn("_r", F.lit(float(radius))), ["source", "frame"], "_r")
    near = met.groupBy("source", "frame", "quad_id").agg(F.min("distance").alias("nearest"))
    return quads.join(near, ["source", "frame", "quad_id"], "left")


def classify(quads: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``verdict`` of measured quads: the first check failed (area, angle, side, dedup), or ok."""
    within = lambda c, a, b: F.col(c).between(limits[a], limits[b])
    verdict = (
        F.when(~within("area", "area_min", "area_max"), "area")
        .when(~((F.col("angle_min") >= limits["angle_min"]) & (F.col("angle_max") <= limits["angle_max"])), "angle")
        .when(~((F.col("side_min") >= limits["side_min"]) & (F.col("side_max") <= limits["side_max"])), "side")
        .when(F.col("ratio") < limits["ratio_min"], "side")
    )
    if "nearest" in quads.columns:
        verdict = verdict.when(F.coalesce(F.col("nearest") < limits["dedup_px"], F.lit(False)), "dedup")
    return quads.withColumn("verdict", verdict.otherwise("ok"))


def decided(quads: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("source", "frame", "quad_id")) -> DataFrame:
    """``kept`` of classified quads: a reviewer's exclude, then include, then the verdict.

    Overrides hold for the quads that have their ``keys``.
    """
    o = overrides.groupBy(*keys).agg(F.max(F.col("choice") == "exclude").alias("_out"), F.max(F.col("choice") == "include").alias("_in"))
    j = quads.join(o, list(keys), "left")
    return j.withColumn("kept", F.when(F.col("_out"), False).when(F.col("_in"), True).otherwise(F.col("verdict") == "ok")).drop("_out", "_in")
