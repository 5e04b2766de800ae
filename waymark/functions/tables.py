"""Table functions and views for SQL text.

:func:`register` makes ``index_spec`` and ``preset_entries`` known to a session;
both are used in lateral joins.  :func:`publish` puts tables and what the
operators make of them under names that SQL joins, with functions over them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from waymark.operators import recordings as rec
from waymark.operators import trajectory as tr
from waymark.plans.clean import clean
from waymark.schema import CleanParams
from waymark.sources import parse_indices


def _text(argument: AnalyzeArgument, of: str) -> None:
    if not isinstance(argument.dataType, T.StringType | T.NullType):
        raise ValueError(f"{of} wants text, not {argument.dataType.simpleString()}")


@udtf
class IndexSpec:
    """``index_spec(spec [, count])``: the numbers of a spec such as ``0-4,10``, a row each; null gives none.

    A spec that isn't one, or goes beyond ``count``, gives a row with its ``error``.
    """

    @staticmethod
    def analyze(spec: AnalyzeArgument, count: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(spec, "index_spec")
        return AnalyzeResult(T.StructType().add("idx", T.IntegerType()).add("error", T.StringType()))

    def eval(self, spec: str | None, count: int | None = None) -> Iterator[tuple]:
        if spec is None:
            return
        try:
            found = parse_indices(spec, count)
        except ValueError as e:
            yield None, str(e)
            return
        for i in found:
            yield i, None


@udtf
class PresetEntries:
    """``preset_entries(preset)``: the entries of a preset's JSON object, nested objects under dotted names, a row each.

    ``number`` is null where a value isn't one, ``word`` where it is; what isn't
    a JSON object gives no rows.
    """

    @staticmethod
    def analyze(preset: AnalyzeArgument) -> AnalyzeResult:
        _text(preset, "preset_entries")
        return AnalyzeResult(T.StructType().add("key", T.StringType()).add("number", T.DoubleType()).add("word", T.StringType()))

    def eval(self, preset: str | None) -> Iterator[tuple]:
        try:
            doc = json.loads(preset or "")
        except ValueError:
            return
        if isinstance(doc, dict):
            yield from self._entries(doc, "")

    def _entries(self, doc: dict, under: str) -> Iterator[tuple]:
        for k, v in doc.items():
            if isinstance(v, dict):
                yield from self._entries(v, f"{under}{k}.")
            elif isinstance(v, int | float) and not isinstance(v, bool):
                yield under + k, float(v), None
            else:
                yield under + k, None, v if isinstance(v, str) else json.dumps(v)


def register(spark: SparkSession) -> None:
    spark.udtf.register("index_spec", IndexSpec)
    spark.udtf.register("preset_entries", PresetEntries)


_FUNCTIONS = {
    "track": "(src STRING, tag BIGINT) RETURNS TABLE (frame INT, center_x DOUBLE, center_y DOUBLE, ass_type INT) RETURN SELECT c.frame, c.center_x, c.center_y, c.ass_type FROM {p}cells c WHERE c.source = src AND c.tag_id = tag",
    "visible": "(src STRING, low INT, high INT) RETURNS TABLE (frame INT, n_visible BIGINT) RETURN SELECT c.frame, count(c.center_x) FROM {p}cells c WHERE c.source = src AND c.frame BETWEEN low AND high GROUP BY c.frame",
    "provenance": "(kind INT) RETURNS STRING RETURN CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'original' WHEN 2 THEN 'interpolated' WHEN 3 THEN 'box' END",
}


def publish(spark: SparkSession, detections: DataFrame, boxes: DataFrame | None = None, params: CleanParams = CleanParams(), prefix: str = "waymark_", min_gap: int = 10) -> None:
    """Temporary views ``cells``, ``metrics``, ``gaps``, ``trails``, ``detections`` and ``boxes``, and functions over them, all
    under ``prefix``: table functions ``track(source, tag)`` and ``visible(source, low, high)``, and ``provenance(kind)``.

    Views are plans, not tables: filters and columns of a query reach down to
    the detections.  Registers the table functions of :func:`register`, too.
    """
    register(spark)
    cells, metrics = clean(detections, boxes, params)
    views = {"detections": detections, "cells": cells, "metrics": metrics, "gaps": tr.gap_runs(cells, min_gap), "trails": rec.trails(cells)}
    if boxes is not None:
        views["boxes"] = boxes
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name} {body.format(p=prefix)}")
