"""Export of reviewed frames as a detector's data set.

A reviewer's session is JSON: by frame a status, and by quad what was decided
against the limits.  The decisions hold for the frame number in every
experiment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import functions as g
from waymark.operators import quads as qu
from waymark.operators.sampling import seeded_split
from waymark.schema import CORNERS
from waymark.sources import files

SESSION = "frames map<string, struct<status: string, enhance: boolean, overrides: map<string, string>>>"


def decisions(sessions: DataFrame, column: str = "value") -> DataFrame:
    """One row a decided frame of JSON sessions: frame, status, enhance and the map of ``overrides``; what isn't JSON gives none.

    Other columns of ``sessions`` stay.
    """
    read = F.from_json(column, SESSION)["frames"]
    rest = [c for c in sessions.columns if c != column]
    each = sessions.select(*rest, F.explode(F.map_entries(read)).alias("e"))
    made = each.select(*rest, F.col("e.key").cast("int").alias("frame"), "e.value.status", F.coalesce("e.value.enhance", F.lit(False)).alias("enhance"), F.coalesce("e.value.overrides", F.expr("map()").cast("map<string,string>")).alias("overrides"))
    return made.where("frame IS NOT NULL")


def override_rows(decided: DataFrame) -> DataFrame:
    """The overrides of decided frames as rows (.., frame, quad_id, choice)."""
    rest = [c for c in decided.columns if c not in ("status", "enhance", "overrides")]
    return decided.select(*rest, F.explode(F.map_entries("overrides")).alias("o")).select(*rest, F.col("o.key").cast("long").alias("quad_id"), F.col("o.value").alias("choice"))


def by_names(share: float, seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A split of pictures (name) by a seeded shuffle of their sorted names, which a reviewer's list is small enough for."""

    def split(pictures: DataFrame) -> DataFrame:
        _, val = seeded_split(sorted(r["name"] for r in pictures.select("name").distinct().collect()), share, seed)
        return pictures.withColumn("part", F.when(F.col("name").isin(val), "val").otherwise("train"))

    return split


def accepted_pictures(experiments: DataFrame, decided: DataFrame, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Accepted frames of every experiment (experiment, width, height ..), named and with their ``part``; both are lists that people made."""
    accepted = decided.where("status = 'accepted'").select("frame").distinct()
    every = experiments.join(F.broadcast(accepted), F.lit(True))
    return split(every.withColumn("name", F.format_string("%s_%06d", "experiment", "frame")))


def kept_quads(candidates: DataFrame, pictures: DataFrame, decided: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Quads (experiment, frame, quad_id, corners) of the pictures that the limits and the reviewer keep, with the picture's columns.

    Decisions meet the quads by frame and number, so they aren't copied to the experiments.
    """
    quads = candidates.join(pictures, ["experiment", "frame"])
    return qu.decided(qu.classify(qu.measured(quads), limits), override_rows(decided), ("frame", "quad_id")).where("kept")


def label_lines(quads: DataFrame, oriented: bool = True) -> DataFrame:
    """A label line a kept quad: part, name, ``n`` (the quad's number) and line."""
    line = (g.obb_line if oriented else g.axis_line)(F.lit(0), CORNERS, F.col("width").cast("double"), F.col("height").cast("double"))
    return quads.select("part", "name", F.col("quad_id").alias("n"), line.alias("line"))


def _shape(label: str) -> Column:
    points = F.array(*[F.array(F.col(CORNERS[2 * k]).cast("double"), F.col(CORNERS[2 * k + 1]).cast("double")) for k in range(4)])
    nothing = F.expr("map()").cast("map<string,string>")
    return F.struct(
        F.lit(label).alias("label"), F.lit(1.0).alias("score"), points.alias("points"), F.lit(None).cast("int").alias("group_id"), F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("difficult"), F.lit("rotation").alias("shape_type"), g.rotation_direction().alias("direction"), nothing.alias("flags"), nothing.alias("attributes"),
    )


def json_labels(quads: DataFrame, pictures: DataFrame, label: str = "tag", version: str = "3.3.5") -> DataFrame:
    """A JSON document a picture for label editors: file, content, src_path."""
    per = _shapes(quads, label)
    j = pictures.join(per, "name", "left")
    none = F.array().cast(per.schema["shapes"].dataType)
    doc = F.struct(
        F.lit(version).alias("version"), F.expr("map()").cast("map<string,string>").alias("flags"), F.coalesce("shapes", none).alias("shapes"), F.concat("name", F.lit(".jpg")).alias("imagePath"),
        F.lit(None).cast("string").alias("imageData"), F.col("height").alias("imageHeight"), F.col("width").alias("imageWidth"),
    )
    return j.select(F.format_string("%s/images/%s.json", "part", "name").alias("file"), F.to_json(doc, {"ignoreNullFields": "false"}).cast("binary").alias("content"), F.lit(None).cast("string").alias("src_path"))


def _shapes(quads: DataFrame, label: str) -> DataFrame:
    """Shapes of each picture in the order of its quads; a struct with maps can't be sorted, its place can."""
    rows = quads.select("name", "quad_id", _shape(label).alias("s"))
    per = rows.groupBy("name").agg(F.collect_list("quad_id").alias("_n"), F.map_from_entries(F.collect_list(F.struct("quad_id", "s"))).alias("_of"))
    return per.select("name", F.transform(F.array_sort("_n"), lambda n: F.element_at("_of", n)).alias("shapes"))


def review_export(
    candidates: DataFrame, experiments: DataFrame, decided: DataFrame, limits: dict[str, float], split: Callable[[DataFrame], DataFrame], oriented: bool = True, json: bool = False, images: str | None = None,
) -> DataFrame:
    """All files of the data set (file, content, src_path) for :func:`files.write_files`: a label file a picture, with
    ``json`` a JSON document, and with ``images`` (a pattern with experiment and frame) a copy of its image."""
    pictures = accepted_pictures(experiments, decided, split)
    quads = kept_quads(candidates, pictures, decided, limits)
    out = files.label_files(label_lines(quads, oriented), pictures)
    if json:
        out = out.unionByName(json_labels(quads, pictures))
    if images:
        out = out.unionByName(pictures.select(F.format_string("%s/images/%s.jpg", "part", "name").alias("file"), F.lit(None).cast("binary").alias("content"), F.format_string(images, "experiment", "frame").alias("src_path")))
    return out
