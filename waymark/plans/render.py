"""What a renderer draws on each frame, as a table.

Pixels are left to it: an item has a kind, its points, a colour (blue, green,
red), a thickness and the order in which it is drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import recordings as rec
from waymark.operators.lineage import settle
from waymark.schema import CORNERS, ORIGINAL
from waymark.sources import COLORS, tag_colors

ITEM = ["source", "frame", "layer", "kind", "tag_id", "text", "points", "closed", "color", "thickness"]
LABEL, TRAIL, QUAD, BOX, STATE, DECODED = range(6)
#: Colours of boxes by their state.
STATES = {"decoded": "green", "inferred": "yellow", "open": "red"}


@dataclass(frozen=True)
class RenderParams:
    scale: float = 1.0
    text_scale: float = 1.0
    trails: bool = True
    length: int = 50
    skip: int = 4
    debug: bool = False
    highlight: tuple[int, ...] = ()
    highlight_color: tuple[int, int, int] = COLORS["red"]
    highlight_bold: bool = True


def _color(bgr: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(c) for v, c in zip(bgr, "bgr", strict=True)])


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def tag_palette(cells: DataFrame) -> DataFrame:
    """``color`` of every tag (source, tag_id): the n-th tag of each recording has the n-th colour."""
    tags = settle(cells.select("source", "tag_id").distinct()).withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("tag_id")) - 1)
    most = tags.agg(F.max("_n")).first()[0]
    colors = [(n, *bgr) for n, bgr in tag_colors(list(range((most if most is not None else -1) + 1))).items()]  # one row a tag of a recording
    named = cells.sparkSession.createDataFrame(colors, "_n int, b int, g int, r int")
    return tags.join(F.broadcast(named), "_n").select("source", "tag_id", F.struct("b", "g", "r").alias("color"))


def _rectangles(boxes: DataFrame, scale: float) -> Column:
    x1, y1, x2, y2 = (F.col(c) * scale for c in ("box_x1", "box_y1", "box_x2", "box_y2"))
    return F.array(_point(x1, y1), _point(x2, y1), _point(x2, y2), _point(x1, y2))


def _polygons(scale: float) -> Column:
    return F.array(*[_point(F.col(CORNERS[2 * k]) * scale, F.col(CORNERS[2 * k + 1]) * scale) for k in range(4)])


def render_plan(cells: DataFrame, boxes: DataFrame | None = None, quads: DataFrame | None = None, params: RenderParams = RenderParams()) -> DataFrame:
    """Items (``ITEM``) of every frame, drawn by ``layer``: labels and trails of tags, lone quads, undecoded boxes;
    with ``debug`` all boxes by their state instead, and the quads of original cells.

    Trails are one line a thickness.  ``boxes`` have ``decoded``.
    """
    p = params
    text = max(1, int(12 * p.scale * p.text_scale))
    bold = max(text + 1, round(text * 1.6)) if p.highlight_bold else text
    own = F.col("tag_id").isin(list(p.highlight)) if p.highlight else F.lit(False)
    x, y, aside = F.col("center_x") * p.scale, F.col("center_y") * p.scale, int(40 * p.scale)
    item = lambda df, layer, kind, points, closed, color, thickness, tag=F.lit(None).cast("long"), word=F.lit(None).cast("string"): df.select(
        "source", "frame", F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), tag.alias("tag_id"), word.alias("text"), points.alias("points"), F.lit(closed).alias("closed"), color.alias("color"), thickness.cast("int").alias("thickness"),
    )
    at = F.array(F.struct((x.cast("int") + aside).alias("x"), (y.cast("int") + aside).alias("y")))
    color = F.when(own, _color(p.highlight_color)).otherwise(_color(COLORS["black"]))
    entry = lambda layer, kind, word, points, color, thickness: F.struct(
        F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), word.alias("text"), points.alias("points"), color.alias("color"), thickness.cast("int").alias("thickness"),
    )
    drawn = [F.when(F.col("center_x").isNotNull(), entry(LABEL, "label", F.col("tag_id").cast("string"), at, color, F.when(own, bold).otherwise(text)))]
    rows = cells
    if p.trails:
        colors = tag_palette(cells).withColumnRenamed("color", "_color")
        rows, lines = rec.with_trail_lines(cells, _point(x, y), p.length, p.skip)
        rows = rows.join(colors, ["source", "tag_id"], "left")
        drawn += [F.when(F.col("_color").isNotNull() & line.isNotNull(), entry(TRAIL, "trail", F.lit(None).cast("string"), line, F.col("_color"), F.lit(t))) for t, line in lines.items()]
    # labels and lines in one go over the cells
    found = rows.select("source", "frame", "tag_id", F.explode(F.array(*drawn)).alias("i")).where("i IS NOT NULL")
    out = found.select("source", "frame", "i.layer", "i.kind", "tag_id", "i.text", "i.points", F.lit(False).alias("closed"), "i.color", "i.thickness")
    if quads is not None:
        out = out.unionByName(item(quads, QUAD, "quad", _polygons(p.scale), True, _color(COLORS["white"]), F.lit(1)))
    if boxes is not None and not p.debug:
        out = out.unionByName(item(boxes.where(~F.col("decoded")), BOX, "box", _rectangles(boxes, p.scale), True, _color(COLORS["yellow"]), F.lit(1)))
    if boxes is not None and p.debug:
        state = F.col("state")
        by_state = F.coalesce(*[F.when(state == s, _color(COLORS[c])) for s, c in STATES.items()])
        out = out.unionByName(item(rec.box_states(boxes, cells), STATE, "box", _rectangles(boxes, p.scale), True, by_state, F.lit(1)))
    if p.debug and all(c in cells.columns for c in CORNERS):
        decoded = cells.where((F.col("ass_type") == ORIGINAL) & F.col("c0x").isNotNull())
        out = out.unionByName(item(decoded, DECODED, "quad", _polygons(p.scale), True, _color(COLORS["green"]), F.lit(1), F.col("tag_id")))
    return out
