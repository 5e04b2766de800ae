"""Looking along tracks: neighbours, the last known value before and the first known one after a row.

Rows of a track are scanned by windows of (source, tag).  Values are plain
columns, as buffers of structs are copied for every row.  What one direction
needs is computed in the order that rows have, then the other direction, so that
operators that follow each other sort once a turn (``way`` is the order in which
rows come).  Looking ahead is a running window in descending order: a frame
that shrinks towards the end would be scanned anew for every row.

A very long track is cut into ``slab`` positions: windows run within slabs, a
slab's edges (first and last row, first and last known values) are one summary
row, small windows carry the summaries along the track, and joins bring them
back.  No task then holds more than a slab.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.lineage import settle
from waymark.schema import TRACK

Values = dict[str, Column]


def look(
    rows: DataFrame, before: Values | None = None, after: Values | None = None, prev: Values | None = None, following: Values | None = None,
    order: tuple[str, ...] = ("pos",), way: str = "asc", slab: int | None = None,
) -> DataFrame:
    """``rows`` with a column for each name: of rows before, the last value that isn't null, of rows after, the first;
    ``prev`` and ``following`` are values of the neighbour rows, null or not.

    With ``slab``, slabs are cut along the first column of ``order`` and rows are settled first.
    """
    before, after, prev, following = before or {}, after or {}, prev or {}, following or {}
    if slab is not None:
        return _look_by_slabs(rows, before, after, prev, following, order, slab)
    return _windows(rows, TRACK, before, after, prev, following, order, way)


def _windows(rows: DataFrame, keys, before: Values, after: Values, prev: Values, following: Values, order, way: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) if way == "asc" else F.col(c).desc() for c in order])
    behind, ahead, passed, coming = (F.lag, F.lead, before, after) if way == "asc" else (F.lead, F.lag, after, before)
    over = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(f'{c} {way}' for c in order)}"
    next_known = {k: F.expr(f"lead(`{k}`) IGNORE NULLS OVER ({over})") for k in coming}
    beside = {k: behind(v).over(w) for k, v in prev.items()} | {k: ahead(v).over(w) for k, v in following.items()}
    running = {k: F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k, v in passed.items()}
    return rows.withColumns(coming).withColumns(beside | running | next_known)


def _look_by_slabs(rows: DataFrame, before: Values, after: Values, prev: Values, following: Values, order, slab: int) -> DataFrame:
    columns, at = rows.columns, F.struct(*order)
    named = {f"_v{k}": v for k, v in enumerate([*before.values(), *after.values(), *prev.values(), *following.values()])}
    settled = settle(rows.withColumn("_slab", F.floor(F.col(order[0]) / slab).cast("long")))
    held = settled.withColumns(named)  # values follow from the rows, so they are neither stored nor shuffled with them
    dealt = settled.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TRACK, "_slab").withColumns(named)
    names = [*before, *after, *prev, *following]
    of = dict(zip(names, named, strict=True))
    keys = [*TRACK, "_slab"]
    known = lambda n: F.when(F.col(of[n]).isNotNull(), at)
    edges = held.groupBy(*keys).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"),
        *[F.max_by(of[n], known(n)).alias(f"_e_{n}") for n in before], *[F.min_by(of[n], known(n)).alias(f"_e_{n}") for n in after],
        *[F.max_by(of[n], at).alias(f"_e_{n}") for n in prev], *[F.min_by(of[n], at).alias(f"_e_{n}") for n in following],
    )
    col = lambda ns: {f"_c_{n}": F.col(f"_e_{n}") for n in ns}
    carry = _windows(edges, TRACK, col(before), col(after), col(prev), col(following), ("_slab",), "asc")
    local = lambda ns: {n: F.col(of[n]) for n in ns}
    inside = _windows(dealt, keys, local(before), local(after), local(prev), local(following), order, "asc")
    joined = inside.join(carry.select(*keys, "_first", "_last", *[f"_c_{n}" for n in names]), keys)
    whole = {n: F.coalesce(n, f"_c_{n}") for n in (*before, *after)}
    whole |= {n: F.when(at == F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in prev}
    whole |= {n: F.when(at == F.col("_last"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in following}
    return joined.withColumns(whole).select(*columns, *names)
