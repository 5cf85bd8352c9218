"""Polygons with holes as columns: boolean operations, repair, cuts, clipping and snapping.

A column of polygons is array<struct<shell: ring, holes: array<ring>>>, its rings closed. Kernels run on Arrow batches.
Null polygons give null; empty ones are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maploom.functions import geometry, overlay

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
POLYGONS = T.ArrayType(T.StructType([T.StructField("shell", RING), T.StructField("holes", T.ArrayType(RING))]))
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_POLYGON = pa.struct([("shell", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT)))])


def rings_of(lists: pa.ListArray) -> list[np.ndarray]:
    """Each closed ring without its last point."""
    points, ends = lists.values, lists.offsets.to_numpy()
    flat = np.column_stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)])
    return [flat[a : b - 1 if b - a > 1 and (flat[a] == flat[b - 1]).all() else b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decoded(column: pa.Array) -> list[list[overlay.Polygon] | None]:
    """An Arrow column of polygons as what overlay takes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts, ends = column.values, column.offsets.to_numpy()
    holes = parts.field("holes")
    shells, inner, places = rings_of(parts.field("shell")), rings_of(holes.values), holes.offsets.to_numpy().tolist()
    polygons = [(s, inner[a:b]) for s, a, b in zip(shells, places, places[1:], strict=False)]
    return [polygons[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def _encoded_rings(rings: list[np.ndarray]) -> pa.Array:
    closed = [np.concatenate([r, r[:1]]) for r in rings]
    flat = np.concatenate([np.zeros((0, 2)), *closed])
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_POINT))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, closed)]), pa.int32()), points)


def encoded(geometries: list[list[overlay.Polygon] | None]) -> pa.Array:
    polygons = [p for g in geometries if g for p in g]
    holes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(h) for _, h in polygons)]), pa.int32()), _encoded_rings([h for _, own in polygons for h in own]))
    parts = pa.StructArray.from_arrays([_encoded_rings([s for s, _ in polygons]), holes], fields=list(_POLYGON))
    ends = np.cumsum([0, *(len(g or ()) for g in geometries)])
    mask = pa.array([g is None for g in geometries], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, mask=mask)


def kernel(kind: T.DataType):
    """An Arrow function of this type that Spark neither repeats nor moves into filters: to it, each call may differ."""
    return lambda run: F.arrow_udf(run, kind).asNondeterministic()


def _combined(one: pa.Array, two: pa.Array, inside) -> list[list[overlay.Polygon] | None]:
    """overlay.combined of each two, a batch at a time; null where either is."""
    pairs = [None if a is None or b is None else (a, b) for a, b in zip(decoded(one), decoded(two), strict=True)]
    known = [p for p in pairs if p is not None]
    found = iter(overlay.combined_each([a for a, _ in known], [b for _, b in known], inside))
    return [None if p is None else next(found) for p in pairs]


def _both(inside):
    @kernel(POLYGONS)
    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        return encoded(_combined(one, two, inside))

    return run


_intersection, _difference, _union = _both(np.logical_and), _both(lambda a, b: a & ~b), _both(np.logical_or)


def _repaired_each(geometries: list[list[overlay.Polygon] | None]) -> list[list[overlay.Polygon] | None]:
    found = iter(overlay.repaired_each([g for g in geometries if g is not None]))
    return [None if g is None else next(found) for g in geometries]


@kernel(POLYGONS)
def _repaired(polygons: pa.Array) -> pa.Array:
    return encoded(_repaired_each(decoded(polygons)))


def _mended(rows: DataFrame, column: str) -> DataFrame:
    """rows with the polygons of a column repaired where they are not valid; all columns pass through Arrow."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = decoded(batch.column(at))
            broken = iter(~overlay.is_valid_each([g for g in own if g is not None]))
            wrong = [g is not None and bool(next(broken)) for g in own]
            mended = iter(overlay.repaired_each([g for g, w in zip(own, wrong, strict=True) if w]))
            fixed = encoded([next(mended) if w else g for g, w in zip(own, wrong, strict=True)])
            yield pa.RecordBatch.from_arrays([fixed if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


@kernel(T.BooleanType())
def _valid(polygons: pa.Array) -> pa.Array:
    own = decoded(polygons)
    valid = iter(overlay.is_valid_each([g for g in own if g is not None]).tolist())
    return pa.array([None if g is None else next(valid) for g in own], pa.bool_())


@kernel(T.DoubleType())
def _common_area(one: pa.Array, two: pa.Array) -> pa.Array:
    both = _combined(one, two, np.logical_and)
    areas = overlay.area_each([g or [] for g in both])
    return pa.array(areas, mask=np.array([g is None for g in both], bool))


def polygon(ring: Column, holes: Column | None = None) -> Column:
    """One polygon of a ring and an array of rings, which need not be closed."""
    inner = F.array().cast(T.ArrayType(RING)) if holes is None else F.transform(holes, geometry.closed)
    return F.array(F.struct(geometry.closed(ring).alias("shell"), inner.alias("holes"))).cast(POLYGONS)


def intersection(one: Column, two: Column) -> Column:
    return _intersection(one, two)


def difference(one: Column, two: Column) -> Column:
    return _difference(one, two)


def union(one: Column, two: Column) -> Column:
    return _union(one, two)


def repaired(polygons: Column) -> Column:
    """Valid polygons of the same place (overlay.repaired)."""
    return _repaired(polygons)


def is_valid(polygons: Column) -> Column:
    return _valid(polygons)


def common_area(one: Column, two: Column) -> Column:
    return _common_area(one, two)


def area(polygons: Column) -> Column:
    """Shells less holes."""
    ring = lambda r: F.abs(geometry.signed_area(r))
    own = lambda p: ring(p["shell"]) - F.aggregate(p["holes"], F.lit(0.0), lambda acc, h: acc + ring(h))
    return F.aggregate(polygons, F.lit(0.0), lambda acc, p: acc + own(p))


def overlap_ratio(one: Column, two: Column) -> Column:
    """Intersection over union; 0 where neither has an area."""
    # by way of a struct, so that the kernel runs once and not wherever its result is named
    areas = F.struct(common_area(one, two).alias("both"), (area(one) + area(two)).alias("sum"))
    ratio = lambda e: F.when(e["sum"] > e["both"], e["both"] / (e["sum"] - e["both"])).otherwise(0.0)
    return F.transform(F.array(areas), ratio)[0]


def box(polygons: Column) -> Column:
    """The box around all shells."""
    return geometry.box(F.flatten(F.transform(polygons, lambda p: p["shell"])))


def with_cells(rows: DataFrame, around: str, side: float) -> DataFrame:
    """Rows with gx and gy, one for each cell of a grid that the box in column around touches."""
    cells = lambda d: F.explode(F.sequence(F.floor(F.col(f"{around}.min_{d}") / side), F.floor(F.col(f"{around}.max_{d}") / side)))
    return rows.withColumn("gx", cells("x")).withColumn("gy", cells("y"))


def pairs_that_meet(one: DataFrame, two: DataFrame, by: list[str], side: float) -> DataFrame:
    """Rows of one and two (their boxes in columns box1 and box2; other names apart but by) whose boxes meet, once each.

    Both are dealt to the cells of a grid; a pair counts in the first cell that both boxes touch. They are merged: what a
    plan takes for small before it is dealt would be gathered on the driver.
    """
    met = with_cells(one, "box1", side).join(with_cells(two, "box2", side).hint("merge"), [*by, "gx", "gy"])
    first = lambda d: F.col(f"g{d}") == F.floor(F.greatest(f"box1.min_{d}", f"box2.min_{d}") / side)
    meet = [F.col(f"box1.min_{d}") <= F.col(f"box2.max_{d}") for d in "xy"] + [F.col(f"box2.min_{d}") <= F.col(f"box1.max_{d}") for d in "xy"]
    return met.where(first("x") & first("y") & meet[0] & meet[1] & meet[2] & meet[3]).drop("gx", "gy")


def cut_results(features: DataFrame, cuts: DataFrame, by: str, key: str, at: Column | None = None, side: float = 64.0) -> DataFrame:
    """What polygons drawn as cuts (by, polygons) make of features (by, key, polygons and others): those that they change.

    action is "updated", the polygons less all cuts of the same `by`, in as many parts as are left; or "deleted" where
    nothing is left, and polygons is empty. Everything else of a feature stays, but updated_at, if it has one, becomes
    at. Features that no cut reaches are not returned. key is unique within by; null polygons are never cut.
    """
    c = F.col
    own = features.where(c("polygons").isNotNull() & (F.size("polygons") > 0)).select(by, key, box(c("polygons")).alias("box1"))
    drawn = cuts.where(F.size("polygons") > 0).select(by, c("polygons").alias("cut"), box(c("polygons")).alias("box2"))
    # a place is in the union of cuts where the windings of their rings add up to something
    touched = pairs_that_meet(own, drawn, [by], side).groupBy(by, key).agg(F.flatten(F.collect_list("cut")).alias("cut"))
    rows = features.join(touched.hint("merge"), [by, key]).withColumn("left", difference(c("polygons"), c("cut")))
    less = area(c("left")) < area(c("polygons")) * (1 - 1e-12)
    action = F.when(F.size("left") == 0, "deleted").otherwise("updated")
    changed = rows.where(less).withColumn("action", action).withColumn("polygons", c("left")).drop("left", "cut")
    return changed.withColumn("updated_at", F.current_timestamp() if at is None else at) if "updated_at" in features.columns else changed


def tiled(rows: DataFrame, side: float) -> DataFrame:
    """Polygons (and other columns) cut along a grid: a row for each cell they lie in, with gx and gy. No shuffle."""
    x, y = F.col("gx") * side, F.col("gy") * side
    cell = polygon(F.array(geometry.point(x, y), geometry.point(x + side, y), geometry.point(x + side, y + side), geometry.point(x, y + side)))
    dealt = with_cells(rows.where(F.size("polygons") > 0).withColumn("box1", box(F.col("polygons"))), "box1", side).drop("box1")
    return dealt.withColumn("polygons", intersection(F.col("polygons"), cell)).where(F.size("polygons") > 0)


@kernel(POLYGONS)
def _dissolved(lists: pa.Array) -> pa.Array:
    own = decoded(lists)
    known = [g for g in own if g is not None]
    found = iter(overlay.combined_each(known, [[]] * len(known), np.logical_or))
    return encoded([None if g is None else next(found) for g in own])


def dissolved(polygons: Column) -> Column:
    """Polygons that touch along a side, or overlap, as one."""
    return _dissolved(polygons)


def clipped_to_land(shapes: DataFrame, land: DataFrame, key: str, least: float = 0.01, side: float = 64.0) -> DataFrame:
    """key, polygons and land_share of shapes (key, polygons) of which at least `least` lies on land; others are left out.

    Land is rows of polygons of any form that do not overlap. It is cut into tiles where it lies, shapes meet the tiles
    that their boxes touch, and what is on land is put together again without seams. Shapes that are not valid are
    repaired first; those without an area are left out.
    """
    c = F.col
    valid = shapes.select(key, repaired(c("polygons")).alias("own")).where(F.size("own") > 0)
    dealt = with_cells(valid.withColumn("box1", box(c("own"))), "box1", side).drop("box1")
    met = dealt.join(tiled(land.select("polygons"), side).withColumnRenamed("polygons", "land").hint("merge"), ["gx", "gy"])
    pieces = met.withColumn("piece", intersection(c("own"), c("land"))).where(F.size("piece") > 0)
    whole = pieces.groupBy(key).agg(F.flatten(F.collect_list("piece")).alias("polygons"), F.first(area(c("own"))).alias("size"))
    found = whole.withColumn("polygons", dissolved(c("polygons"))).withColumn("land_share", area(c("polygons")) / c("size"))
    return found.where(c("land_share") >= least).select(key, "polygons", "land_share")


def snapped(shapes: DataFrame, segments: DataFrame, tolerance: float | str, key: str) -> DataFrame:
    """shapes (key, polygons) with the corners of shells and holes on the nearest segment, and how many of them moved.

    tolerance is a number, or a column of shapes between 200 and 50,000. Polygons that snapping makes invalid are
    repaired; where nothing is left of them they keep their place and count none. key is one column, unique.
    """
    from maploom.operators.georeference import snap_to_lines

    c = F.col
    body = lambda r: F.slice(r, 1, F.size(r) - 1)
    # rings numbered through, shells first in each polygon
    listed = shapes.select(c(key), *([] if isinstance(tolerance, float | int) else [c(tolerance).alias("reach")]), F.posexplode("polygons").alias("part", "p"))
    rings = listed.select("*", F.posexplode(F.concat(F.array("p.shell"), c("p.holes"))).alias("ring", "r")).drop("p")
    corners = rings.select("*", F.posexplode(body(c("r"))).alias("n", "q")).select(F.struct(c(key).alias("k"), "part", "ring", "n").alias("corner"), "q.x", "q.y", *(["reach"] if "reach" in rings.columns else []))
    moved = snap_to_lines(corners, segments, float(tolerance) if isinstance(tolerance, float | int) else "reach", "corner").where("moved")
    at = F.struct("corner.part", "corner.ring", "corner.n")
    placed = moved.groupBy(c("corner.k").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct(at, geometry.point(c("x"), c("y"))))).alias("to"))
    to = lambda part, ring, n, q: F.coalesce(F.try_element_at("to", F.struct(part.alias("part"), ring.alias("ring"), n.alias("n"))), q)
    ring = lambda r, part, number: geometry.closed(F.transform(body(r), lambda q, n: to(part, number, n, q)))
    new = F.transform(c("polygons"), lambda p, k: F.struct(ring(p["shell"], k, F.lit(0)).alias("shell"), F.transform(p["holes"], lambda h, n: ring(h, k, n + 1)).alias("holes")))
    rows = shapes.join(placed.hint("merge"), key, "left").withColumn("new", F.when(c("to").isNotNull(), new).cast(POLYGONS)).withColumn("to", F.size("to"))
    rows = _mended(rows, "new")
    fits = c("new").isNotNull() & (F.size("new") > 0)
    return rows.withColumns({"polygons": F.when(fits, c("new")).otherwise(c("polygons")), "snapped": F.when(fits, c("to")).otherwise(0)}).drop("to", "new")
