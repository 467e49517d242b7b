"""Boxes on pages: grid, gaps, reading order, tiles and containment.

Boxes are integers on a grid of a million by a million. Containment joins
bucket the height so that they are equi-joins; reading order is one Arrow
function a page, as its recursion has no relational form.

Defined results
* a page of no boxes has no rows; equal boxes keep their index's order.
* a centre on a tile's lower or right edge belongs to the next tile, except at the page's own edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID = 1_000_000


def grid(value: Column, extent: Column) -> Column:
    """A pixel position on the grid, clamped to the page."""
    return F.greatest(F.lit(0), F.least(F.lit(GRID), F.round(value.cast("double") / extent * GRID))).cast("int")


def _boxes_of(boxes: DataFrame, page: str, *more: str) -> DataFrame:
    """A page's boxes as one array: as many as fit on a page."""
    return boxes.groupBy(page).agg(F.collect_list(F.struct(*more, "x0", "y0", "x1", "y1")).alias("__boxes"))


def assign_tiles(items: DataFrame, tiles: DataFrame, page: str = "page_id") -> DataFrame:
    """Each item with the tile that holds its centre (null if none): one join on the page, whose tiles are one array.

    ``items``: page, item, x0, y0, x1, y1. ``tiles``: page, tile, x0, y0, x1, y1.
    """
    inside = lambda p, a, z: (p >= a) & ((p < z) | ((z == GRID) & (p == GRID)))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = F.filter("__boxes", lambda t: inside(cx, t["x0"], t["x1"]) & inside(cy, t["y0"], t["y1"]))
    joined = items.join(_boxes_of(tiles, page, "tile"), page, "left")
    return joined.withColumn("tile", F.array_min(F.transform(hit, lambda t: t["tile"]))).drop("__boxes")


def crossings(items: DataFrame, tiles: DataFrame, height: int, page: str = "page_id") -> DataFrame:
    """Items that cross an inner edge of a tile by more than a quarter of the line height: page, item, tiles they cross."""
    least = height / 4
    over = lambda a0, a1, b0, b1: F.least(a1, b1) - F.greatest(a0, b0)
    joined = items.join(_boxes_of(tiles, page, "tile"), page)
    across = lambda t: (over(F.col("x0"), F.col("x1"), t["x0"], t["x1"]) > least) & (over(F.col("y0"), F.col("y1"), t["y0"], t["y1"]) > least)
    hit = F.array_sort(F.transform(F.filter("__boxes", across), lambda t: t["tile"]))
    return joined.select(page, "item", hit.alias("tiles")).filter(F.size("tiles") > 1)


def centres_inside(items: DataFrame, boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """For each page the number of items and of those whose centre lies in any of the boxes, edges included."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = F.exists("__boxes", lambda t: cx.between(t["x0"], t["x1"]) & cy.between(t["y0"], t["y1"]))
    joined = items.join(_boxes_of(boxes, page), page, "left")
    return joined.groupBy(page).agg(F.count("*").alias("items"), F.count_if(F.coalesce(hit, F.lit(False))).alias("inside"))


def partition_faults(tiles: DataFrame, page: str = "page_id") -> DataFrame:
    """Pages whose tiles don't make an exact partition: area, bounds, overlaps (tiles of a page are few: 99 at most)."""
    area = (F.col("x1") - F.col("x0")).cast("decimal(20,0)") * (F.col("y1") - F.col("y0"))
    sums = tiles.groupBy(page).agg(F.sum(area).alias("area"), F.bool_and((F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= GRID) & (F.col("y1") <= GRID) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).alias("within"))
    a, b = tiles.select(page, *[F.col(k).alias(f"a_{k}") for k in ("tile", "x0", "y0", "x1", "y1")]), tiles.select(page, *[F.col(k).alias(f"b_{k}") for k in ("tile", "x0", "y0", "x1", "y1")])
    over = a.join(b, page).filter("a_tile < b_tile AND a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1").groupBy(page).agg(F.count("*").alias("overlaps"))
    out = sums.join(over, page, "left").fillna(0, ["overlaps"])
    return out.select(page, (F.col("area") == GRID * GRID).alias("area_whole"), "within", "overlaps")


def order_lines(lines: list[tuple[int, int, int, int]], gap: int) -> list[int]:
    """Reading order of boxes by recursive cuts: full-width bands first, then columns, top to bottom and left to right."""

    def cuts(ix: list[int], lo: int, hi: int) -> list[list[int]]:
        parts: list[list[int]] = []
        far = None
        for i in sorted(ix, key=lambda k: (lines[k][lo], lines[k][hi], k)):
            if far is None or lines[i][lo] - far > gap:
                parts.append([])
            parts[-1].append(i)
            far = lines[i][hi] if far is None else max(far, lines[i][hi])
        return parts

    def visit(ix: list[int], down: bool) -> list[int]:
        parts = cuts(ix, 1, 3) if down else cuts(ix, 0, 2)
        if len(parts) == 1:
            other = cuts(ix, 0, 2) if down else cuts(ix, 1, 3)
            if len(other) == 1:
                return sorted(ix, key=lambda k: (lines[k][1], lines[k][0], k))
            return [i for p in other for i in visit(p, down)]
        return [i for p in parts for i in visit(p, not down)]

    return visit(list(range(len(lines))), True) if lines else []


@F.arrow_udf(T.ArrayType(T.LongType()))
def _positions(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for boxes, gaps in it:
        out = []
        for page, gap in zip(boxes.to_pylist(), gaps.to_pylist(), strict=True):
            at = order_lines([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in page], gap)
            pos = [0] * len(at)
            for n, i in enumerate(at, 1):
                pos[i] = n
            out.append(pos)
        yield pa.array(out, pa.list_(pa.int64()))


def reading_order(items: DataFrame, page: str = "page_id", gap: int = 10_000) -> DataFrame:
    """Items with ``position`` on their page. A page's boxes are one array: bounded by what fits on a page."""
    held = items.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("item", "x0", "y0", "x1", "y1"))).alias("b"))
    placed = held.withColumn("p", _positions("b", F.lit(gap)))
    return placed.select(page, F.inline(F.arrays_zip(F.col("b.item").alias("item"), F.col("p").alias("position"))))
