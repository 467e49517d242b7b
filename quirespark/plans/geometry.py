"""Box queries over boxes derived from the lines of orders (a page an order, a box a line), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import compare as C
from quirespark.operators import geometry as G
from quirespark.operators import ordered as O
from quirespark.plans.ledger import base, pages

_X0, _Y0 = "(l_partkey * 37) % 900", "(l_suppkey * 53 + l_linenumber * 97) % 1300"
# a page has one box for each line number
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)"
BOXES = f"""(SELECT l_orderkey AS page_id, l_linenumber AS item, (least(1000000, round(({_X0}) / 1000.0 * 1000000)))::INTEGER AS x0, (least(1000000, round(({_Y0}) / 1400.0 * 1000000)))::INTEGER AS y0,
 (least(1000000, round(({_X0} + 60) / 1000.0 * 1000000)))::INTEGER AS x1, (least(1000000, round(({_Y0} + 40) / 1400.0 * 1000000)))::INTEGER AS y1 FROM {LINES} li)"""
TILES = "(SELECT page_id, c + 3 * r AS tile, (c * 400000)::INTEGER AS x0, (r * 500000)::INTEGER AS y0, least(1000000, (c + 1) * 400000)::INTEGER AS x1, ((r + 1) * 500000)::INTEGER AS y1 FROM (SELECT DISTINCT l_orderkey AS page_id FROM lineitem) p, (VALUES (0), (1), (2)) cs(c), (VALUES (0), (1)) rs(r))"


def boxes(s: SparkSession, d: str) -> DataFrame:
    li = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    x, y = F.expr(_X0), F.expr(_Y0)
    return li.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("item"), G.grid(x, F.lit(1000)).alias("x0"), G.grid(y, F.lit(1400)).alias("y0"), G.grid(x + 60, F.lit(1000)).alias("x1"), G.grid(y + 40, F.lit(1400)).alias("y1"))


def tiles(s: SparkSession, d: str) -> DataFrame:
    plan = F.array(*[F.struct(F.lit(c + 3 * r).alias("tile"), F.lit(c * 400_000).alias("x0"), F.lit(r * 500_000).alias("y0"), F.lit(min(1_000_000, (c + 1) * 400_000)).alias("x1"), F.lit((r + 1) * 500_000).alias("y1")) for c in range(3) for r in range(2)])
    return boxes(s, d).select("page_id").distinct().select("page_id", F.inline(plan))


def box_gaps(s: SparkSession, d: str) -> DataFrame:
    return O.gaps(boxes(s, d), ["page_id"], "x0", "x1", 50_000).select("page_id", "gap_from", "gap_to", "cut")


def tile_assignment(s: SparkSession, d: str) -> DataFrame:
    return G.assign_tiles(boxes(s, d), tiles(s, d)).select("page_id", "item", "tile")


def tile_crossings(s: SparkSession, d: str) -> DataFrame:
    """Boxes that lie across an edge between tiles, with the tiles."""
    return G.crossings(boxes(s, d), tiles(s, d), 28_571).select("page_id", "item", F.array_join("tiles", ",").alias("tiles"))


def tile_partition_check(s: SparkSession, d: str) -> DataFrame:
    return G.partition_faults(tiles(s, d))


def centres_inside(s: SparkSession, d: str) -> DataFrame:
    odd = boxes(s, d).filter("item % 2 = 1").withColumns({"x1": F.least(F.col("x1") + 90_000, F.lit(1_000_000)), "y1": F.least(F.col("y1") + 90_000, F.lit(1_000_000))})
    return G.centres_inside(boxes(s, d), odd)


def line_height_median(s: SparkSession, d: str) -> DataFrame:
    return boxes(s, d).groupBy("page_id").agg(O.upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("height"))


def reading_order(s: SparkSession, d: str) -> DataFrame:
    return G.reading_order(boxes(s, d))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    last = O.latest(base(s, d, "job_id", "page_id", "stage", "extracted_at", "content").filter("content IS NOT NULL"), ["job_id", "page_id", "stage"], [F.desc("extracted_at"), F.desc("reading_id")]).select("job_id", "page_id", "stage", "content")
    ref = pages(s, d).filter("selected_output.text IS NOT NULL").select("job_id", "page_id", "selected_stage", F.col("selected_output.text").alias("ref"))
    return last.join(ref, ["job_id", "page_id"]).filter("stage != selected_stage")


def pairwise_agreement(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("job_id", "page_id", "stage", C.compared("ref", "content").alias("c")).select("job_id", "page_id", "stage", F.round("c.ratio", 4).alias("ratio"), F.size("c.spans").alias("n_spans"), F.array_join("c.numbers", ",").alias("numbers"))


def contest_spans(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("job_id", "page_id", "stage", F.inline(C.contest("ref", "content")))


def edition_text(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("job_id", "page_id", "stage", C.edition(F.col("ref"), C.contest("ref", "content")).alias("edition"))


QUERIES = {f.__name__: f for f in (box_gaps, tile_assignment, tile_crossings, tile_partition_check, centres_inside, line_height_median, reading_order, pairwise_agreement, contest_spans, edition_text)}
_C = f"(SELECT *, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy FROM {BOXES} b)"
ORACLES = {
    "box_gaps": f"SELECT page_id, e AS gap_from, x0 AS gap_to, floor((e + x0) / 2.0)::BIGINT AS cut FROM (SELECT page_id, x0, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM {BOXES} b) q WHERE x0 - e > 50000",
    "tile_assignment": f"SELECT c.page_id, c.item, min(t.tile) AS tile FROM {_C} c LEFT JOIN {TILES} t ON c.page_id = t.page_id AND cx >= t.x0 AND (cx < t.x1 OR (t.x1 = 1000000 AND cx = 1000000)) AND cy >= t.y0 AND (cy < t.y1 OR (t.y1 = 1000000 AND cy = 1000000)) GROUP BY 1, 2",
    "tile_crossings": f"SELECT page_id, item, string_agg(tile::VARCHAR, ',' ORDER BY tile) AS tiles FROM (SELECT c.page_id, c.item, t.tile FROM {_C} c JOIN {TILES} t ON c.page_id = t.page_id AND least(c.x1, t.x1) - greatest(c.x0, t.x0) > 28571 / 4.0 AND least(c.y1, t.y1) - greatest(c.y0, t.y0) > 28571 / 4.0) q GROUP BY 1, 2 HAVING count(*) > 1",
    "tile_partition_check": f"SELECT page_id, sum((x1 - x0)::BIGINT * (y1 - y0)) = 1000000000000 AS area_whole, bool_and(x0 >= 0 AND y0 >= 0 AND x1 <= 1000000 AND y1 <= 1000000 AND x0 < x1 AND y0 < y1) AS within, 0::BIGINT AS overlaps FROM {TILES} t GROUP BY 1",
    "centres_inside": f"SELECT page_id, count(*) AS items, count(*) FILTER (hit) AS inside FROM (SELECT c.page_id, c.item, bool_or(coalesce(cx BETWEEN o.x0 AND least(o.x1 + 90000, 1000000) AND cy BETWEEN o.y0 AND least(o.y1 + 90000, 1000000), false)) AS hit FROM {_C} c LEFT JOIN (SELECT * FROM {BOXES} b WHERE item % 2 = 1) o ON c.page_id = o.page_id GROUP BY 1, 2) q GROUP BY 1",
    "line_height_median": f"SELECT page_id, greatest(list_sort(list(y1 - y0))[len(list(y1 - y0)) // 2 + 1], 1) AS height FROM {BOXES} b GROUP BY 1",
}
