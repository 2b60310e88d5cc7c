"""Page-geometry operators over boxes (page, x0, y0, x1, y1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folds


def bands(boxes: DataFrame) -> DataFrame:
    """Vertical bands of a page: a box opens one if it begins below all boxes before it."""
    w = W.partitionBy("page").orderBy("y0", "y1", "box_id")
    reach = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    start = F.when(reach.isNull() | (F.col("y0") > reach), 1).otherwise(0)
    return boxes.withColumn("start", start).withColumn("band", F.sum("start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("start")


def union_box(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def upper_median(boxes: DataFrame, key: str, value: str) -> DataFrame:
    """The element at n div 2 of the sorted values: two ranks, no gathered list."""
    w = W.partitionBy(key)
    ranked = boxes.withColumn("rn", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return ranked.where("rn = floor(n / 2) + 1").select(key, F.col(value).alias("median"))


def right_bound(boxes: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Left edge of the nearest obstacle to the right within a box's band of the same page."""
    o = obstacles.select(F.col("page").alias("op"), F.col("x0").alias("ox"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    near = boxes.join(o, (F.col("page") == F.col("op")) & (F.col("ox") >= F.col("x1")) & (F.col("oy0") < F.col("y1")) & (F.col("oy1") > F.col("y0")), "left")
    return near.groupBy("page", "box_id").agg(F.min("ox").alias("bound"))


def neighbours(cells: DataFrame) -> DataFrame:
    """Nearest occupied cell left and right of each cell in its row."""
    w = W.partitionBy("sheet", "r").orderBy("c")
    held = F.when(F.col("occupied"), F.col("c"))
    return cells.withColumns({"left": F.max(held).over(w.rowsBetween(W.unboundedPreceding, -1)), "right": F.min(held).over(w.rowsBetween(1, W.unboundedFollowing))})


def band_bounds(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """Room of each line (page, line_id, y0, y1) between its page's bands (band_id and box): the greatest
    left and least right edge of the bands that it overlaps, or the edges of the nearest band."""
    b = bands.select(F.col("page").alias("of"), F.col("band_id"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    over = (F.col("by1") > F.col("y0")) & (F.col("by0") < F.col("y1"))
    away = F.abs((F.col("by0") + F.col("by1")) / 2 - (F.col("y0") + F.col("y1")) / 2)
    near = F.min_by(F.struct("bx0", "bx1"), F.struct(away, F.col("band_id")))
    out = lines.join(b, F.col("page") == F.col("of")).groupBy("page", "line_id").agg(F.max(F.when(over, F.col("bx0"))).alias("lo"), F.min(F.when(over, F.col("bx1"))).alias("hi"), near.alias("near"))
    return out.select("page", "line_id", F.coalesce("lo", "near.bx0").alias("lo"), F.coalesce("hi", "near.bx1").alias("hi"))


def justified(lines: DataFrame, size: float) -> DataFrame:
    """Paragraphs (lines: para, place, x0, x1) set flush on both sides: three lines or more, most of them
    at the left edge, and all but the last end at about the same right edge."""
    w = W.partitionBy("para")
    held = lines.withColumns({"left": F.min("x0").over(w), "last": F.max("place").over(w) == F.col("place")})
    inner = F.when(~F.col("last"), F.col("x1"))
    out = held.groupBy("para").agg(F.count("*").alias("n"), F.count_if(F.col("x0") - F.col("left") <= 3).alias("flush"), (F.max(inner) - F.min(inner)).alias("spread"), (F.max("x1") - F.min("x0")).alias("wide"))
    return out.select("para", F.coalesce((F.col("n") >= 3) & (F.col("flush") >= 0.6 * F.col("n")) & (F.col("spread") <= F.greatest(F.lit(0.5 * size), 0.03 * F.col("wide"))), F.lit(False)).alias("justified"))


def aligned_folios(lines: DataFrame) -> DataFrame:
    """Trailing numbers (page, right, trailing) with another number's right edge within 2.5 points, by a
    window over tenths of a point: no pairs are made."""
    w = W.partitionBy("page").orderBy("tenth").rangeBetween(-25, 25)
    out = lines.withColumn("tenth", F.bround(F.col("right") * 10).cast("long")).withColumn("aligned", F.count("*").over(w))
    return out.where("trailing and aligned >= 2").drop("tenth")


def visible(glyphs: DataFrame, covers: DataFrame) -> DataFrame:
    """Glyphs (page, glyph_id, ch, box, seq) that show: one painted over later by an opaque box counts as
    hidden, and of equal glyphs at one origin as many go, the first ones, as are hidden."""
    c = covers.select(F.col("page").alias("of"), F.col("seq").alias("later"), *[F.col(x).alias("c" + x) for x in ("x0", "y0", "x1", "y1")])
    inside = (F.col("x0") >= F.col("cx0") - 0.5) & (F.col("y0") >= F.col("cy0") - 0.5) & (F.col("x1") <= F.col("cx1") + 0.5) & (F.col("y1") <= F.col("cy1") + 0.5)
    hidden = glyphs.join(c, (F.col("page") == F.col("of")) & (F.col("later") > F.col("seq")) & inside, "left_semi").select(F.col("glyph_id").alias("gone"), F.lit(1).alias("hid"))
    w = W.partitionBy("page", "ch", F.round("x0"), F.round("y0"))
    out = glyphs.join(hidden, F.col("glyph_id") == F.col("gone"), "left").withColumns({"n_hidden": F.count("hid").over(w), "nth": F.row_number().over(w.orderBy("glyph_id"))})
    return out.where("nth > n_hidden").select(glyphs.columns)


def composed(spans: DataFrame, gw: float) -> DataFrame:
    """Text of each line (page, x0, x1, text): a space goes where the gap is wide and neither side has one."""
    w = W.partitionBy("page").orderBy("x0", "box_id")
    before = F.lag("text").over(w)
    space = (F.col("x0") - F.lag("x1").over(w) > 0.30 * gw) & (before != "") & ~before.endswith(" ") & ~F.col("text").startswith(" ")
    cut = spans.withColumn("part", F.concat(F.when(space, " ").otherwise(""), "text"))
    return cut.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "box_id", "part"))), lambda x: x["part"]), "").alias("text"))


def by_page(boxes: DataFrame, solve: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, *edges: str) -> DataFrame:
    """(page, box_id, ``name``): what ``solve`` gives for the ids and the named edges of each page's boxes. Rows come
    sorted by page, so that a task holds one page at a time besides a batch, and no page costs a call of Python's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in chain(batches, [None]):
            now = rest
            if b is not None:
                if not b.num_rows:
                    continue
                now = [c.to_numpy() for c in b.columns]
                now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
                last = np.searchsorted(now[0], now[0][-1])
                rest, now = [c[last:] for c in now], [c[:last] for c in now]
            if now is None or not len(now[0]):
                continue
            x = np.stack(now[2:], 1)
            cuts = [0, *(np.flatnonzero(np.diff(now[0])) + 1), len(now[0])]
            got = np.concatenate([solve(now[1][i:j], x[i:j]) for i, j in pairwise(cuts)])
            yield pa.RecordBatch.from_arrays([pa.array(now[0]), pa.array(now[1]), pa.array(got)], ["page", "box_id", name])

    rows = boxes.selectExpr("bigint(page) AS page", "bigint(box_id) AS box_id", *[f"double({c}) AS {c}" for c in edges])
    return rows.repartition("page").sortWithinPartitions("page", "box_id").mapInArrow(run, f"page long, box_id long, {name} long")


def columns(boxes: DataFrame) -> DataFrame:
    """Columns of each page, named by their least box: boxes that overlap sideways by more than a quarter
    of the narrower one, and what hangs together through them."""

    def solve(label: np.ndarray, x: np.ndarray) -> np.ndarray:
        x0, x1 = x.T
        shared = np.minimum.outer(x1, x1) - np.maximum.outer(x0, x0)
        linked = (shared > 0.25 * np.maximum(1.0, np.minimum.outer(x1 - x0, x1 - x0))) | np.eye(len(x), dtype=bool)
        while True:
            least = np.where(linked, label, np.iinfo(np.int64).max).min(1)
            if (least == label).all():
                return label
            label = least

    return by_page(boxes, solve, "col", "x0", "x1")


def list_items(lines: DataFrame) -> DataFrame:
    """Lines (page, line_id, left, top, text) whose marker (5. or (b)) has a neighbour one up or down right
    before or after it among the markers at the same left edge, within 1.5 points of the edge's first."""
    token = F.regexp_extract("text", r"^\s*\(?(\d{1,3}|[a-zA-Z])[.)]\s+", 1)
    marks = lines.withColumn("token", token).where("token <> ''").withColumn("kind", F.col("token").rlike("^[0-9]"))
    marks = marks.withColumn("rank", F.when(F.col("kind"), F.expr("try_cast(token AS INT)")).otherwise(F.ascii(F.lower("token"))))
    marks = folds.fold(marks.select("page", "line_id", "left", "top", "kind", "rank"), ["page"], ["line_id"], folds.nearest("left", 1.5), "edge long", ["edge"])
    w = W.partitionBy("page", "edge").orderBy("top", "line_id")
    meets = lambda f, by: F.coalesce((f("kind").over(w) == F.col("kind")) & (f("rank").over(w) == F.col("rank") + by), F.lit(False))
    return marks.withColumn("item", meets(F.lag, -1) | meets(F.lead, 1)).where("item").select("page", "line_id")


def overhead(paras: DataFrame, obstacles: DataFrame, size: float, gap: float) -> DataFrame:
    """The narrowest block right above each paragraph that holds it sideways and is narrower than its frame."""
    o = obstacles.select(F.col("page").alias("of"), *[F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")])
    wide = F.col("ox1") - F.col("ox0")
    near = (F.col("oy1") <= F.col("y0") + 1) & (F.col("y0") - F.col("oy1") <= gap * size)
    block = (F.col("oy1") - F.col("oy0") >= size) & (wide >= size) & (wide < F.col("f1") - F.col("f0"))
    holds = (F.col("ox0") <= F.col("x0") + 1) & (F.col("ox1") >= F.col("x1") - 1)
    best = F.min_by(F.struct("ox0", "ox1"), F.struct(wide, F.col("ox0"))).alias("best")
    return paras.join(o, (F.col("page") == F.col("of")) & near & block & holds).groupBy("page", "box_id").agg(best).select("page", "box_id", "best.*")


def reading_order(x: np.ndarray) -> list[int]:
    """Order in which boxes (rows x0, y0, x1, y1) are read, by cuts through empty bands: side by side
    before one below the other, and blocks that share a white column are read as one."""

    def split(ids: list[int], axis: int) -> list[list[int]]:
        ids = sorted(ids, key=lambda i: (x[i, axis], x[i, 1 - axis]))
        reach = np.maximum.accumulate(x[ids, axis + 2])
        cuts = np.flatnonzero(x[ids[1:], axis] >= reach[:-1]) + 1
        return [list(map(int, g)) for g in np.split(np.array(ids), cuts)]

    def aside(ids: list[int]) -> bool:
        return len(split(ids, 0)) > 1

    out: list[int] = []
    todo = [list(range(len(x)))] if len(x) else []
    while todo:
        ids = todo.pop()
        if len(ids) == 1:
            out += ids
            continue
        parts = split(ids, 0)
        if len(parts) == 1:
            parts = []
            for block in split(ids, 1):
                if parts and aside(parts[-1]) and aside(block) and aside(parts[-1] + block):
                    parts[-1] = parts[-1] + block
                else:
                    parts.append(block)
            if len(parts) == 1:
                out += sorted(ids, key=lambda i: (x[i, 1], x[i, 0]))
                continue
        todo += parts[::-1]
    return out


def read_in_order(boxes: DataFrame) -> DataFrame:
    """Place of each box in its page's reading order."""

    def solve(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        place = np.empty(len(x), np.int64)
        place[reading_order(x)] = np.arange(len(x))
        return place

    return by_page(boxes, solve, "place", "x0", "y0", "x1", "y1")
