"""Detector post-processing: score filter, box decoding, greedy suppression, order.

anchors: page_id, i, cx, cy, w, h (in the detector's SIZE x SIZE space), score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G

SIZE = 1024
MIN_SCORE = 0.5
MAX_OVERLAP = 0.4


def decode(anchors: DataFrame, min_score: float = MIN_SCORE, size: int = SIZE) -> DataFrame:
    """Boxes (page_id, i, x, y, w, h, score) in page pixels, truncated; needs page_w and page_h."""
    x_scale, y_scale = F.col("page_w") / size, F.col("page_h") / size
    whole = lambda c: c.cast("int")
    return anchors.filter(F.col("score") >= min_score).select(
        "page_id",
        "i",
        whole((F.col("cx") - F.col("w") / 2) * x_scale).alias("x"),
        whole((F.col("cy") - F.col("h") / 2) * y_scale).alias("y"),
        whole(F.col("w") * x_scale).alias("w"),
        whole(F.col("h") * y_scale).alias("h"),
        "score",
    )


def suppress(boxes: DataFrame, max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """Keep each page's boxes by falling score unless they overlap a kept one; zone_idx by y, then x."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "i", "x", "y", "w", "h", "score")))

    def step(kept: Column, box: Column) -> Column:
        return F.when(F.exists(kept, lambda k: G.overlap(k, box) > max_overlap), kept).otherwise(F.concat(kept, F.array(box)))

    def start(ranked: Column) -> Column:
        return F.slice(ranked, 1, 0)

    page = boxes.groupBy("page_id").agg(ranked.alias("r"))
    kept = page.select("page_id", F.aggregate("r", start(F.col("r")), step).alias("k"))
    placed = F.array_sort(F.transform("k", lambda b, j: F.struct(b["y"].alias("y"), b["x"].alias("x"), j.alias("j"), b["w"].alias("w"), b["h"].alias("h"), b["score"].alias("score"), b["i"].alias("i"))))
    return kept.select("page_id", F.posexplode(placed).alias("zone_idx", "b")).select("page_id", "zone_idx", "b.x", "b.y", "b.w", "b.h", "b.score", "b.i")


def overlapping_pairs(boxes: DataFrame, max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """Pairs of a page's boxes that overlap (page_id, a, b): an equi join on the page with a condition."""
    box = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in "xywh"])
    found = boxes.alias("p").join(boxes.alias("q"), (F.col("p.page_id") == F.col("q.page_id")) & (F.col("p.i") < F.col("q.i")) & (G.overlap(box("p"), box("q")) > max_overlap))
    return found.select(F.col("p.page_id").alias("page_id"), F.col("p.i").alias("a"), F.col("q.i").alias("b"))
