"""Zones from recognised lines, and zones of one bubble merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import text as T

MIN_CONFIDENCE = 0.5


def mean_angle(angle: Column) -> Column:
    """Circular mean in degrees, as an aggregate."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle)))))


def _in_order(order: list[Column], value: Column) -> Column:
    """Values of a group as an array, by the order columns."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda s: s["v"])


def blocks(ocr_lines: DataFrame, min_confidence: float = MIN_CONFIDENCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One zone per block (page_id, zone_idx) of lines (line, text, score, corners): text, confidence, line_height, angle, rect.

    Blank lines don't count; blocks whose lowest score is under the threshold go. keep: columns
    that all lines of a block share.
    """
    if not 0 <= min_confidence <= 1:
        raise ValueError("the confidence threshold lies between 0 and 1")
    lines = ocr_lines.filter(~T.is_blank(F.col("text"))).withColumn("q", G.relabelled(F.col("corners")))
    lines = lines.withColumns({"cx": G.centre_x(F.col("q")), "cy": G.centre_y(F.col("q"))})
    order = [F.col("cy"), F.col("cx"), F.col("line")]
    made = lines.groupBy("page_id", "zone_idx").agg(
        F.array_join(_in_order(order, T.trimmed(F.col("text"))), " ").alias("text_src"),
        F.min("score").alias("confidence"),
        F.avg(G.height(F.col("q"))).alias("line_height"),
        mean_angle(G.angle(F.col("q"))).alias("angle"),
        G.bounding_quad(F.collect_list("q")).alias("rect"),
        F.count("*").alias("n_lines"),
        *[F.first(c).alias(c) for c in keep],
    )
    return made.filter(F.col("confidence") >= min_confidence)


_MERGED = {"page_id", "zone_idx", "rect", "contour", "text_src", "confidence", "line_height", "angle", "background", "fragments"}


def same_bubble(zones: DataFrame) -> DataFrame:
    """Zones of a page with equal contours become one, at the first one's place; zones without contour stay apart.

    zones: page_id, zone_idx, rect, contour, text_src, confidence, line_height, angle, background;
    further columns are taken from the first zone.
    """
    alone = F.when(F.col("contour").isNull(), F.col("zone_idx")).otherwise(F.lit(-1))
    many = F.count("*") > 1
    only = lambda c: F.min_by(c, "zone_idx")
    made = zones.withColumn("__merge_alone", alone).groupBy("page_id", "contour", "__merge_alone").agg(
        F.min("zone_idx").alias("zone_idx"),
        F.when(many, G.bounding_quad(F.collect_list("rect"))).otherwise(only("rect")).alias("rect"),
        F.when(many, F.array_join(_in_order([F.col("zone_idx")], T.trimmed(F.col("text_src"))), " ")).otherwise(only("text_src")).alias("text_src"),
        F.min("confidence").alias("confidence"),
        F.avg("line_height").alias("line_height"),
        F.when(many, mean_angle(F.col("angle"))).otherwise(only("angle")).alias("angle"),
        only("background").alias("background"),
        F.count("*").alias("fragments"),
        *[only(F.col(f"`{c}`")).alias(c) for c in zones.columns if c not in _MERGED],
    )
    return made.drop("__merge_alone")
