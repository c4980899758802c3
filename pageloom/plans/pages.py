"""The six stages of a page chain over the operators of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.operators import layout, order, raster, read, translate
from pageloom.plans.chain import Chain, cut


def page_chain(pages: DataFrame, detector: read.Detector, ocr: read.Ocr, engine: Callable, split: bool = True, calm: bool = True) -> Chain:
    """A chain from pages (page_id, direction, image) to their cleaned images and laid-out zones.

    Read to translate work on zones. Erase returns a row per page that has zones: the cleaned
    image and its zones, in reading order, as an array; rewrite adds the layout of those
    that have a bubble and a translation. Models run once for each page: what is read, ordered
    and erased goes to the checkpoint folder.
    """

    def frame(zones: DataFrame) -> DataFrame:
        q = F.col("rect")
        sides = {"x": q["hg"]["x"], "y": q["hg"]["y"], "w": G.width(q), "h": G.height(q)}
        framed = raster.frame(raster.spread(zones.withColumns(sides)))
        return framed.withColumn("rect", G.rectangle(*[F.col(c) for c in "xywh"]))

    def erase(zones: DataFrame) -> DataFrame:
        rows = zones.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in zones.columns if c not in ("page_id", "rank")]))).alias("zones"))
        joined = pages.select("page_id", "direction", "image").join(rows, "page_id")
        shapes = joined.select("page_id", F.explode("zones").alias("z")).select("page_id", "z.*")
        return cut(raster.erase_pages(joined, shapes))

    def rewrite(cleaned: DataFrame) -> DataFrame:
        todo = cleaned.select("page_id", F.explode("zones").alias("z")).select("page_id", "z.*")
        todo = todo.filter(layout.rewritable(F.col("contour"), F.col("text_dst")))
        todo = todo.withColumns({"box_w": F.col("w"), "box_h": F.col("h"), "centre_x": F.col("x") + F.col("w") / 2, "centre_y": F.col("y") + F.col("h") / 2})
        lines = layout.placed_lines(layout.layout(todo))
        made = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line", "words", "font_size", "line_x", "line_y"))).alias("lines"))
        return cleaned.join(made, "page_id", "left")

    return Chain(
        read=lambda p: cut(read.read(p, detector, ocr)),
        frame=frame,
        order=lambda zones: cut(order.reading_order(zones)),
        translate=lambda zones: translate.translate(zones.withColumn("text_dst", F.lit(None).cast("string")), engine, split, calm),
        erase=erase,
        rewrite=rewrite,
    )
