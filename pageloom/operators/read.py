"""Reading pages: a detector finds blocks, an OCR reads them, and the bubble around each is searched.

Detector and OCR are given as functions that make the callable, once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators import detect, merge, raster
from pageloom.sources import images

#: Pixels around a block that its crop takes in.
AROUND = 12
#: From the detector's input (1 x 3 x SIZE x SIZE) to rows (cx, cy, w, h, score).
Detector = Callable[[], Callable[[np.ndarray], np.ndarray]]
#: From a crop to its lines: (text, score, four corners (x, y) in the crop).
Ocr = Callable[[], Callable[[np.ndarray], list[tuple[str, float, list[tuple[float, float]]]]]]


def anchors(pages: DataFrame, detector: Detector) -> DataFrame:
    """pages (page_id, image) to anchors with their page's size; an unreadable image is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = detector()
        for rows in batches:
            for page_id, data in zip(rows["page_id"], rows["image"], strict=True):
                image = images.decode(data)
                made = np.asarray(found(raster.detector_input(image, detect.SIZE)), float).reshape(-1, 5)
                out = pd.DataFrame(made, columns=["cx", "cy", "w", "h", "score"])
                yield out.assign(page_id=page_id, i=np.arange(len(out)), page_w=image.shape[1], page_h=image.shape[0])

    schema = "cx double, cy double, w double, h double, score double, page_id bigint, i int, page_w int, page_h int"
    return pages.select("page_id", "image").mapInPandas(run, schema)


def recognised(pages: DataFrame, boxes: DataFrame, ocr: Ocr) -> DataFrame:
    """One row per line of each box (page_id, zone_idx, x, y, w, h): text, score, corners on the page, and its box's contour and background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = ocr()
        for rows in batches:
            for page_id, data, blocks in zip(rows["page_id"], rows["image"], rows["blocks"], strict=True):
                image = images.decode(data)
                high, wide = image.shape[:2]
                values = raster.gray(image)
                label, out = raster.regions(values), []
                for b in blocks:
                    # a box may reach beyond the page; its bubble is searched on the page
                    x, y = min(max(b["x"], 0), wide - 1), min(max(b["y"], 0), high - 1)
                    w, h = max(1, min(b["x"] + b["w"], wide) - x), max(1, min(b["y"] + b["h"], high) - y)
                    bubble = raster.bubble(image, (x, y, w, h), values, label)
                    contour = None if bubble is None else [{"x": float(px), "y": float(py)} for px, py in bubble[0]]
                    colour = dict(zip("rgb", bubble[1], strict=True)) if bubble and bubble[1] else None
                    left, top = max(0, x - AROUND), max(0, y - AROUND)
                    for i, (text, score, corners) in enumerate(lines(image[top : y + h + AROUND, left : x + w + AROUND])):
                        placed = [{"x": float(px + left), "y": float(py + top)} for px, py in corners]
                        out.append((page_id, b["zone_idx"], i, text, float(score), placed, contour, colour))
                yield pd.DataFrame(out, columns=["page_id", "zone_idx", "line", "text", "score", "corners", "contour", "background"])

    # as many boxes as a page's suppression leaves
    blocks = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("zone_idx", "x", "y", "w", "h"))).alias("blocks"))
    grouped = raster.spread(pages.select("page_id", "image").join(blocks, "page_id"))
    point = "struct<x: double, y: double>"
    return grouped.mapInPandas(run, f"page_id bigint, zone_idx int, line int, text string, score double, corners array<{point}>, contour array<{point}>, background struct<r: int, g: int, b: int>")


def read(pages: DataFrame, detector: Detector, ocr: Ocr, min_confidence: float = merge.MIN_CONFIDENCE) -> DataFrame:
    """pages (page_id, direction, image) to zones: one for each bubble, or block without one."""
    boxes = detect.suppress(detect.decode(anchors(pages, detector)))
    lines = recognised(pages, boxes, ocr)
    zones = merge.same_bubble(merge.blocks(lines, min_confidence, keep=("contour", "background")))
    return zones.join(pages.select("page_id", "direction"), "page_id")
