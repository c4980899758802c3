"""Pixel work of a page in numpy: rasterising, bubble search, framing, erasing.

Images are height x width x 3 uint8 arrays in RGB; masks are booleans. Everything
is per page or per zone, inside Arrow-batched functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.sources import images

OPENINGS = (3, 5, 7, 10, 14)
STABLE = 0.15
COVER = 0.8
SEED_ROWS, SEED_GRAY, TOLERANCE = 6, 235, 20


def spread(rows: DataFrame) -> DataFrame:
    """rows by page_id, in as many partitions at least as there are cores: few bytes a row, much work, so that Spark would leave them to a few tasks."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, F.xxhash64("page_id"))  # of rows that are dealt by page_id itself, Spark would leave the step out


def gray(image: np.ndarray) -> np.ndarray:
    return np.rint(image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def detector_input(image: np.ndarray, size: int = 1024) -> np.ndarray:
    """1 x 3 x size x size floats in 0..1: bilinear, aspect not kept."""
    h, w = image.shape[:2]
    at = lambda n: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = ((n - n.astype(int)).astype(np.float32) for n in (y, x))
    p = np.ascontiguousarray(image.astype(np.float32).transpose(2, 0, 1)) / np.float32(255)
    left = p[:, :, x0]
    wide = left + (p[:, :, x1] - left) * fx  # columns first: whole rows are copied faster
    out, upper = np.empty((1, 3, size, size), np.float32), np.empty((size, size), np.float32)
    for rows, made in zip(wide, out[0], strict=True):
        np.take(rows, y0, axis=0, out=upper, mode="clip")
        np.take(rows, y1, axis=0, out=made, mode="clip")
        made -= upper
        made *= fy[:, None]
        made += upper
    return out


def fill_polygon(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mask of a polygon with whole-number vertices, boundary included."""
    pts = np.asarray(points, np.int64)
    following = np.roll(pts, -1, axis=0)
    (x0, y0), (x1, y1) = pts.T, following.T
    # each edge crosses the rows from its upper end to above its lower one; a row's crossings bound its spans in pairs
    top = np.maximum(np.minimum(y0, y1), 0)
    edge, step = _counted(np.maximum(np.minimum(np.maximum(y0, y1), height) - top, 0))
    y = top[edge] + step
    x = x0[edge] + (y - y0[edge]) * (x1 - x0)[edge] / (y1 - y0)[edge]
    order = np.lexsort((x, y))
    y, x = y[order][::2], x[order]
    first, last = (int(y[0]), int(y[-1]) + 1) if len(y) else (0, 0)
    lo, hi = np.maximum(np.ceil(x[::2] - 1e-9), 0).astype(int), np.minimum(np.floor(x[1::2] + 1e-9), width - 1).astype(int)
    full = hi >= lo
    ends = np.zeros((last - first, width + 1), np.int32)
    np.add.at(ends, (y[full] - first, lo[full]), 1)
    np.add.at(ends, (y[full] - first, hi[full] + 1), -1)
    mask = np.zeros((height, width), bool)
    mask[first:last] = np.cumsum(ends[:, :width], axis=1) > 0
    # the boundary itself
    n = np.maximum(np.maximum(np.abs(x1 - x0), np.abs(y1 - y0)), 1)
    edge, step = _counted(n + 1)
    x = np.rint(x0[edge] + (x1 - x0)[edge] * step / n[edge]).astype(int)
    y = np.rint(y0[edge] + (y1 - y0)[edge] * step / n[edge]).astype(int)
    ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    mask[y[ok], x[ok]] = True
    return mask


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as its count says, and the number of each among its own, from 0."""
    place = np.repeat(np.arange(len(counts)), counts)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)


def largest_in_histogram(heights: np.ndarray) -> tuple[int, int, int, int]:
    """(area, start, width, height) of the largest rectangle under a histogram; the first found of equal ones."""
    best, stack = (0, 0, 0, 0), []
    new = np.flatnonzero(np.diff(heights, prepend=-1))  # where a run of equal heights begins
    for i, h in zip([*new.tolist(), len(heights)], [*heights[new].tolist(), 0], strict=True):
        start = i
        while stack and stack[-1][1] >= h:
            start, tall = stack.pop()
            if tall * (i - start) > best[0]:
                best = (tall * (i - start), start, i - start, tall)
        stack.append((start, h))
    return best


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, w, h) of the largest rectangle inside a mask."""
    best, heights = (0, None), np.zeros(mask.shape[1], np.int64)
    for y in range(mask.shape[0]):
        heights = np.where(mask[y], heights + 1, 0)
        area, x, w, h = largest_in_histogram(heights)
        if area > best[0]:
            best = (area, (x, y - h + 1, w, h))
    return best[1]


def framed(points: np.ndarray) -> tuple[float, float, float, float] | None:
    """Largest rectangle inside a polygon; None for a mask of no pixel (the zone keeps its rectangle)."""
    if len(points) < 3:
        return None
    low, high = points.min(axis=0), points.max(axis=0)
    w, h = np.ceil(high - low).astype(int)
    if w < 1 or h < 1:
        return None
    found = largest_rectangle(fill_polygon(np.rint(points - low).astype(int), w, h))  # half to even
    return None if found is None else (found[0] + low[0], found[1] + low[1], float(found[2]), float(found[3]))


def frame(zones: DataFrame, keep_contour: bool = True) -> DataFrame:
    """zones (x, y, w, h, contour, and any columns) with the rectangle fitted inside the contour, if it has three points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            boxes, known = rows[["x", "y", "w", "h"]].to_numpy(float), {}
            for i, contour in enumerate(rows["contour"]):
                if contour is not None and len(contour) >= 3:
                    points = np.array([[p["x"], p["y"]] for p in contour], float)
                    key = points.tobytes()  # linked zones share their contour
                    if key not in known:
                        known[key] = framed(points)
                    found = known[key]
                    if found:
                        boxes[i] = found
            yield rows.assign(x=boxes[:, 0], y=boxes[:, 1], w=boxes[:, 2], h=boxes[:, 3])[names]

    sides = {c: F.col(c).cast("double") for c in "xywh"}
    picked = zones.withColumns(sides)
    names = [c for c in picked.columns if c != "contour" or keep_contour]
    return picked.mapInPandas(run, picked.select(*[f"`{c}`" for c in names]).schema)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's part, for n things linked by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def regions(values: np.ndarray, tolerance: int = TOLERANCE) -> np.ndarray:
    """Labels of parts whose 4-neighbours differ by no more than the tolerance: runs along rows, linked between rows."""
    v = values.astype(np.int16)
    run = np.cumsum(np.concatenate((np.ones((len(v), 1), bool), np.abs(np.diff(v, axis=1)) > tolerance), axis=1).reshape(-1)).reshape(v.shape) - 1
    near = np.abs(np.diff(v, axis=0)) <= tolerance
    a, b = run[:-1][near], run[1:][near]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else []
    return _joined(int(run[-1, -1]) + 1, a[new], b[new])[run]


def flood(values: np.ndarray, seed: tuple[int, int], tolerance: int = TOLERANCE) -> np.ndarray:
    """Pixels reached from the seed (y, x) over 4-neighbours that differ by no more than the tolerance."""
    label = regions(values, tolerance)
    return label == label[seed]


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected parts, from 1; 0 outside."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # one beyond the run
    wide = mask.shape[1] + 2
    # runs of the row below that touch, corners included
    first = np.searchsorted(row * wide + end, (row + 1) * wide + begin)
    count = np.maximum(0, np.searchsorted(row * wide + begin, (row + 1) * wide + end, "right") - first)
    above = np.repeat(np.arange(len(row)), count)
    below = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    label = np.zeros(mask.shape, np.int64)
    label[mask] = np.repeat(_joined(len(row), above, below), end - begin) + 1
    return label


#: Eight neighbours (y, x), clockwise on the screen from the left.
_TURN = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer border (x, y), clockwise, of the part of a mask whose border holds the largest area; empty for none."""
    y, x = np.nonzero(mask)
    if not len(y):
        return np.zeros((0, 2), int)
    label = components(mask)[y, x]
    kinds, part = np.unique(label, return_inverse=True)
    box = np.array([[np.iinfo(np.int64).max] * 2 + [-1] * 2] * len(kinds))
    np.minimum.at(box[:, 0], part, x)
    np.minimum.at(box[:, 1], part, y)
    np.maximum.at(box[:, 2], part, x)
    np.maximum.at(box[:, 3], part, y)
    bound = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])  # no area is larger
    best, most = np.zeros((0, 2), int), -1.0
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] <= most:
            break
        x0, y0, x1, y1 = box[k].tolist()
        own = np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
        own[y[part == k] - y0, x[part == k] - x0] = True
        points = _border(own) + (x0, y0)
        if (area := polygon_area(points)) > most:
            best, most = points, area
    return best


def _border(mask: np.ndarray) -> np.ndarray:
    """Outer border (x, y) of a mask of one part, clockwise."""
    part = np.pad(mask, 1).tolist()
    x, y = mask[0].argmax().item() + 1, 1
    start, at, back, out, second = (y, x), (y, x), 0, [], None  # the pixel to the left of the first one is outside
    while True:
        for k in range(1, 9):
            turn = (back + k) % 8
            to = (at[0] + _TURN[turn][0], at[1] + _TURN[turn][1])
            if part[to[0]][to[1]]:
                break
        else:
            return np.array([(x - 1, y - 1)])
        if at == start and to == second:
            return np.array(out)
        second = second or to
        out.append((at[1] - 1, at[0] - 1))
        # go on from the outside neighbour that was seen last, as the new pixel sees it
        last = (at[0] + _TURN[(turn - 1) % 8][0], at[1] + _TURN[(turn - 1) % 8][1])
        at, back = to, _TURN.index((last[0] - to[0], last[1] - to[1]))


def _spread(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilated by a disc: rows are spread by its half-width at each distance, through running sums."""
    h, w = mask.shape
    sums = np.cumsum(np.pad(mask, ((0, 0), (radius + 1, radius))), axis=1, dtype=np.int32)
    out = np.zeros_like(mask)
    for dy in range(min(radius, h - 1) + 1):
        half = int(math.isqrt(radius * radius + radius - dy * dy))
        half = min(half, radius)
        wide = sums[:, radius + 1 + half : radius + 1 + half + w] > sums[:, radius - half : radius - half + w]
        out[dy:] |= wide[: h - dy]
        if dy:
            out[:-dy] |= wide[dy:]
    return out


def opened(mask: np.ndarray, radius: int, block: tuple[int, int, int, int]) -> np.ndarray:
    """Eroded, the part with most pixels in the block kept, dilated."""
    label = components(~_spread(~mask, radius))
    x, y, w, h = block
    inside = label[max(0, y) : y + h, max(0, x) : x + w]
    kinds, counts = np.unique(inside[inside > 0], return_counts=True)
    return _spread(label == kinds[np.argmax(counts)], radius) if len(kinds) else np.zeros_like(mask)


def seeds(values: np.ndarray, block: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Bright pixels at a half, a quarter and three quarters of the block's brightest rows."""
    x, y, w, h = block
    rows = np.argsort(-values[y : y + h, x : x + w].mean(axis=1), kind="stable")[:SEED_ROWS]
    out = []
    for row in rows.tolist():
        for part in (2, 1, 3):
            if values[y + row, min(x + w * part // 4, values.shape[1] - 1)] >= SEED_GRAY:
                out.append((y + row, min(x + w * part // 4, values.shape[1] - 1)))
                break
    return out


def covers(points: np.ndarray, block: tuple[int, int, int, int]) -> bool:
    if len(points) < 3:
        return False
    size = points.max(axis=0) - points.min(axis=0) + 1
    return bool(size[0] >= COVER * block[2] and size[1] >= COVER * block[3])


def bubble(image: np.ndarray, block: tuple[int, int, int, int], values: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, tuple[int, int, int] | None] | None:
    """Contour and mean colour of the bubble around a block (x, y, w, h); None if no seed's region covers it.

    values and label are gray(image) and its regions(), which the blocks of a page can share. Openings are
    compared by the area inside the outer contour, so text inside costs nothing; one that leaves no contour
    ends the search with the last one.
    """
    values = gray(image) if values is None else values
    label = regions(values) if label is None else label
    for seed in seeds(values, block):
        raw = label == label[seed]
        kept = contour(raw)
        if covers(kept, block):
            break
    else:
        return None
    # all further work is done around the region; beyond, nothing is set
    ys, xs = np.flatnonzero(raw.any(axis=1)), np.flatnonzero(raw.any(axis=0))
    top, left = max(0, int(ys[0]) - max(OPENINGS)), max(0, int(xs[0]) - max(OPENINGS))
    near = raw[top : int(ys[-1]) + max(OPENINGS) + 1, left : int(xs[-1]) + max(OPENINGS) + 1]
    area = polygon_area(kept)
    for radius in OPENINGS:
        now = contour(opened(near, radius, (block[0] - left, block[1] - top, block[2], block[3]))) + (left, top)
        if len(now) < 3 or area <= 0 or area - polygon_area(now) <= STABLE * area:
            break
        kept, area = now, polygon_area(now)
    if not covers(kept, block):
        return None
    inside = near & fill_polygon(kept - (left, top), near.shape[1], near.shape[0])
    if not inside.any():
        return kept, None
    colours = image[top : top + near.shape[0], left : left + near.shape[1]][inside]
    return kept, tuple(int(c) for c in np.clip(np.rint(colours.mean(axis=0)), 0, 255))


def erase(image: np.ndarray, zones: list[tuple[np.ndarray, tuple[int, int, int]]]) -> np.ndarray:
    """A copy with each usable contour filled by its colour."""
    out = image.copy()
    for points, colour in zones:
        if len(points) >= 3:
            out[fill_polygon(np.rint(points).astype(int), image.shape[1], image.shape[0])] = colour
    return out


def erase_pages(pages: DataFrame, zones: DataFrame, fallback: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """pages (page_id, image, any columns) with each usable contour of their zones filled, by its background or the fallback, as PNG.

    A page without such a zone is written again as it is; an unreadable image is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for data, shapes in zip(rows["image"], rows["__erase"], strict=True):
                todo = [] if shapes is None else [(np.array([[p["x"], p["y"]] for p in s["contour"]], float), fallback if s["background"] is None else tuple(s["background"][c] for c in "rgb")) for s in shapes]
                done.append(images.encode(erase(images.decode(data), todo)))
            yield rows.assign(image=done)[names]

    names = pages.columns
    shapes = zones.filter(F.size("contour") >= 3).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("zone_idx", "contour", "background"))).alias("__erase"))
    return spread(pages.join(shapes, "page_id", "left")).mapInPandas(run, pages.schema)
