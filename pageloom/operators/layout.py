"""Laying translated text out in its zone: font size, lines and their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions import text as T

MIN_SIZE, STEP = 8, 2


def rewritable(contour: Column, text: Column) -> Column:
    """Usable bubble and a translation that isn't empty."""
    return G.usable(contour) & (F.coalesce(F.length(text), F.lit(0)) > 0)


def background(measured: Column, fallback: Column) -> Column:
    return F.coalesce(measured, fallback)


def sizes(line_height: Column, ratio: float) -> Column:
    """Font sizes to try: from the measured line height down by STEP, then MIN_SIZE."""
    start = F.greatest(F.lit(float(MIN_SIZE)), line_height / ratio)
    steps = F.floor((start - MIN_SIZE) / STEP).cast("int")
    tried = F.filter(F.transform(F.sequence(F.lit(0), steps), lambda k: start - k * STEP), lambda s: s > MIN_SIZE)
    return F.concat(tried, F.array(F.lit(float(MIN_SIZE))))


def layout(zones: DataFrame, ratio: float = 0.7, glyph: float = 0.5, leading: float = 1.2) -> DataFrame:
    """zones (text_dst, line_height, box_w, box_h, ...) with font_size, lines and line_step.

    glyph: mean glyph width over font size; leading: line step over font size. A
    zone to rewrite must have a line height.
    """
    step = lambda size: size * leading
    fit = lambda size: T.wrapped(F.col("text_dst"), F.col("box_w"), lambda s: F.length(s) * size * glyph)
    tried = F.transform(sizes(F.col("line_height"), ratio), lambda s: F.struct(s.alias("font_size"), fit(s).alias("lines")))
    good = F.filter(tried, lambda t: F.size(t["lines"]) * step(t["font_size"]) <= F.col("box_h"))
    chosen = F.coalesce(F.get(good, F.lit(0)), F.element_at(tried, -1))
    checked = F.when(F.col("line_height").isNull(), F.raise_error(F.lit("a zone to rewrite has no line height"))).otherwise(chosen)
    made = zones.withColumn("__fit", checked)
    return made.select(*zones.columns, "__fit.font_size", "__fit.lines", (F.col("__fit.font_size") * leading).alias("line_step"))


def placed_lines(laid: DataFrame, glyph: float = 0.5) -> DataFrame:
    """One row per line: centred across, the block centred down. Needs centre_x and centre_y."""
    rows = laid.select("*", F.posexplode("lines").alias("line", "words"))
    top = F.col("centre_y") - F.size("lines") * F.col("line_step") / 2
    return rows.withColumns({"line_x": F.col("centre_x") - F.length("words") * F.col("font_size") * glyph / 2, "line_y": top + F.col("line") * F.col("line_step")}).drop("lines")
