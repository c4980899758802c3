"""Reading order of a page's zones: horizontal bands, then across each band.

zones: page_id, zone_idx, rect (quad), direction ("RTL" or "LTR"). Zones are sorted
by centre height; one opens a band when its centre is at or below the lowest
bottom seen in the band. As long as no box's bottom lies above its centre, the
running maximum over the whole page gives the same bands as one that starts anew
with each band, so the order is two windows over one partitioning of page_id. For
boxes upside down, fold=True walks each page's array instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import geometry as G


_CX, _CY, _LOW, _OPENS, _BAND = (f"__order_{x}" for x in ("cx", "cy", "low", "opens", "band"))


def _placed(zones: DataFrame) -> DataFrame:
    return zones.withColumns({_CX: G.centre_x(F.col("rect")), _CY: G.centre_y(F.col("rect")), _LOW: G.bottom(F.col("rect"))})


def bands(zones: DataFrame) -> DataFrame:
    """zones with their centres and band (from 1), in columns of private names."""
    walk = Window.partitionBy("page_id").orderBy(_CY, "zone_idx")
    before = F.max(_LOW).over(walk.rowsBetween(Window.unboundedPreceding, -1))
    opened = _placed(zones).withColumn(_OPENS, F.coalesce((F.col(_CY) >= before).cast("int"), F.lit(1)))
    return opened.withColumn(_BAND, F.sum(_OPENS).over(walk.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop(_LOW, _OPENS)


def bands_by_fold(zones: DataFrame) -> DataFrame:
    """The same by a walk over each page's zones; right for inverted quads too."""
    placed = _placed(zones)
    page = placed.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col(_CY).alias("cy"), "zone_idx", F.col(_LOW).alias("low")))).alias("z"))
    start = F.struct(F.lit(0).alias("band"), F.lit(float("-inf")).alias("low"), F.array().cast("array<struct<zone_idx:int,band:int>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        opens = (acc["band"] == 0) | (z["cy"] >= acc["low"])
        band = F.when(opens, acc["band"] + 1).otherwise(acc["band"])
        low = F.when(opens, z["low"]).otherwise(F.greatest(acc["low"], z["low"]))
        return F.struct(band.alias("band"), low.alias("low"), F.concat(acc["out"], F.array(F.struct(z["zone_idx"].cast("int").alias("zone_idx"), band.alias("band")))).alias("out"))

    out = page.select("page_id", F.explode(F.aggregate("z", start, step, lambda acc: acc["out"])).alias("o")).select("page_id", "o.zone_idx", F.col("o.band").alias(_BAND))
    return placed.drop(_LOW).join(out, ["page_id", "zone_idx"])


def reading_order(zones: DataFrame, fold: bool = False) -> DataFrame:
    """zones with rank (from 0): band by band, right to left or left to right, then from above."""
    banded = bands_by_fold(zones) if fold else bands(zones)
    across = F.when(F.coalesce(F.col("direction"), F.lit("RTL")) == "LTR", F.col(_CX)).otherwise(-F.col(_CX))
    place = Window.partitionBy("page_id").orderBy(_BAND, across, _CY, "zone_idx")
    return banded.withColumn("rank", F.row_number().over(place) - 1).drop(_CX, _CY, _BAND)


def reading_path(ordered: DataFrame) -> DataFrame:
    """Arrows between zones of consecutive ranks: page_id, rank, from_x, from_y, to_x, to_y; none for pages with unranked zones."""
    page = Window.partitionBy("page_id")
    walk = page.orderBy("rank")
    placed = ordered.select("page_id", "rank", G.centre_x(F.col("rect")).alias("to_x"), G.centre_y(F.col("rect")).alias("to_y"), (F.count("*").over(page) == F.count("rank").over(page)).alias("all"))
    arrows = placed.filter("all").select("page_id", "rank", F.lag("to_x").over(walk).alias("from_x"), F.lag("to_y").over(walk).alias("from_y"), "to_x", "to_y")
    return arrows.filter("from_x IS NOT NULL")
