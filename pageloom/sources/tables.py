"""The driver's tables as pages, zones, anchors, dialogue, users and attempts.

Geometry is made by whole-number arithmetic, so that centres are exact. Each
binding exists as DataFrame and as the SQL that the oracle starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions import geometry as G

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
PAGE_W, PAGE_H = 1200, 1700


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, zone_idx, direction, x, y, w, h, score, confidence, shape (0 to 2, null: no bubble), line_height."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        number.alias("zone_idx"),
        F.when(F.col("l_orderkey") % 2 == 0, "RTL").otherwise("LTR").alias("direction"),
        (F.col("l_partkey") * 37 % 1100).alias("x"),
        (F.col("l_suppkey") * 53 % 1600).alias("y"),
        (40 + F.col("l_quantity").cast("bigint") * 6).alias("w"),
        (20 + F.col("l_partkey") % 23 * 8).alias("h"),
        F.round(1 - F.col("l_discount") * 6, 2).alias("score"),
        F.round(1 - F.col("l_tax"), 2).alias("confidence"),
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 3).alias("shape"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") * 4 + 16).cast("double").alias("line_height"),
        (F.col("l_partkey") % 360 - 180).cast("double").alias("angle"),
        F.concat(F.lit("word"), F.col("l_linenumber").cast("string"), F.lit(" "), F.col("l_returnflag")).alias("text_src"),
    )


BOXES = f"""
    SELECT l_orderkey AS page_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1)::INT AS zone_idx,
           CASE WHEN l_orderkey % 2 = 0 THEN 'RTL' ELSE 'LTR' END AS direction,
           l_partkey * 37 % 1100 AS x, l_suppkey * 53 % 1600 AS y, 40 + l_quantity::BIGINT * 6 AS w, 20 + l_partkey % 23 * 8 AS h,
           round(1 - l_discount * 6, 2) AS score, round(1 - l_tax, 2) AS confidence,
           CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 3 END AS shape,
           CASE WHEN l_linestatus = 'O' THEN (l_linenumber * 4 + 16)::DOUBLE END AS line_height,
           (l_partkey % 360 - 180)::DOUBLE AS angle,
           'word' || l_linenumber || ' ' || l_returnflag AS text_src
    FROM lineitem"""


def polygon(*points: tuple[float, float]):
    return F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in points])


SHAPES = {0: ((0, 0), (10, 0), (10, 10), (0, 10)), 1: ((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)), 2: ((0, 0), (12, 0), (6, 9))}


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes as zones: rect (quad), contour (null for none), background."""
    b = boxes(spark, sf_dir)
    contour = F.when(F.col("shape") == 0, polygon(*SHAPES[0])).when(F.col("shape") == 1, polygon(*SHAPES[1])).when(F.col("shape") == 2, polygon(*SHAPES[2]))
    colour = F.struct(*[(F.col("x") * k % 256).cast("int").alias(c) for k, c in ((3, "r"), (5, "g"), (7, "b"))])
    return b.withColumns({"rect": G.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")), "contour": contour, "background": F.when(F.col("shape").isNotNull(), colour)})


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.translate("c_name", "#", "_")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("username"), F.upper(name).alias("normalized_username"), F.concat(F.lit("password"), F.col("c_custkey").cast("string")).alias("password_hash"))


USERS = "SELECT c_custkey AS id, replace(c_name, '#', '_') AS username, upper(replace(c_name, '#', '_')) AS normalized_username, 'password' || c_custkey AS password_hash FROM customer"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, username, password from the events: known, fresh and bad names, short and long passwords."""
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    name = F.when(e % 5 == 0, F.concat(F.lit("Customer_"), F.lpad(u, 9, "0"))).when(e % 5 == 1, F.concat(F.lit("user-"), u)).when(e % 5 == 2, F.concat(F.lit("a!"), u)).when(e % 5 == 3, F.lit("jo")).otherwise(F.concat(F.lit("New_"), e.cast("string")))
    word = F.when(e % 7 == 0, F.lit("short")).when(e % 7 == 1, F.repeat(F.lit("x"), 129)).otherwise(F.concat(F.lit("password"), u))
    return table(spark, sf_dir, "events").select(e.alias("attempt_id"), name.alias("username"), word.alias("password"))


ATTEMPTS = """
    SELECT event_id AS attempt_id,
           CASE event_id % 5 WHEN 0 THEN 'Customer_' || lpad(user_id::VARCHAR, 9, '0') WHEN 1 THEN 'user-' || user_id
                WHEN 2 THEN 'a!' || user_id WHEN 3 THEN 'jo' ELSE 'New_' || event_id END AS username,
           CASE event_id % 7 WHEN 0 THEN 'short' WHEN 1 THEN repeat('x', 129) ELSE 'password' || user_id END AS password
    FROM events"""
