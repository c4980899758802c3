"""Queries over the driver's tables, one for each operator or family, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import decoding as D
from pageloom.functions import geometry as G
from pageloom.functions import text as T
from pageloom.operators import accounts, detect, layout, merge, order, raster, translate
from pageloom.plans.pages import page_chain
from pageloom.sources import config, images, tables
from pageloom.sources.tables import ATTEMPTS, BOXES, USERS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


_BANDS = f"""
    WITH b AS ({BOXES}),
    c AS (SELECT *, x + w / 2.0 AS cx, y + h / 2.0 AS cy, (y + h)::DOUBLE AS low FROM b),
    o AS (SELECT *, CASE WHEN cy >= max(low) OVER (PARTITION BY page_id ORDER BY cy, zone_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                    OR row_number() OVER (PARTITION BY page_id ORDER BY cy, zone_idx) = 1 THEN 1 ELSE 0 END AS opens FROM c),
    d AS (SELECT *, sum(opens) OVER (PARTITION BY page_id ORDER BY cy, zone_idx ROWS UNBOUNDED PRECEDING) AS band FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY band, CASE WHEN direction = 'LTR' THEN cx ELSE -cx END, cy, zone_idx) - 1 AS rank FROM d)"""


@query(f"{_BANDS} SELECT page_id, zone_idx, direction, rank::INT AS rank FROM r")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.reading_order(tables.zones(spark, sf_dir)).select("page_id", "zone_idx", "direction", "rank")


@query(f"{_BANDS} SELECT page_id, zone_idx, direction, rank::INT AS rank FROM r")
def reading_order_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.reading_order(tables.zones(spark, sf_dir), fold=True).select("page_id", "zone_idx", "direction", "rank")


@query(f"""{_BANDS}, l AS (SELECT page_id, rank, lag(cx) OVER w AS from_x, lag(cy) OVER w AS from_y, cx AS to_x, cy AS to_y FROM r WINDOW w AS (PARTITION BY page_id ORDER BY rank))
    SELECT page_id, rank::INT AS rank, from_x, from_y, to_x, to_y FROM l WHERE from_x IS NOT NULL""")
def reading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.reading_path(order.reading_order(tables.zones(spark, sf_dir)))


_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SENTENCES = (
    "list_filter(list_transform(regexp_extract_all(text, '(?s)([^.!?…]*[.!?…]+|[^.!?…]+)', 1), lambda s: "
    + _TRIM.format("s")
    + "), lambda s: s <> '')"
)


@query(f"""SELECT conv_id, turn, generate_subscripts(p, 1)::INT - 1 AS part, unnest(p) AS sentence
    FROM (SELECT conv_id, turn, CASE WHEN len({_SENTENCES}) > 0 THEN {_SENTENCES} ELSE [text] END AS p FROM conversations)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("part", "sentence"))


@query(f"""SELECT doc_id, len(p)::INT AS n_sentences, list_max(list_transform(p, lambda s: length(s)))::INT AS longest
    FROM (SELECT doc_id, CASE WHEN len({_SENTENCES}) > 0 THEN {_SENTENCES} ELSE [text] END AS p FROM documents)""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_sentences"), F.array_max(F.transform("p", lambda s: F.length(s))).alias("longest"))


_AZ, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LONE_I = r"'(^|[^\p{L}\p{M}\p{N}_])i($|[^\p{L}\p{M}\p{N}_])', '\1I\2', 'g'"
_CALM = rf"""CASE WHEN regexp_matches({{0}}, '\p{{{{Ll}}}}') OR NOT regexp_matches({{0}}, '\p{{{{Lu}}}}') THEN {{0}} ELSE (SELECT regexp_replace(regexp_replace(h || upper(f) || substr(l, length(h) + 2), {_LONE_I.replace('{', '{{').replace('}', '}}')}), {_LONE_I.replace('{', '{{').replace('}', '}}')})
    FROM (SELECT lower({{0}}) AS l, regexp_extract(lower({{0}}), '^(\P{{{{L}}}}*)(\p{{{{L}}}})', 1) AS h, regexp_extract(lower({{0}}), '^(\P{{{{L}}}}*)(\p{{{{L}}}})', 2) AS f)) END"""


@query(f"SELECT conv_id, turn, {_CALM.format('text')} AS kept, {_CALM.format('shout')} AS calmed FROM (SELECT *, translate(text, '{_AZ}', '{_UP}') AS shout FROM conversations)")
def case_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as they are, and with a to z as capitals: shouted ones are calmed, others stay."""
    rows = table(spark, sf_dir, "conversations").withColumn("shout", F.translate("text", _AZ, _UP))
    return rows.select("conv_id", "turn", T.calmed(F.col("text")).alias("kept"), T.calmed(F.col("shout")).alias("calmed"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda s: s <> '') AS words FROM conversations),
    f AS (SELECT conv_id, turn, words, CASE WHEN len(words) = 0 THEN [['']] ELSE list_reduce(list_transform(words, lambda s: [[s]]),
        lambda a, b: CASE WHEN length(a[len(a)][1]) + 1 + length(b[1][1]) <= 24 THEN list_concat(a[1:len(a) - 1], [[a[len(a)][1] || ' ' || b[1][1]]]) ELSE list_concat(a, b) END) END AS l FROM w)
    SELECT conv_id, turn, len(l)::INT AS n_lines, list_max(list_transform(l, lambda s: length(s[1])))::INT AS widest, array_to_string(list_transform(l, lambda s: s[1]), '|') AS lines FROM f""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrapped(F.col("text"), F.lit(24)).alias("l"))
    return rows.select("conv_id", "turn", F.size("l").alias("n_lines"), F.array_max(F.transform("l", lambda s: F.length(s))).alias("widest"), F.array_join("l", "|").alias("lines"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return b.select(
        "page_id", F.col("zone_idx").alias("i"), (F.col("x") % 300 + F.col("w") / 2).alias("cx"), (F.col("y") % 300 + F.col("h") / 2).alias("cy"), "w", "h", "score", F.lit(2048).alias("page_w"), F.lit(1536).alias("page_h")
    )


_ANCHORS = f"SELECT page_id, zone_idx AS i, x % 300 + w / 2.0 AS cx, y % 300 + h / 2.0 AS cy, w, h, score FROM ({BOXES})"
_DECODED = f"SELECT page_id, i, trunc((cx - w / 2.0) * 2)::INT AS x, trunc((cy - h / 2.0) * 1.5)::INT AS y, trunc(w * 2)::INT AS w, trunc(h * 1.5)::INT AS h, score FROM ({_ANCHORS}) WHERE score >= 0.5"


@query(_DECODED)
def decode_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.decode(_anchors(spark, sf_dir))


_OVERLAP = "(CASE WHEN least({a}.w * {a}.h, {b}.w * {b}.h) > 0 THEN greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))::DOUBLE / least({a}.w * {a}.h, {b}.w * {b}.h) ELSE 0 END)"


@query(f"""WITH RECURSIVE d AS ({_DECODED}),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS r FROM d),
    top AS (SELECT page_id, max(r) AS m FROM n GROUP BY page_id),
    k AS (SELECT page_id, 0::BIGINT AS r, []::STRUCT(x INT, y INT, w INT, h INT, score DOUBLE, i BIGINT)[] AS kept FROM top
          UNION ALL
          SELECT k.page_id, n.r, CASE WHEN len(list_filter(k.kept, lambda q: {_OVERLAP.format(a="q", b="n")} > 0.4)) > 0 THEN k.kept
                 ELSE list_append(k.kept, {{'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h, 'score': n.score, 'i': n.i::BIGINT}}) END
          FROM k JOIN n ON n.page_id = k.page_id AND n.r = k.r + 1),
    u AS (SELECT page_id, unnest(kept) AS b FROM k JOIN top USING (page_id) WHERE r = m)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY b.y, b.x, b.score DESC, b.i) - 1)::INT AS zone_idx, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.score AS score, b.i AS i FROM u""")
def suppress_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.suppress(detect.decode(_anchors(spark, sf_dir)))


@query(f"WITH d AS ({_DECODED}) SELECT p.page_id AS page_id, p.i AS a, q.i AS b FROM d p JOIN d q ON p.page_id = q.page_id AND p.i < q.i AND {_OVERLAP.format(a='p', b='q')} > 0.4")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.overlapping_pairs(detect.decode(_anchors(spark, sf_dir)))


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zones of a page make a block; corners come in mixed order."""
    b = tables.boxes(spark, sf_dir)
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    corners = F.array(G.point(x + w, y + h), G.point(x, y), G.point(x + w, y), G.point(x, y + h))
    return b.select("page_id", F.floor(F.col("zone_idx") / 2).cast("int").alias("zone_idx"), F.col("zone_idx").alias("line"), F.when(F.col("x") % 7 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), "text_src", F.lit("  "))).alias("text"), "score", corners.alias("corners"))


@query(f"""WITH b AS (SELECT page_id, zone_idx // 2 AS z, zone_idx AS line, text_src, x, y, w, h, score FROM ({BOXES}) WHERE x % 7 <> 0)
    SELECT page_id, z::INT AS zone_idx, string_agg(text_src, ' ' ORDER BY y + h / 2.0, x + w / 2.0, line) AS text_src, min(score) AS confidence, round(avg(h), 6) AS line_height, 0.0::DOUBLE AS angle,
           min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x + w)::DOUBLE AS x1, max(y + h)::DOUBLE AS y1, count(*) AS n_lines
    FROM b GROUP BY page_id, z HAVING min(score) >= 0.5""")
def block_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merge.blocks(_ocr(spark, sf_dir))
    at = lambda c, k: F.col(f"rect.{c}.{k}")
    return made.select("page_id", "zone_idx", "text_src", "confidence", _r(F.col("line_height")).alias("line_height"), _r(F.col("angle")).alias("angle"), at("hg", "x").alias("x0"), at("hg", "y").alias("y0"), at("bd", "x").alias("x1"), at("bd", "y").alias("y1"), "n_lines")


@query(f"""WITH b AS ({BOXES}), m AS (SELECT page_id, coalesce(shape, 10 + zone_idx) AS g, min(zone_idx) AS zone_idx, string_agg(text_src, ' ' ORDER BY zone_idx) AS text_src, min(confidence) AS confidence,
      round(avg(line_height), 6) AS line_height, CASE WHEN count(*) = 1 THEN min(angle) ELSE degrees(atan2(sum(sin(radians(angle))), sum(cos(radians(angle))))) END AS angle, count(*) AS fragments,
      min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x + w)::DOUBLE AS x1, max(y + h)::DOUBLE AS y1, min_by(x * 3 % 256, zone_idx)::INT AS red, sqrt(pow(sum(sin(radians(angle))), 2) + pow(sum(cos(radians(angle))), 2)) AS force
      FROM b GROUP BY page_id, coalesce(shape, 10 + zone_idx))
    SELECT page_id, zone_idx, text_src, confidence, line_height, CASE WHEN force > 1e-6 THEN round(CASE WHEN angle <= -179.9999 THEN angle + 360 ELSE angle END, 4) END AS angle, fragments, x0, y0, x1, y1, CASE WHEN g < 10 THEN red END AS red FROM m""")
def merge_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = tables.zones(spark, sf_dir)
    made = merge.same_bubble(zones)
    at = lambda c, k: F.col(f"rect.{c}.{k}")
    # opposite angles cancel out: there the mean is noise, and null in both
    force = zones.groupBy("page_id", "contour", F.when(F.col("contour").isNull(), F.col("zone_idx")).otherwise(-1).alias("alone")).agg(
        F.min("zone_idx").alias("zone_idx"), F.hypot(F.sum(F.sin(F.radians("angle"))), F.sum(F.cos(F.radians("angle")))).alias("force")
    ).select("page_id", "zone_idx", "force")
    made = made.join(force, ["page_id", "zone_idx"])
    half = F.when(F.col("angle") <= -179.9999, F.col("angle") + 360).otherwise(F.col("angle"))
    return made.select("page_id", "zone_idx", "text_src", "confidence", _r(F.col("line_height")).alias("line_height"), F.when(F.col("force") > 1e-6, _r(half, 4)).alias("angle"), "fragments", at("hg", "x").alias("x0"), at("hg", "y").alias("y0"), at("bd", "x").alias("x1"), at("bd", "y").alias("y1"), F.col("background.r").alias("red"))


@query(f"""SELECT page_id, zone_idx, round((sqrt(w*w + 49.0) + sqrt(w*w + 49.0)) / 2, 6) AS width, round((sqrt(h*h + 9.0) + sqrt(h*h + 9.0)) / 2, 6) AS height,
      (x + (x + w) + (x + w + 3) + (x + 3)) / 4.0 AS cx, (y + (y + 7) + (y + h + 7) + (y + h)) / 4.0 AS cy, round(degrees(atan2(14.0, 2.0 * w)), 6) AS angle, round(sqrt((w + 3.0) * (w + 3) + (h + 7.0) * (h + 7)), 6) AS diagonal FROM ({BOXES})""")
def quad_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    q = G.quad(G.point(x, y), G.point(x + w, y + 7), G.point(x + w + 3, y + h + 7), G.point(x + 3, y + h))
    rows = tables.boxes(spark, sf_dir).withColumn("q", q)
    q = F.col("q")
    return rows.select("page_id", "zone_idx", _r(G.width(q)).alias("width"), _r(G.height(q)).alias("height"), G.centre_x(q).alias("cx"), G.centre_y(q).alias("cy"), _r(G.angle(q)).alias("angle"), _r(G.distance(q["hg"], q["bd"])).alias("diagonal"))


@query(f"""WITH p AS (SELECT page_id, zone_idx, shape, x % 14 + 0.5 AS px, y % 12 + 0.3 AS py FROM ({BOXES}) WHERE shape IS NOT NULL)
    SELECT page_id, zone_idx, CASE shape WHEN 0 THEN px < 10 AND py < 10 WHEN 1 THEN (px < 10 AND py < 4) OR (px < 4 AND py < 10) ELSE py < 9 AND px > py * 6 / 9 AND px < 12 - py * 6 / 9 END AS inside,
      CASE shape WHEN 2 THEN 6.0 WHEN 1 THEN 28 / 6.0 ELSE 5.0 END::DOUBLE AS mean_x, CASE shape WHEN 2 THEN 12.0 ELSE 10.0 END::DOUBLE AS x1, CASE shape WHEN 2 THEN 9.0 ELSE 10.0 END::DOUBLE AS y1 FROM p""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.zones(spark, sf_dir).filter("contour IS NOT NULL")
    c = F.col("contour")
    return z.select("page_id", "zone_idx", G.contains(c, F.col("x") % 14 + 0.5, F.col("y") % 12 + 0.3).alias("inside"), G.centroid(c)["x"].alias("mean_x"), G.bounds(c)["x1"].alias("x1"), G.bounds(c)["y1"].alias("y1"))


@query(f"""SELECT page_id, zone_idx, greatest(0, x - 12) AS x, greatest(0, y - 12) AS y, greatest(1, least(1200, x + w + 12) - greatest(0, x - 12)) AS w, greatest(1, least(1700, y + h + 12) - greatest(0, y - 12)) AS h,
      coalesce(CASE shape WHEN 2 THEN 12 >= 0.8 * (w / 20) AND 9 >= 0.8 * (h / 20) ELSE 10 >= 0.8 * (w / 20) AND 10 >= 0.8 * (h / 20) END AND shape IS NOT NULL, false) AS covered FROM ({BOXES})""")
def crop_and_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.zones(spark, sf_dir)
    box = F.struct("x", "y", "w", "h")
    small = F.struct((F.col("w") / 20).alias("w"), (F.col("h") / 20).alias("h"))
    grown = G.expanded(box, F.lit(tables.PAGE_W), F.lit(tables.PAGE_H))
    return z.select("page_id", "zone_idx", grown["x"].alias("x"), grown["y"].alias("y"), grown["w"].alias("w"), grown["h"].alias("h"), G.covers(F.col("contour"), small).alias("covered"))


@query(f"""SELECT page_id, zone_idx, x::DOUBLE AS ax, (y + 1)::DOUBLE AS ay, (x + w)::DOUBLE AS bx, y::DOUBLE AS by_, (x + w)::DOUBLE AS cx, (y + h)::DOUBLE AS cy, x::DOUBLE AS dx, (y + h + 1)::DOUBLE AS dy FROM ({BOXES})""")
def relabel_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    mixed = F.array(G.point(x, y + h + 1), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + 1))
    rows = tables.boxes(spark, sf_dir).withColumn("q", G.relabelled(mixed))
    return rows.select("page_id", "zone_idx", *[F.col(f"q.{c}.{k}").alias(f"{n}{k}" + ("_" if n + k == "by" else "")) for c, n in (("hg", "a"), ("hd", "b"), ("bd", "c"), ("bg", "d")) for k in ("x", "y")])


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS id, unnest(embedding)::DOUBLE AS score FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) AS place FROM e)
    SELECT vec_id, place::INT - 1 AS place, id::INT AS id, score FROM r WHERE place <= 4""")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(D.top_k(F.col("embedding").cast("array<double>"), 4)).alias("place", "t"))
    return rows.select("vec_id", "place", "t.id", "t.score")


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS id, unnest(embedding)::DOUBLE AS z FROM embeddings),
    m AS (SELECT vec_id, max(z) AS most FROM e GROUP BY vec_id), s AS (SELECT vec_id, most, ln(sum(exp(z - most))) AS total FROM e JOIN m USING (vec_id) GROUP BY vec_id, most)
    SELECT vec_id, id::INT AS id, round(z - most - total, 6) AS log_p FROM e JOIN s USING (vec_id) WHERE id <> 1""")
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(D.log_softmax(F.col("embedding").cast("array<double>"), pad=1)).alias("id", "log_p"))
    return rows.filter("id <> 1").select("vec_id", "id", _r(F.col("log_p")).alias("log_p"))


@query("""WITH h AS (SELECT vec_id, k, embedding[k]::DOUBLE * 4 AS score, 1 + (vec_id + k) % 5 AS n FROM embeddings, (VALUES (1), (2), (3), (4)) t(k)),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score / n DESC, k) AS r FROM h)
    SELECT vec_id, k::INT AS hypothesis, round(score / n, 6) AS norm, least(512, 3 * n + 20)::INT AS cap FROM b WHERE r = 1""")
def best_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    def hypothesis(k: int):
        return F.struct(F.array_repeat(F.lit(k), (1 + (F.col("vec_id") + k) % 5).cast("int")).alias("tokens"), (F.col("embedding")[k - 1].cast("double") * 4).alias("score"))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", D.best(F.array(*[hypothesis(k) for k in (1, 2, 3, 4)])).alias("b"))
    b = F.col("b")
    return rows.select("vec_id", b["tokens"][0].alias("hypothesis"), _r(D.normalised_score(b["score"], b["tokens"])).alias("norm"), D.length_cap(F.size(b["tokens"])).alias("cap"))


@query("""WITH v AS (SELECT c_custkey, c_custkey % 7 AS a, c_custkey % 11 AS b FROM customer),
    k AS (SELECT *, CASE WHEN a IN (0, 2, 4) THEN a ELSE 1 END AS x, CASE WHEN b IN (0, 2, 4) THEN b ELSE 1 END AS y FROM v)
    SELECT c_custkey, array_to_string([x::VARCHAR, y::VARCHAR, '2'], ',') AS opus_ids,
      array_to_string(['9', (CASE WHEN x = 1 THEN 2 ELSE x + 1 END)::VARCHAR, (CASE WHEN y = 1 THEN 2 ELSE y + 1 END)::VARCHAR, '2'], ',') AS nllb_ids,
      trim((CASE WHEN a = 0 THEN ' p0' WHEN a = 2 THEN ' p2' WHEN a = 4 THEN ' p4' ELSE '' END) || (CASE WHEN b = 0 THEN ' p0' WHEN b = 2 THEN ' p2' WHEN b = 4 THEN ' p4' ELSE '' END)) AS back FROM k""")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces to ids and back over a vocabulary with a gap at 3, which is unknown; ids out of range are dropped."""
    vocab = config.vocabulary(F.lit('{"▁p0": 0, "<unk>": 1, "▁p2": 2, "▁p4": 4}'))
    a, b = F.col("c_custkey") % 7, F.col("c_custkey") % 11
    pieces = F.array(*[F.when(c == 1, "<unk>").otherwise(F.concat(F.lit("▁p"), c.cast("string"))) for c in (a, b)])
    rows = table(spark, sf_dir, "customer").select("c_custkey", pieces.alias("p"), vocab.alias("v"), F.array(a, b).cast("array<int>").alias("ids"))
    rows = rows.withColumn("found", D.piece_ids(F.col("p"), F.col("v"), config.unknown_id(F.col("v"))))
    text = T.pieces_to_text(F.filter(D.id_pieces(F.col("ids"), D.reverse_vocabulary(F.col("v"))), lambda p: p != "<unk>"))
    joined = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    return rows.select("c_custkey", joined(T.framed_ids(F.col("found"), 2)).alias("opus_ids"), joined(T.framed_ids(F.col("found"), 2, source=9)).alias("nllb_ids"), text.alias("back"))


@query("""SELECT c_custkey, array_to_string(list_transform(list_filter([7, c_custkey % 9, 0, c_custkey % 13, c_custkey % 7], lambda i: i <> 7 AND i >= 1), lambda i: i - 1), ',') AS ids,
    array_to_string(list_filter([c_custkey % 9, 2, c_custkey % 3, c_custkey % 5], lambda i: i <> 2)[CASE WHEN c_custkey % 9 = 2 THEN 1 ELSE 2 END:], ',') AS kept FROM customer""")
def strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without target language and specials, moved down; tokens without start and end marks."""
    k = F.col("c_custkey")
    whole = lambda *x: F.array(*[c.cast("int") for c in x])
    ids = T.unframed_ids(whole(F.lit(7), k % 9, F.lit(0), k % 13, k % 7), 7)
    tokens = D.stripped(whole(k % 9, F.lit(2), k % 3, k % 5), 2)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.array_join(tokens.cast("array<string>"), ",").alias("kept"))


@query("""SELECT conv_id, turn, nullif(array_to_string(list_filter([CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END, CASE WHEN turn % 2 = 0 THEN NULL ELSE role END], lambda s: s IS NOT NULL AND regexp_matches(s, '[^\\s\\p{Z}]')), ' '), '') AS joined,
      coalesce(regexp_matches(CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END, '[^\\s\\p{Z}]'), false) AS needs FROM conversations""")
def join_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that aren't blank joined, null if none; whether a zone's source needs a translation."""
    text = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text"))
    parts = F.array(text, F.when(F.col("turn") % 2 != 0, F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.joined(parts).alias("joined"), (~T.is_blank(text)).alias("needs"))


@query(f"""WITH b AS (SELECT page_id, zone_idx, (x % 50)::DOUBLE AS px, (y % 40)::DOUBLE AS py, (w % 30)::DOUBLE AS bx, (h % 20)::DOUBLE AS by_ FROM ({BOXES})),
    t AS (SELECT *, CASE WHEN bx * bx + by_ * by_ > 0 THEN least(1, greatest(0, (px * bx + py * by_) / (bx * bx + by_ * by_))) ELSE 0 END AS t FROM b)
    SELECT page_id, zone_idx, round(sqrt((px - t * bx) * (px - t * bx) + (py - t * by_) * (py - t * by_)), 6) AS away FROM t""")
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a point to a segment from the origin, some of no length."""
    rows = tables.boxes(spark, sf_dir)
    x, y, w, h = (F.col(c).cast("double") % m for c, m in (("x", 50), ("y", 40), ("w", 30), ("h", 20)))
    return rows.select("page_id", "zone_idx", _r(G.segment_distance(x, y, G.point(F.lit(0), F.lit(0)), G.point(w, h))).alias("away"))


@query(f"""WITH b AS (SELECT page_id, zone_idx, greatest(8.0, line_height / 0.7) AS start FROM ({BOXES}) WHERE line_height IS NOT NULL),
    s AS (SELECT *, (floor((start - 8) / 2) + CASE WHEN (start - 8) / 2 > floor((start - 8) / 2) THEN 1 ELSE 0 END)::INT AS above FROM b)
    SELECT page_id, zone_idx, (above + 1)::INT AS tried, round(start, 6) AS largest, round(CASE WHEN above > 0 THEN start - 2 * (above - 1) ELSE 8 END, 6) AS next_to_last FROM s""")
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that the layout tries for each measured line height."""
    rows = tables.boxes(spark, sf_dir).filter("line_height IS NOT NULL").withColumn("s", layout.sizes(F.col("line_height"), 0.7))
    return rows.select("page_id", "zone_idx", F.size("s").alias("tried"), _r(F.col("s")[0]).alias("largest"), _r(F.when(F.size("s") > 1, F.element_at("s", -2)).otherwise(F.col("s")[0])).alias("next_to_last"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 5)::INT ELSE 1 END AS pad, 2 AS eos, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 7)::INT WHEN c_custkey % 2 = 0 THEN (c_custkey % 5)::INT ELSE 1 END AS start, 6 AS layers,
    (8 + c_custkey % 2)::INT AS heads, ((512 + c_custkey % 100) // (8 + c_custkey % 2))::INT AS head_dim FROM customer""")
def model_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a config.json, with defaults for what it leaves out."""
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"decoder_attention_heads": '), (8 + k % 2).cast("string"), F.lit(', "d_model": '), (512 + k % 100).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(', "pad_token_id": '), (k % 5).cast("string"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(', "decoder_start_token_id": '), (k % 7).cast("string"))).otherwise(""), F.lit("}"))
    return table(spark, sf_dir, "customer").select("c_custkey", config.model_numbers(text).alias("m")).select("c_custkey", "m.*")


_REGISTER = f"""WITH u AS ({USERS}), a AS ({ATTEMPTS}),
    r AS (SELECT a.*, upper(a.username) AS normalized, CASE WHEN length(password) < 8 THEN 'User.PasswordTooShort' WHEN length(password) > 128 THEN 'User.PasswordTooLong'
        WHEN NOT regexp_matches(a.username, '^[A-Za-z0-9_-]{{3,20}}\\n?$') THEN 'User.InvalidUsername' WHEN u.id IS NOT NULL THEN 'User.UsernameTaken' END AS rule FROM a LEFT JOIN u ON upper(a.username) = u.normalized_username),
    t AS (SELECT *, row_number() OVER (PARTITION BY normalized, rule IS NULL ORDER BY attempt_id) AS turn FROM r),
    f AS (SELECT attempt_id, username, normalized, CASE WHEN rule IS NULL AND turn > 1 THEN 'User.UsernameTaken' ELSE rule END AS error FROM t)"""


@query(f"{_REGISTER} SELECT attempt_id, username, error, CASE WHEN error IS NULL THEN 201 WHEN error = 'User.UsernameTaken' THEN 409 ELSE 400 END::INT AS status FROM f")
def register_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.register(tables.attempts(spark, sf_dir), tables.users(spark, sf_dir)).select("attempt_id", "username", "error", "status")


@query(f"{_REGISTER} SELECT ((SELECT max(id) FROM u) + 1 + attempt_id)::BIGINT AS id, username, normalized AS normalized_username, true AS has_hash FROM f WHERE error IS NULL UNION ALL SELECT id, username, normalized_username, false FROM u")
def insert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.users(spark, sf_dir)
    grown = accounts.insert(users, accounts.register(tables.attempts(spark, sf_dir), users), iterations=10)
    return grown.select("id", "username", "normalized_username", (F.length("password_hash") == 84).alias("has_hash"))


@query(f"""WITH u AS ({USERS}), a AS ({ATTEMPTS}) SELECT attempt_id, a.username AS username, CASE WHEN length(password) <= 128 AND u.password_hash = a.password THEN NULL ELSE 'User.InvalidCredentials' END AS error,
    CASE WHEN length(password) <= 128 AND u.password_hash = a.password THEN 200 ELSE 401 END::INT AS status FROM a LEFT JOIN u ON upper(a.username) = u.normalized_username""")
def login_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.login(tables.attempts(spark, sf_dir), tables.users(spark, sf_dir), lambda p, h: p == h).select("attempt_id", "username", "error", "status")


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_type <> 'click' THEN (event_id % 1000)::INT END AS id, CASE WHEN event_id % 3 <> 0 AND event_type <> 'click' THEN event_type END AS name FROM events""")
def parse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("+"), F.col("event_id").cast("string"))).otherwise((F.col("event_id") % 1000).cast("string"))
    name = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    c = accounts.claims(text, name)
    return e.select("event_id", c["id"].alias("id"), c["name"].alias("name"))


@query("SELECT c_custkey AS id, replace(c_name, '#', '_') AS username, upper(replace(c_name, '#', '_')) AS normalized_username FROM customer")
def migrate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.with_normalised_name(tables.users(spark, sf_dir).select("id", "username"))


@query(f"""SELECT page_id, count(*) AS zones, round(avg(CASE WHEN shape IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_bubble, round(avg(confidence), 6) AS mean_confidence, round(avg(len(string_split(text_src, ' '))), 6) AS words_per_zone FROM ({BOXES}) GROUP BY page_id""")
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.zones(spark, sf_dir)
    words = F.size(F.filter(F.split("text_src", " "), lambda w: w != ""))
    return z.groupBy("page_id").agg(F.count("*").alias("zones"), _r(F.avg(G.usable(F.col("contour")).cast("double"))).alias("with_bubble"), _r(F.avg("confidence")).alias("mean_confidence"), _r(F.avg(words)).alias("words_per_zone"))


_POINT = "'(' || ({}) || ', ' || ({}) || ')'"


@query(f"""SELECT page_id, zone_idx, concat_ws(chr(10), 'texte original : « ' || text_src || ' »',
      'traduction     : ' || CASE WHEN zone_idx % 2 = 0 THEN '« ' || upper(text_src) || ' »' ELSE '(pas encore traduit)' END,
      'confiance      : ' || regexp_replace(printf('%.3f', confidence), '\\.?0+$', ''),
      'rectangle      : HG' || {_POINT.format("x", "y")} || ' HD' || {_POINT.format("x + w", "y")} || ' BD' || {_POINT.format("x + w", "y + h")} || ' BG' || {_POINT.format("x", "y + h")} || ' [' || w || ' x ' || h || ' px, 0°]',
      'angle du texte : ' || angle::BIGINT || '°',
      'hauteur ligne  : ' || CASE WHEN line_height IS NULL THEN '(pas mesurée)' ELSE line_height::BIGINT || ' px' END,
      'couleur fond   : ' || CASE WHEN shape IS NULL THEN '(pas mesurée)' ELSE printf('RVB(%d, %d, %d) #%02X%02X%02X', x * 3 % 256, x * 5 % 256, x * 7 % 256, x * 3 % 256, x * 5 % 256, x * 7 % 256) END,
      'bulle          : ' || CASE shape WHEN 0 THEN 'contour de 4 points, centré en (5, 5)' WHEN 1 THEN 'contour de 6 points, centré en (4.7, 4.7)' WHEN 2 THEN 'contour de 3 points, centré en (6, 3)' ELSE '(aucune)' END,
      'ordre lecture  : ' || CASE WHEN zone_idx % 3 = 0 THEN zone_idx::VARCHAR ELSE '(pas encore trié)' END) AS description FROM ({BOXES})""")
def describe_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.zones(spark, sf_dir)
    text = T.zone_text(F.col("text_src"), F.when(F.col("zone_idx") % 2 == 0, F.upper("text_src")), F.col("confidence"), F.col("rect"), F.col("angle"), F.col("line_height"), F.col("background"), F.col("contour"), F.when(F.col("zone_idx") % 3 == 0, F.col("zone_idx")))
    return z.select("page_id", "zone_idx", text.alias("description"))


@query(f"""SELECT page_id, zone_idx, CASE WHEN shape IS NOT NULL THEN (x * 3 % 256)::INT ELSE 255 END AS red, (shape IS NOT NULL AND line_height IS NOT NULL) AS to_rewrite FROM ({BOXES})""")
def erase_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tables.zones(spark, sf_dir)
    white = F.struct(*[F.lit(255).alias(c) for c in "rgb"])
    text = F.when(F.col("line_height").isNotNull(), F.col("text_src")).otherwise(F.lit(""))
    return z.select("page_id", "zone_idx", layout.background(F.col("background"), white)["r"].alias("red"), layout.rewritable(F.col("contour"), text).alias("to_rewrite"))


@query()
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue in boxes: font size, lines and their places."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("text_dst"), (20 + F.col("turn") * 3 % 30).cast("double").alias("line_height"), F.lit(420.0).alias("box_w"), F.lit(300.0).alias("box_h"), F.lit(500.0).alias("centre_x"), F.lit(400.0).alias("centre_y"))
    return layout.placed_lines(layout.layout(c))


@query()
def frame_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.frame(tables.zones(spark, sf_dir).select("page_id", "zone_idx", F.col("x").cast("double"), F.col("y").cast("double"), F.col("w").cast("double"), F.col("h").cast("double"), "contour"), keep_contour=False)


@query()
def translate_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences through the beam search over a synthetic decoder."""
    zones = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("zone_idx"), F.col("text").alias("text_src"), F.lit(None).cast("string").alias("text_dst"))

    def engine():
        def step(source: list[int], tokens: list[int]) -> np.ndarray:
            logits = np.zeros(12)
            at = len(tokens) - 1
            logits[source[at] if at < len(source) else 2] = 5.0
            logits[3 + (tokens[-1] * 5 + at) % 9] += 1.0
            if at < len(source):
                logits[2] = -5.0  # as one of many equals, the end would fill the finished beams after a word
            return logits

        def run(texts: list[str]) -> list[str | None]:
            out = []
            for t in texts:
                ids = [3 + len(w) % 9 for w in t.split()]
                out.append(" ".join(map(str, translate.beam_search(ids, step, start=1, end=2, pad=0))) if len(ids) > 1 else None)
            return out

        return run

    return translate.translate(zones, engine, split=True, calm=False).withColumnRenamed("page_id", "conv_id")


@query()
def erase_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For drawn pages: bubble search around the block, erasing, PNG out and in."""
    pages = raster.spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")))

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch["page_id"].tolist():
                drawn = np.full((120, 160, 3), 40, np.uint8)
                y, x = np.ogrid[:120, :160]
                inside = ((x - 80) / (45 + page % 20)) ** 2 + ((y - 60) / (35 + page % 15)) ** 2 <= 1
                drawn[inside] = (250, 245, 240)
                drawn[50:54, 60:100:3] = 0
                found = raster.bubble(images.decode(images.encode(drawn)), (55, 40, 50, 30))
                clean = raster.erase(drawn, [(found[0], found[1] or (255, 255, 255))]) if found else drawn
                back = images.decode(images.encode(clean))
                rows.append((page, len(found[0]) if found else 0, int((back[inside] == 0).sum()), int(back[60, 80, 0])))
            yield pd.DataFrame(rows, columns=["page_id", "contour_points", "ink_left", "centre_red"])

    return pages.mapInPandas(run, "page_id bigint, contour_points int, ink_left int, centre_red int")


_GRID = (160, 120)  # rows and columns of a quarter of a drawn page


def drawn_page(page: int) -> np.ndarray:
    """A page of four quarters, up to three of them with a bubble that holds strokes."""
    image = np.full((2 * _GRID[0], 2 * _GRID[1], 3), 120, np.uint8)
    for quarter in range(4):
        if (page + quarter) % 3:
            y, x = quarter // 2 * _GRID[0], quarter % 2 * _GRID[1]
            image[y + 16 : y + 144, x + 12 : x + 108] = (250, 245, 240)
            for stroke in range(3 + (page + quarter) % 5):
                image[y + 60 : y + 90, x + 36 + 6 * stroke : x + 38 + 6 * stroke] = 0
    return image


def _stroke_detector():
    def found(tensor: np.ndarray) -> np.ndarray:
        dark, half, out = np.logical_and.reduce([channel < 0.25 for channel in tensor[0]]), tensor.shape[2] // 2, []
        for quarter in range(4):
            y0, x0 = quarter // 2 * half, quarter % 2 * half
            ys, xs = (np.flatnonzero(dark[y0 : y0 + half, x0 : x0 + half].any(axis=axis)) for axis in (1, 0))
            if len(ys):
                w, h = np.ptp(xs) + 60, np.ptp(ys) + 40
                box = ((xs.min() + xs.max()) / 2 + x0, (ys.min() + ys.max()) / 2 + y0, w, h)
                out += [(*box, 0.9), (*box, 0.8), (*box, 0.2)]  # a double and one without score
        return np.array(out)

    return found


def _stroke_ocr():
    def lines(crop: np.ndarray) -> list:
        dark = (crop.max(axis=2) < 64).any(axis=0)
        if not dark.any():
            return []
        strokes = int((np.diff(dark.astype(int), prepend=0) == 1).sum())
        rows = np.flatnonzero((crop.max(axis=2) < 64).any(axis=1))
        xs, (y0, y1) = np.flatnonzero(dark), (rows[0], rows[-1] + 1)
        corners = [(xs[0], y0), (xs[-1] + 1, y0), (xs[-1] + 1, y1), (xs[0], y1)]
        return [(f"I see {strokes}.", 0.9, corners), (" ", 0.1, corners)]

    return lines


@query("""WITH q AS (SELECT s_suppkey AS page_id, k, 3 + (s_suppkey + k) % 5 AS strokes FROM supplier, (VALUES (0), (1), (2), (3)) t(k) WHERE (s_suppkey + k) % 3 <> 0)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k // 2, CASE WHEN page_id % 2 = 0 THEN -(k % 2) ELSE k % 2 END) - 1)::INT AS rank,
      'I see ' || strokes || '.' AS text_src, 'i see ' || strokes || '.' AS text_dst, 30.0::DOUBLE AS line_height, 'RVB(250, 245, 240) #FAF5F0' AS background,
      'i see ' || strokes || '.' AS words, 0 AS ink_left FROM q""")
def read_to_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn pages through all six stages, with a detector, an OCR and an engine for the strokes on them."""

    def draw(batches):
        for batch in batches:
            yield batch.assign(image=[images.encode(drawn_page(p)) for p in batch["page_id"]])

    page = F.col("s_suppkey").cast("bigint")
    pages = table(spark, sf_dir, "supplier").select(page.alias("page_id"), F.when(page % 2 == 0, "RTL").otherwise("LTR").alias("direction"))
    pages = raster.spread(pages).mapInPandas(draw, "page_id bigint, direction string, image binary")
    engine = lambda: lambda texts: [t.lower() for t in texts]
    done = page_chain(pages, _stroke_detector, _stroke_ocr, engine).run(pages)

    def count(batches):
        for batch in batches:
            yield batch.assign(ink_left=[int((images.decode(i).max(axis=2) < 64).sum()) for i in batch["image"]]).drop(columns="image")

    joined = F.transform("zones", lambda z: F.struct(z["rank"].alias("rank"), z["text_src"].alias("text_src"), z["text_dst"].alias("text_dst"), z["line_height"].alias("line_height"), T.colour_text(z["background"]).alias("background"),
        F.array_join(F.transform(F.filter("lines", lambda r: r["rank"] == z["rank"]), lambda r: r["words"]), " ").alias("words")))
    rows = done.select("page_id", "image", F.posexplode(joined).alias("at", "z")).select("page_id", "z.*", F.when(F.col("at") == 0, F.col("image")).alias("image"))
    first = rows.filter("image IS NOT NULL").select("page_id", "image").mapInPandas(count, "page_id bigint, ink_left int")
    return rows.drop("image").join(first, "page_id")
