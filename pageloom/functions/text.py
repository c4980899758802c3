"""Dialogue text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import geometry as G


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def sentences(text: Column) -> Column:
    """Pieces ending in runs of . ! ? or an ellipsis, trimmed; the text itself if nothing is left."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)([^.!?…]*[.!?…]+|[^.!?…]+)"), 1), trimmed), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def calmed(text: Column) -> Column:
    """Shouted text (capitals, no small letter) in normal case: first letter and a lone i are capitals."""
    low = F.lower(text)
    first = F.regexp_extract(low, r"^(\P{L}*)(\p{L})", 1)
    head = F.regexp_extract(low, r"^(\P{L}*)(\p{L})", 2)
    rest = F.substr(low, F.length(first) + F.length(head) + 1)
    lifted = F.regexp_replace(F.concat(first, F.upper(head), rest), r"(?U)\bi\b", "I")
    return F.when(text.rlike(r"\p{Ll}") | ~text.rlike(r"\p{Lu}"), text).otherwise(lifted)


def joined(pieces: Column) -> Column:
    """Pieces that are not blank, by one space; null if none."""
    return F.nullif(F.array_join(F.filter(pieces, lambda p: ~is_blank(p)), " "), F.lit(""))


def pieces_to_text(pieces: Column) -> Column:
    """Vocabulary pieces to text."""
    return trimmed(F.translate(F.array_join(pieces, ""), "▁", " "))


def wrapped(text: Column, limit: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """Lines of words split at blanks: a word joins while the line's measure fits; a long word stands alone; no word gives one empty line."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        longer = F.concat(acc["line"], F.lit(" "), word)
        grow = acc["line"].isNotNull() & (measure(longer) <= limit)
        return F.when(acc["line"].isNull(), F.struct(acc["done"].alias("done"), word.alias("line"))).when(grow, F.struct(acc["done"].alias("done"), longer.alias("line"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), word.alias("line"))
        )

    return F.aggregate(words, empty, step, lambda acc: F.concat(acc["done"], F.array(F.coalesce(acc["line"], F.lit("")))))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def normalised_name(name: Column) -> Column:
    return F.upper(name)


def number(x: Column, digits: int = 1) -> Column:
    """Up to so many decimals with a point, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), r"0+$", ""), r"\.$", "")


def point_text(p: Column) -> Column:
    return F.concat(F.lit("("), number(p["x"]), F.lit(", "), number(p["y"]), F.lit(")"))


def colour_text(c: Column) -> Column:
    """RVB(r, g, b) #RRGGBB."""
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    return F.concat(F.format_string("RVB(%d, %d, %d) #", c["r"], c["g"], c["b"]), two(c["r"]), two(c["g"]), two(c["b"]))


# The words and layout of the descriptions.


def quad_text(q: Column) -> Column:
    """Labelled corners, then size and angle."""
    corners = F.concat_ws(" ", *[F.concat(F.lit(k.upper()), point_text(q[k])) for k in ("hg", "hd", "bd", "bg")])
    return F.concat(corners, F.lit(" ["), number(G.width(q)), F.lit(" x "), number(G.height(q)), F.lit(" px, "), number(G.angle(q)), F.lit("°]"))


def polygon_text(points: Column) -> Column:
    return F.concat(F.lit("contour de "), F.size(points).cast("string"), F.lit(" points, centré en "), point_text(G.centroid(points)))


def zone_text(text_src: Column, text_dst: Column, confidence: Column, rect: Column, angle: Column, line_height: Column, background: Column, contour: Column, rank: Column) -> Column:
    """A zone on nine lines; what isn't known yet says so."""
    quoted = lambda c: F.concat(F.lit("« "), c, F.lit(" »"))
    or_else = lambda c, text, missing: F.when(c.isNull(), F.lit(missing)).otherwise(text)
    lines = (
        ("texte original : ", quoted(text_src)),
        ("traduction     : ", or_else(text_dst, quoted(text_dst), "(pas encore traduit)")),
        ("confiance      : ", number(confidence, 3)),
        ("rectangle      : ", quad_text(rect)),
        ("angle du texte : ", F.concat(number(angle), F.lit("°"))),
        ("hauteur ligne  : ", or_else(line_height, F.concat(number(line_height), F.lit(" px")), "(pas mesurée)")),
        ("couleur fond   : ", or_else(background, colour_text(background), "(pas mesurée)")),
        ("bulle          : ", or_else(contour, polygon_text(contour), "(aucune)")),
        ("ordre lecture  : ", or_else(rank, rank.cast("string"), "(pas encore trié)")),
    )
    return F.concat_ws("\n", *[F.concat(F.lit(head), body) for head, body in lines])


def framed_ids(ids: Column, end: int, source: int | None = None, unknown: int = 1) -> Column:
    """Ids with the end mark; with a source language: it first, and ids moved up by one but for the unknown id."""
    if source is None:
        return F.concat(ids, F.array(F.lit(end)))
    moved = F.transform(ids, lambda i: F.when(i == unknown, F.lit(unknown + 1)).otherwise(i + 1))
    return F.concat(F.array(F.lit(source)), moved, F.array(F.lit(end)))


def unframed_ids(ids: Column, target: int) -> Column:
    """Without the target language and ids below 1; the rest moved down by one."""
    return F.transform(F.filter(ids, lambda i: (i != target) & (i >= 1)), lambda i: i - 1)
