"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Lines with Jaccard similarity of 4/5 or more
match, and of a pair the later one (by doc_id, then line number) is removed,
whether or not the earlier one stays; so the result has no order of evaluation.

- Order: words are counted in hashed buckets over all texts; a word's number is its
  bucket's frequency class and 56 bits of its hash, so sorting a line's numbers
  puts rare words first. Any fixed order gives the same result.
- Equal sets are one entry with its first place; only entries are joined.
- Prefix: entries share one of their first n - ceil(4n/5) + 1 words if they match.
- Filters: length, position (what may still follow the shared word; the shorter of
  two sets shares one of its first n - ceil(8n/9) + 1 words) and a parity signature:
  each word flips one of 64 bits, or 256 in longer sets, so the signatures of two
  sets differ in no more bits than the sets in words.
- Candidates are found by a semi join on narrow rows, then by one of the rows that it
  left, with whole signatures; pairs are never emitted. An entry with a candidate is
  verified by a semi join on its rarest shared word, and only if that fails on all its
  other ones; word numbers are read again from the text for just the entries that have
  a candidate.

Defined results: lines are separated by line feeds; lines without words are never
removed; null texts have no lines, empty texts one; rows with a null id come first
in the order; rows equal in id and text are treated as one document and get equal
results; rows with one id and different texts are ordered by line, then hash;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, drop, filter_bit, filter_slot, filter_slots, has_bit, stored

#: Similarity as a fraction.
NUM, DEN = 4, 5
BUCKETS = 1 << 17
#: Sets of more words have signatures of 256 bits, others of 64.
LONG = 80
#: The first place of an entry and its hash identify it.
_ENTRY = ["doc", "line", "set_h"]
_SIG = ["s0", "s1", "s2", "s3"]


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): null ids are the smallest number; all spaces but line feeds are blanks."""
    text = F.col(text_col).cast("string")
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("text_h"), F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text).alias("text"))


def rarity(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A class (1 to 126) for each bucket of words (a power of two of them), by its count in blank-separated text; eight to a number."""
    b, n = F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)), F.col("count")
    counted = texts.select(F.explode(F.split("text", " ")).alias("w")).groupBy(b.alias("b")).count()
    grade = F.least(F.lit(126), 1 + F.round(5 * F.log2(n + 1)).cast("int")).cast("bigint")
    shift = (F.col("b").bitwiseAND(F.lit(7)) * 8).cast("int")
    packed = counted.groupBy(F.shiftright("b", 3).alias("k")).agg(F.sum(F.call_function("shiftleft", grade, shift)).alias("v"))
    classes = [0] * (buckets // 8)
    for k, v in packed.collect():  # buckets / 8 rows at most
        classes[k] = v
    return classes


def _numbers(line: Column, classes: list[int]) -> Column:
    """Word numbers of a line, rare ones first."""
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    packed = F.from_json(F.lit(str(classes)), "array<bigint>")  # folded to a constant
    eight = lambda h: F.get(packed, F.shiftright(h, 3).bitwiseAND(F.lit(len(classes) - 1)).cast("int"))
    grade = lambda h: F.call_function("shiftright", eight(h), (h.bitwiseAND(F.lit(7)) * 8).cast("int")).bitwiseAND(F.lit(127))
    number = lambda h: F.coalesce(F.call_function("shiftleft", grade(h), F.lit(56)), F.lit(0).cast("bigint")).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(hashes, number))


def _parity(numbers: str, part: int | None = None) -> Column:
    """64 bits, each word flipping the one that its low 6 bits name; with a part, only words that the next 2 bits put there."""
    flips = ((v & 63, v >> 6) for v in range(256))
    bits = F.from_json(F.lit(str([((1 << b) - (1 << 64 if b == 63 else 0)) * (part in (None, k)) for b, k in flips])), "array<bigint>")
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(F.get(bits, x.bitwiseAND(F.lit(255)).cast("int"))))


def _sets(texts: DataFrame, classes: list[int]) -> DataFrame:
    """Lines with words: doc, text_h, line, identity (set_h, s0 to s3, n) and prefix (31 bits of each of its words)."""
    lines = texts.select("doc", "text_h", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.filter(F.trim("raw") != "")  # a filter on the numbers would compute them twice
    numbered = lines.select("doc", "text_h", "line", _numbers(F.col("raw"), classes).alias("numbers"))
    n = F.size("numbers")
    sig = [F.when(n > LONG, _parity("numbers", 0)).otherwise(_parity("numbers"))] + [F.when(n > LONG, _parity("numbers", k)).otherwise(F.lit(0).cast("bigint")) for k in (1, 2, 3)]
    prefix = F.transform(F.slice("numbers", 1, n - F.floor((NUM * n + DEN - 1) / DEN).cast("int") + 1), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return numbered.select("doc", "text_h", "line", F.xxhash64("numbers").alias("set_h"), *[c.alias(name) for c, name in zip(sig, _SIG, strict=True)], n.alias("n"), prefix.alias("prefix"))


def _earlier(x: str, y: str) -> Column:
    """Entry y stands before entry x."""
    return F.expr(f"{y}.doc < {x}.doc or ({y}.doc = {x}.doc and ({y}.line < {x}.line or ({y}.line = {x}.line and {y}.set_h < {x}.set_h)))")


def _may_match(x: str, y: str, narrow: bool = False) -> Column:
    """Prefix rows of two entries share their word and pass the length, position and signature filters; narrow rows have one 64-bit signature, s."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m = c(x, "n"), c(y, "n")
    alpha = F.expr(f"({NUM} * ({x}.n + {y}.n) + {NUM + DEN - 1}) div {NUM + DEN}")
    length = DEN * F.least(n, m) >= NUM * F.greatest(n, m)
    most = F.least(c(x, "i"), c(y, "i")) + F.least(n - c(x, "i"), m - c(y, "i"))
    index = lambda side: F.expr(f"{side}.i <= {side}.n - ({2 * NUM} * {side}.n + {NUM + DEN - 1}) div {NUM + DEN}")
    shorter = ((n <= m) & index(x)) | ((m <= n) & index(y))
    differ = lambda one, other: F.bit_count(one.bitwiseXOR(other))
    whole = lambda side: c(side, "s0").bitwiseXOR(c(side, "s1")).bitwiseXOR(c(side, "s2")).bitwiseXOR(c(side, "s3"))
    parts = sum((differ(c(x, s), c(y, s)) for s in _SIG[1:]), differ(c(x, "s0"), c(y, "s0")))
    flipped = differ(c(x, "s"), c(y, "s")) if narrow else F.when((n > LONG) & (m > LONG), parts).otherwise(differ(whole(x), whole(y)))
    return (c(x, "word") == c(y, "word")) & length & shorter & (most >= alpha) & (flipped <= n + m - 2 * alpha)


def _wide(needed: DataFrame, texts: DataFrame, classes: list[int]) -> DataFrame:
    """Entries with their word numbers, read from the text; only lines that pass a filter move, while that is small enough."""
    places = ["doc", "line"]
    keys = stored(needed.select(places).distinct(), "line-needed")
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    slots = filter_slots(keys.count(), 16)
    if slots:
        h = F.xxhash64(*places)
        bits = bit_filter(keys.select(h.alias("h")), slots).toDF("__slot", "__bits")
        lines = lines.withColumn("__slot", filter_slot(h, slots)).join(F.broadcast(bits), "__slot").filter(has_bit(F.col("__bits"), filter_bit(h))).drop("__slot", "__bits")
    numbered = lines.join(keys, places).select(*places, _numbers(F.col("raw"), classes).alias("numbers"))  # a semi join would be moved below the filter
    return numbered.select(*places, F.xxhash64("numbers").alias("set_h"), "numbers")


def _verify(later: DataFrame, rows: DataFrame, wide: DataFrame) -> DataFrame:
    """Those of the candidates (prefix rows) that match an earlier entry by one of their words."""
    earlier = stored(rows.alias("y").join(later.alias("x"), _may_match("x", "y") & _earlier("x", "y"), "left_semi"), "line-partners")
    x, y = (part.join(wide, _ENTRY) for part in (later, earlier))
    shared = F.size(F.array_intersect("x.numbers", "y.numbers"))
    similar = (NUM + DEN) * shared >= NUM * (F.col("x.n") + F.col("y.n"))
    return x.alias("x").join(y.alias("y"), _may_match("x", "y") & _earlier("x", "y") & similar, "left_semi").select(_ENTRY).distinct()


def candidates(entries: DataFrame) -> DataFrame:
    """Prefix rows that pass the filters with a row of another entry, written.

    All prefix rows go through one shuffle, so they are narrow: an entry's number and its signature folded to
    64 bits. The few that are left get their entry's place and its whole signature, and meet once more.
    """
    folded = F.col("s0").bitwiseXOR(F.col("s1")).bitwiseXOR(F.col("s2")).bitwiseXOR(F.col("s3"))
    rows = entries.select("entry", folded.alias("s"), "n", F.posexplode("prefix").alias("i", "word"))
    few = rows.alias("x").join(rows.alias("y"), _may_match("x", "y", narrow=True) & (F.col("x.entry") != F.col("y.entry")), "left_semi")
    few = stored(few.select("entry", "i", "word"), "line-narrow")
    wide = stored(few.join(entries.select("entry", *_ENTRY, *_SIG, "n"), "entry").select(*_ENTRY, *_SIG, "n", "i", "word"), "line-wide")
    near = stored(wide.alias("x").join(wide.alias("y"), _may_match("x", "y") & (_earlier("x", "y") | _earlier("y", "x")), "left_semi"), "line-candidates")
    drop(few, wide)
    return near


def matched(entries: DataFrame, texts: DataFrame, classes: list[int]) -> DataFrame:
    """(doc, line, set_h) of the entries that match an earlier one; entries: entry (a number of its own), doc, line, set_h, s0 to s3, n, prefix."""
    near = candidates(entries)
    later = stored(near.alias("x").join(near.alias("y"), _may_match("x", "y") & _earlier("x", "y"), "left_semi"), "line-later")
    wide = stored(_wide(near, texts, classes), "line-numbers")
    first = later.groupBy(*_ENTRY, *_SIG, "n").agg(F.min(F.struct("i", "word")).alias("at"))
    first = stored(first.select(*_ENTRY, *_SIG, "n", "at.i", "at.word"), "line-first-words")
    found = stored(_verify(first, near, wide), "line-matches")
    rest = stored(later.join(found, _ENTRY, "left_anti").join(first, [*_ENTRY, "i"], "left_anti"), "line-rest")
    if rest.isEmpty():
        return found
    return found.unionByName(_verify(rest, near, wide))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_h, n_lines, removed (ascending numbers of its removed lines, from 0)."""
    texts = _text(docs, id_col, text_col)
    classes = rarity(texts)
    sets = stored(_sets(texts, classes), "line-sets")
    identity = ["set_h", *_SIG, "n"]
    # the place as one number: a struct's minimum would need sorted groups
    place = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    entries = sets.groupBy(*identity, "prefix").agg(F.min("doc").alias("doc"), F.min_by("line", place).alias("line"))
    # numbered as they are written
    entries = stored(entries.select(F.monotonically_increasing_id().alias("entry"), "doc", "line", *identity, "prefix"), "line-entries")
    whole, sets = sets, stored(sets.drop("prefix"), "line-places")
    drop(whole)  # prefixes are a good part of it, and lie beside the join's shuffle else
    gone = stored(matched(entries, texts, classes).withColumn("gone", F.lit(True)), "line-gone")
    first = entries.drop("entry", "prefix").join(gone, _ENTRY, "left").select(*identity, F.col("doc").alias("first_doc"), F.col("line").alias("first_line"), "gone")
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("line") == F.col("first_line"))
    removed = sets.join(first, identity).filter(F.coalesce("gone", F.lit(False)) | ~is_first)
    removed = removed.groupBy("doc", "text_h").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text).alias("text_h"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"),
    )
    return rows.join(removed, ["doc", "text_h"], "left").select("id", "text_h", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the removed lines; null texts stay null, other columns as they are."""
    found = duplicate_lines(docs, id_col, text_col).filter(F.size("removed") > 0).select(F.col("id").alias("__line_id"), F.col("text_h").alias("__line_h"), F.col("removed").alias("__line_removed")).distinct()
    joined = docs.join(found, F.col(id_col).cast("bigint").eqNullSafe(F.col("__line_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__line_h")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda _, i: ~F.array_contains("__line_removed", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__line_removed").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
