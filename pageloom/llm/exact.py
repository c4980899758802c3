"""Exact duplicates by a log-structured merge index, in DataFrame operations only.

- Memtables: rows (id, digest) fall to runs by the task that read them; a run
  holds each digest once, with smallest and largest id and a count, and is
  flushed sorted by digest, with a bitmap filter of its digests.
- Compaction: an entry whose bit no other run's filter holds can have no
  counterpart and passes through; the rest are merged by digest. Filters are
  broadcast only while they fit FILTER_BROADCAST_BYTES; beyond, all are merged.
- Verification: of digests with more than one row, the rows' bytes are compared
  (grouped by digest and text). Only rows that pass a filter of those digests are
  moved. Should texts differ under one digest, that digest is answered by text.

The text itself is read twice and shuffled only for the hits.

Defined results: a null text counts as empty; ids that are null are never kept
unless all of the group's are null, then keep_id is null and kept false; rows that
share the kept id are all marked kept; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, filter_bit, filter_slot, filter_slots, has_bit, stored

RUNS = 4


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _flush(keys: DataFrame) -> DataFrame:
    """Sorted runs of entries (digest, lo, hi, n)."""
    entries = keys.groupBy("run", "digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    return stored(entries.sortWithinPartitions("run", "digest"), "runs", "run")


def _compact(runs: DataFrame, n_runs: int) -> DataFrame:
    """One entry per digest."""
    hashed = runs.withColumn("h", F.xxhash64("digest"))
    merge = lambda entries: entries.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    slots = filter_slots(runs.count(), 8, n_runs)
    if slots is None:
        return merge(runs)
    by_slot = bit_filter(hashed, slots, "run").groupBy("slot").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))  # n_runs bitmaps at most
    tested = hashed.withColumn("slot", filter_slot(F.col("h"), slots)).join(F.broadcast(by_slot), "slot", "left")
    bit = filter_bit(F.col("h"))
    elsewhere = F.exists("filters", lambda f: (f["run"] != F.col("run")) & has_bit(f["bits"], bit))
    tested = tested.select("digest", "lo", "hi", "n", elsewhere.alias("elsewhere"))
    return merge(tested.filter("elsewhere")).unionByName(tested.filter("NOT elsewhere").drop("elsewhere"))


def _verify(docs: DataFrame, index: DataFrame) -> DataFrame | None:
    """Compare the bytes of all rows under digests with several rows; the groups by text if any digest has two texts."""
    hits = index.filter("n > 1").select("digest")
    count = hits.count()
    if not count:
        return None
    read = docs.withColumn("h", F.xxhash64("digest"))
    slots = filter_slots(count, 16)
    if slots:
        rows = bit_filter(hits.withColumn("h", F.xxhash64("digest")), slots)
        read = read.withColumn("slot", filter_slot(F.col("h"), slots)).join(F.broadcast(rows), "slot").filter(has_bit(F.col("bits"), filter_bit(F.col("h"))))
    else:
        read = read.join(hits, "digest", "left_semi")
    # the map side keeps each text once for each task, so copies aren't moved
    texts = read.groupBy("digest", "text").agg(F.count("*").alias("n"))
    apart = texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    apart = stored(apart, "collisions")
    if apart.isEmpty():
        return None
    return docs.join(apart, "digest", "left_semi").groupBy("digest", "text").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int = RUNS, digest=_digest) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (SHA-256 of the text).

    keep: "min" or "max", which id of equal texts stays.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    read = read.withColumn("digest", digest(F.col("text")))
    keys = stored(read.select("id", "digest", F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run")), "digests")
    index = stored(_compact(_flush(keys), runs), "index")
    winner = (F.col("lo") if keep == "min" else F.col("hi")).alias("keep_id")
    finish = lambda joined: joined.select("id", winner, F.col("n").alias("group_size"), F.coalesce(F.col("id") == winner, F.lit(False)).alias("kept"), "digest")
    apart = _verify(read, index)
    if apart is None:
        return finish(keys.join(index, "digest"))
    apart = stored(apart, "texts-of-collisions")
    common = finish(keys.join(index.join(apart, "digest", "left_anti"), "digest"))
    return common.unionByName(finish(read.join(apart, ["digest", "text"])))
