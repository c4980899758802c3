"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is cut into blocks of rows. With target weights k of sum L, block j of
a source has the window [floor(j L / k), ceil((j + 1) L / k)) of slots: its release
and its deadline. Earliest-deadline-first over the released blocks gives every
block a slot inside its window, so at any slot each source is less than one block
away from its target. As weights are whole numbers the schedule repeats every L
slots; one frame is planned on the driver from the weights alone, and rows find
their slot by arithmetic. The frame in which a source runs out is cut at the slot of
its last block, and a new frame of the live sources begins there with their weights:
so between two such slots each source is less than one block away from what its
weight among the live ones gives. A plan is a list of segments, two for each live
source and each time that one runs out, and all rows are placed.

Plans of more than GROUP_SOURCES sources would be large (the square of them). There,
sources are dealt to groups by a hash of the name, each with the sum of its weights;
the groups are scheduled, and the sources of a group among its slots, so that a source
is less than two blocks away. Groups are grouped again in the same way.

Rows of a source are put in a random order fixed by the seed and their id. Numbers
within a source come from counts of buckets of that order, so a hot source is
ranked by many tasks.

Defined results: rows without a source form a source of their own; rows without an
id are mixed like others; rows equal in all of id, source and the tie columns may
swap; sources without a target weight get weight 1; an empty table gives an empty
result; texts don't matter, of any length; columns of any name are kept, but those
named like the new ones are replaced.
"""

from __future__ import annotations

import heapq
import json
import math
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
BUCKET_ROWS = 8192
#: Sources that are scheduled in one plan.
GROUP_SOURCES = 256
#: What the derived weights add up to, at least, and by source.
RESOLUTION, BY_SOURCE = 100, 8
_PLAN = "array<struct<key:string,first:bigint,per:bigint,frames:bigint,slot0:bigint,frame:bigint,slots:array<bigint>>>"
NEW = ("weight", "block", "release", "deadline", "slot", "position")


def frame(counts: dict[str, int]) -> dict[str, list[int]]:
    """Earliest-deadline-first for one frame: the slots of each source's blocks. Ties go to the smaller name."""
    length = sum(counts.values())
    jobs = sorted((j * length // c, -(-(j + 1) * length // c), s) for s, c in counts.items() for j in range(c))
    slots: dict[str, list[int]] = {s: [] for s in counts}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(length):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        deadline, source = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        slots[source].append(slot)
    return slots


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Segments of frames until all blocks are placed: equal ones, then one up to the slot where a source runs out.

    A segment holds the blocks of a source from `first` on, `per` in each frame, or fewer in a cut one.
    """
    left, first, slot0, segments = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []

    def add(s: str, per: int, frames: int, slots: list[int], placed: int) -> None:
        if placed:
            segments.append({"key": s, "first": first[s], "per": per, "frames": frames, "slot0": slot0, "frame": length, "slots": slots})
            first[s] += placed
            left[s] -= placed

    while left:
        live = {s: weights[s] for s in left}
        shrink = math.gcd(*live.values())
        live = {s: k // shrink for s, k in live.items()}
        length, slots = sum(live.values()), frame(live)
        frames = min((n - 1) // live[s] for s, n in left.items())
        for s, k in live.items():
            add(s, k, frames, slots[s], frames * k)
        slot0 += frames * length
        end = min(slots[s][n - 1] for s, n in left.items() if n <= live[s]) + 1  # the next one to run out
        for s, k in live.items():
            placed = sum(x < end for x in slots[s])
            add(s, k, 1, slots[s][:placed], placed)
        slot0 += end
        left = {s: n for s, n in left.items() if n}
    return segments


def tempered(rows: dict[str, int], power: float = 0.5, resolution: int | None = None) -> dict[str, int]:
    """Whole weights in proportion to rows ** power, 1 at least."""
    resolution = max(RESOLUTION, BY_SOURCE * len(rows)) if resolution is None else resolution
    total = sum(n**power for n in rows.values()) or 1.0
    return {s: max(1, round(resolution * n**power / total)) for s, n in rows.items()}


def plans(blocks: dict[str, int], weights: dict[str, int], group_sources: int = GROUP_SOURCES) -> list[tuple[dict[str, str], list[dict]]]:
    """Levels of (the key each source has, segments): the slots of a level are the blocks of the next one's keys."""
    if len(blocks) <= group_sources:
        return [({s: s for s in blocks}, plan(blocks, weights))]
    n = math.ceil(len(blocks) / group_sources * 2)
    group = {s: f"#{crc32(s.encode()) % n}" for s in blocks}
    inside: dict[str, list[str]] = {}
    for s, g in group.items():
        inside.setdefault(g, []).append(s)
    if any(len(x) > 4 * group_sources for x in inside.values()):
        raise AssertionError("names that share their hash")
    segments = [x for names in inside.values() for x in plan({s: blocks[s] for s in names}, weights)]
    above = plans({g: sum(blocks[s] for s in x) for g, x in inside.items()}, {g: sum(weights[s] for s in x) for g, x in inside.items()}, group_sources)
    return [({s: s for s in blocks}, segments)] + [({s: keys[group[s]] for s in blocks}, x) for keys, x in above]


def mix(
    docs: DataFrame,
    weights: dict[str | None, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    tie_cols: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 7,
    group_sources: int = GROUP_SOURCES,
) -> DataFrame:
    """docs with __mix_weight, __mix_block, __mix_release, __mix_deadline, __mix_slot and __mix_position.

    weights: whole numbers by source (None: rows without source); by default
    tempered() of the sources' rows. Positions order the mix: slot by slot, and
    rows within their block. Release and deadline are those of the block among the
    live sources (of its group).
    """
    name = lambda c: F.col(f"`{c}`")
    kept = [c for c in docs.columns if c not in {f"__mix_{x}" for x in NEW}]
    keyed = docs.select(
        F.struct(*[name(c) for c in kept]).alias("row"),
        F.coalesce(F.concat(F.lit("="), name(source_col).cast("string")), F.lit("?")).alias("source"),
        F.xxhash64(F.lit(seed), name(id_col).cast("string"), *[name(c) for c in tie_cols]).alias("order"),
    )
    rows = {r[0]: r[1] for r in keyed.groupBy("source").count().collect()}  # one for each source
    if weights is None:
        shares = tempered(rows)
    else:
        shares = {s: 1 for s in rows} | {"?" if s is None else f"={s}": k for s, k in weights.items()}
        if any(not isinstance(k, int) or k < 1 for k in shares.values()):
            raise ValueError("weights are whole numbers of 1 or more")
    levels = plans({s: math.ceil(n / block_rows) for s, n in rows.items()}, shares, group_sources)
    buckets = max(1, math.ceil(sum(rows.values()) / bucket_rows))

    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("order", 16), F.lit(buckets)))
    counts = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("order", *[F.col("row").getField(c) for c in (id_col, *tie_cols)])
    ranked = keyed.withColumn("rank", F.row_number().over(within)).join(counts, ["source", "bucket"])
    placed = ranked.select("row", "source", (F.col("before") + F.col("rank") - 1).alias("number"))
    placed = placed.withColumn("slot", F.floor(F.col("number") / block_rows)).withColumn("block", F.col("slot"))

    spark = docs.sparkSession
    for level, (keys, segments) in enumerate(levels):
        if level == 0:
            placed = placed.withColumn("key", F.col("source"))
        else:  # group by group, from a table as small as the list of sources
            listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "map<string,string>")).alias("source", "key"))
            placed = placed.join(F.broadcast(listed), "source")
        # two segments for each source of a plan and each that runs out: GROUP_SOURCES bounds them
        planned = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(segments)), _PLAN)).alias("p")).select("p.*")
        index = F.col("slot")
        inside = (placed["key"] == planned["key"]) & (index >= F.col("first")) & (index < F.col("first") + F.size("slots") * F.col("frames"))
        joined = placed.join(F.broadcast(planned), inside).drop(planned["key"])
        since = index - F.col("first")
        at, turn = F.pmod(since, F.col("per")), F.floor(since / F.col("per"))
        begin = F.col("slot0") + turn * F.col("frame")
        window = [F.col("per").alias("weight"), (begin + F.floor(at * F.col("frame") / F.col("per"))).alias("release"), (begin + F.ceil((at + 1) * F.col("frame") / F.col("per"))).alias("deadline")]
        window = window if level == 0 else [F.col(c) for c in ("weight", "release", "deadline")]
        placed = joined.select("row", "source", "number", "block", (begin + F.get("slots", at.cast("int"))).alias("slot"), *window)
    placed = placed.withColumn("position", F.col("slot") * block_rows + F.pmod("number", F.lit(block_rows)))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(c).alias(f"__mix_{c}") for c in NEW])
