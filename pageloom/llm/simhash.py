"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link at `distance` (4) or fewer differing bits.
The bits are cut into three segments of 21, 21 and 22 bits. Four differing bits
spread over three segments leave one segment with at most one (the segment's
threshold). On each segment the anchors are the words of a covering code: the
perfect Hamming code on 15 bits (covering radius 1) times all values of the
remaining 6 or 7 bits (radius 0). A fingerprint's home is its nearest anchor, at
distance 1 at most; it is replicated to every anchor within covering radius plus
threshold, 1 + 1 = 2. If x and y differ in one bit of the segment, y reaches x's
home; so comparing, per anchor, those at home with all that reached it finds
every link, without a probability of missing one.

Of two homes it is enough to reach the one with the larger number, so only those
are probed.

Equal fingerprints are one class from the start, so copies cost nothing. Per
anchor only a spanning forest of the links is emitted, never all pairs. An anchor
with more rows than CELL_ROWS is split into a grid of cells (homes by probes),
which still brings each pair together once and bounds a task's memory. Classes
are joined by alternating large-star and small-star steps over written tables.

near_duplicates() links by the 64 bits of one fingerprint. similar_texts() links all
texts whose shingle sets have a Jaccard similarity of 0.8 by default, or more, in two
rounds. At that similarity fingerprints differ in about ten bits, so the first takes
TABLES fingerprints, meets texts that differ in one bit at most on a segment of any and
in REACH bits at most of that fingerprint, and verifies one link of each text, the one
that met most often, on the whole sets: that joins what is alike, large groups first of
all. It finds a pair of similarity 0.8 with probability 0.94 only, so the second round is
exact: sets that match share one of their first n - ceil(4n/5) + 1 shingles, rare ones
first; on each of these, texts of different components that pass the length, position and
parity filters, and then one by wider signatures, are verified. A pair that shares many of
these shingles is met at the first of them: each row knows the last few before its own, and
two rows with one of those in common leave the pair to it. Before, each text is linked to the middle of its group, so
that few pairs of a large group are left. No link between components is lost.

Defined results: a null text counts as empty, an empty one has fingerprint 0 and
links like any other (all texts without words are alike for similar_texts); texts of
any length are read whole; rows with a null id get a fingerprint and the component of
their class if another row of it has an id, else null; repeated rows are copies;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bit_filter, drop, filter_bit, filter_slot, filter_slots, has_bit, stored

WORDS = 4
SEED = 42
DISTANCE = 4
#: First bit and number of free bits of each segment; 15 bits more are under the Hamming code.
SEGMENTS = ((0, 6), (21, 6), (42, 7))
#: Rows of an anchor that one task compares.
CELL_ROWS = 1 << 16
#: An anchor's rows have their homes at so many anchors at most: within distance 3 on the code, or one free bit off.
_AROUND = 36 + 7
_HASHES = 1 << 16
_PAIRS = 1 << 18
#: For similar_texts(): words of a shingle, similarity as a fraction, fingerprints, differing bits of a fingerprint.
SET_WORDS, NUM, DEN = 5, 4, 5
TABLES, REACH = 8, 14
#: Differing bits of all fingerprints, as a mean by fingerprint: similar sets have 10, others 32; the first round leaves out what is farther.
FAR = 16
#: Shingles are counted in so many buckets, in slices; rare ones come first in the second round's order.
BUCKETS, SLICE = 1 << 17, 1 << 11
#: Sets of up to so many shingles have a signature: each flips one of 256 bits, so two differ in no more bits than the sets in shingles.
SHORT = 400
#: A prefix's shingle comes with so many before it: two texts that share one of these met there.
BEFORE = 8
#: Times that the second round links texts to the middles of their groups, before all links between components.
MIDDLES = 2
#: The last verification moves texts for a quarter as many pairs at once as they have texts, or as this.
NODES = 1 << 15
#: Rows of roots (two longs) that are broadcast; more are joined by shuffles.
BROADCAST_ROOTS = 1 << 18


def _lanes() -> np.ndarray:
    """For each byte, its bits as the bytes of a number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return bits.reshape(256, 8).copy().view("<u8").reshape(256)


_LANES = _lanes()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        lanes = _LANES[hashes[at : at + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8)]
        for k in range(0, len(lanes), 255):  # 255 ones fit a byte
            counts += lanes[k : k + 255].sum(axis=0).view(np.uint8)
    return counts


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint: a bit is set if set in over half of the shingles' hashes, repeats included."""
    parts = text.lower().split()  # for bytes: A-Z, and the six ASCII spaces
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1))
    n, digest = len(starts), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        spans = zip(starts[at : at + _HASHES].tolist(), ends[at + words - 1 : at + words - 1 + _HASHES].tolist(), strict=True)
        counts += bit_counts(np.array([digest(joined[a:b], seed) for a, b in spans], "<u8"))
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in as_bytes(batch.column(1))], "<u8")
            yield pa.RecordBatch.from_arrays([pc_long(batch.column(0)), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, fp bigint")


def pc_long(column: pa.Array) -> pa.Array:
    return column.cast(pa.int64())


def _near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value: the nearest codeword, and all others within distance 2 (padded with -1)."""
    values = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    flip = np.concatenate(([0], 1 << np.arange(15)))  # by syndrome
    nearest = values ^ flip[syndrome]
    near = np.full((1 << 15, 7), -1)
    slot = np.zeros(1 << 15, np.int64)
    for a in range(1, 16):
        for b in range(a + 1, 16):
            rows = np.flatnonzero(syndrome == a ^ b)
            near[rows, slot[rows]] = rows ^ flip[a] ^ flip[b]
            slot[rows] += 1
    return nearest, near


_NEAREST, _NEAR = _near_codewords()


def home_anchors(fps: np.ndarray) -> list[np.ndarray]:
    """By segment: the anchor keys at which the unsigned fingerprints are at home."""
    out = []
    for number, (first, free) in enumerate(SEGMENTS):
        segment = (fps >> np.uint64(first) & np.uint64((1 << 15 + free) - 1)).astype(np.int64)
        out.append(number << 40 | segment >> 15 << 15 | _NEAREST[segment & 0x7FFF])
    return out


def anchor_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: anchor keys, the index of the fingerprint, whether it is at home there; other anchors only if larger than the home."""
    keys, index, home = [], [], []
    every = np.arange(len(fps))
    for number, ((first, free), own) in enumerate(zip(SEGMENTS, home_anchors(fps), strict=True)):
        segment = (fps >> np.uint64(first) & np.uint64((1 << 15 + free) - 1)).astype(np.int64)
        keys.append(own)
        index.append(every)
        home.append(np.ones(len(fps), bool))
        around = _NEAR[segment & 0x7FFF]
        row, place = np.nonzero(around >= 0)
        reached = [(number << 40 | segment[row] >> 15 << 15 | around[row, place], row)]
        reached += [(own ^ (1 << bit + 15), every) for bit in range(free)]  # one free bit off leaves a distance of 1 for the code
        for key, row in reached:
            larger = key > own[row]
            keys.append(key[larger])
            index.append(row[larger])
            home.append(np.zeros(int(larger.sum()), bool))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def _anchors(classes: DataFrame) -> DataFrame:
    """(key, fp, rep, home) for each anchor within reach of each class (fp, rep, part); parts have anchors of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp, rep, part = (np.asarray(batch.column(i)[at : at + 8192]) for i in range(3))
                keys, index, home = anchor_rows(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part[index] << 44 | keys), pa.array(fp[index]), pa.array(rep[index]), pa.array(home)], ["key", "fp", "rep", "home"])

    return classes.select("fp", "rep", "part").mapInArrow(run, "key bigint, fp bigint, rep bigint, home boolean")


def _fullest_home(classes: DataFrame) -> int:
    """The most classes that are at home at one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            key, n = np.unique(np.concatenate([part << 44 | x for x in home_anchors(fp.view(np.uint64))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = classes.select("fp", "part").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return found.agg(F.max("n")).first()[0] or 0


def _star(left: np.ndarray, right: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: each row linked to the row with the smallest rep that it reaches by them."""
    rows, ends = np.unique(np.concatenate((left, right)), return_inverse=True)
    rows = rows[(order := np.argsort(rep[rows], kind="stable"))]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    a, b = place[ends[: len(left)]], place[ends[len(left) :]]
    label = np.arange(len(rows))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    off = np.flatnonzero(label != np.arange(len(rows)))
    return rows[off], rows[label[off]]


def _shortest(left: np.ndarray, right: np.ndarray, length: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest of least length: each part takes its shortest link out, until none is left.

    Links of about the same length are taken by their smaller rep, so that the forests of many anchors share them.
    """
    ends, where = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = where[: len(left)], where[len(left) :]
    x, y = rep[left], rep[right]
    order = np.lexsort((np.maximum(x, y), np.minimum(x, y), length >> 1))  # one order: no circles
    a, b = a[order], b[order]
    label, taken = np.arange(len(ends)), []
    while len(order):
        first = np.full(len(ends), len(order))
        np.minimum.at(first, label[a], np.arange(len(order)))
        np.minimum.at(first, label[b], np.arange(len(order)))
        chosen = np.unique(first[first < len(order)])
        taken.append(order[chosen])
        x, y = label[a[chosen]], label[b[chosen]]
        to = np.arange(len(ends))
        while True:
            before = to.copy()
            low = np.minimum(to[x], to[y])
            np.minimum.at(to, x, low)
            np.minimum.at(to, y, low)
            to = to[to]
            if np.array_equal(before, to):
                break
        label = to[label]
        apart = np.flatnonzero(label[a] != label[b])
        a, b, order = a[apart], b[apart], order[apart]
    return np.concatenate([*taken, np.zeros(0, np.int64)])


def _forest(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, home: np.ndarray, segment: np.ndarray, distance: int, shortest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in rows that are sorted by key, as pairs of reps: stars, or links that are as short as can be.

    Rows are linked on the first segment on which they differ in one bit at most, and only there: others
    meet by chance.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    group = np.repeat(np.arange(len(starts)), sizes)
    homes = np.flatnonzero(home & (sizes[group] > 1))
    lefts, rights, held = [], [], 0
    begin, size = starts[group[homes]], sizes[group[homes]]
    done = np.concatenate(([0], np.cumsum(size)))
    at = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        left, right = np.concatenate(lefts), np.concatenate(rights)
        if not shortest:
            return _star(left, right, rep)
        taken = _shortest(left, right, np.bitwise_count(fp[left] ^ fp[right]), rep)
        return left[taken], right[taken]

    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(done, done[at] + _PAIRS, "right")) - 1)
        count = size[at:to]
        left = np.repeat(homes[at:to], count)
        right = np.arange(len(left)) - np.repeat(done[at:to] - done[at], count) + np.repeat(begin[at:to], count)
        linked = (np.bitwise_count(fp[left] ^ fp[right]) <= distance) & (rep[left] != rep[right])
        left, right = left[linked], right[linked]
        differ, own, new = fp[left] ^ fp[right], segment[left], np.ones(len(left), bool)
        for number, (first, free) in enumerate(SEGMENTS):
            met = np.bitwise_count(differ >> np.uint64(first) & np.uint64((1 << 15 + free) - 1)) <= 1
            new &= np.where(own == number, met, ~met | (own < number))
        lefts.append(left[new])
        rights.append(right[new])
        held += int(new.sum())
        if held > _PAIRS:
            left, right = reduced()
            lefts, rights, held = [left], [right], len(left)
        at = to
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = reduced()
    return rep[a], rep[b]


def _compare(rows: DataFrame, distance: int, shortest: bool) -> DataFrame:
    """Links (u, v) among rows of the same (key, cell): a spanning forest for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cell = columns[0]
            cut = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            if cut:
                u, v = _forest(*(x[:cut] for x in columns), distance, shortest)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held, count = [[x[cut:] for x in columns]], len(cell) - cut

        rank, before = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, fp, rep = (np.asarray(batch.column(i)) for i in range(4))
            home = batch.column(4).to_numpy(zero_copy_only=False)
            new = np.concatenate(([before is not None and before != (key[0], salt[0])], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            cell = rank + np.cumsum(new)  # a growing number for each (key, cell)
            rank, before = int(cell[-1]), (key[-1], salt[-1])
            held.append([cell, fp.view(np.uint64), rep, home, key >> 40 & 15])
            count += len(cell)
            if count > 50_000:
                yield from flush(False)
        if count:
            yield from flush(True)

    return rows.select("key", "cell", "fp", "rep", "home").mapInArrow(run, "u bigint, v bigint")


def links(classes: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links between classes (fp, rep), enough of them to connect all that are connected."""
    if distance > 5:
        raise ValueError("three segments with a threshold of one cover up to 5 differing bits")
    return _met(classes.withColumn("part", F.lit(0).cast("bigint")), distance, cell_rows, False).distinct()


def _met(classes: DataFrame, distance: int, cell_rows: int, shortest: bool) -> DataFrame:
    """Links (u, v) between classes (fp, rep, part) that meet at an anchor of their part: a spanning forest for each anchor; many anchors may give a link."""
    rows = _anchors(classes).withColumn("cell", F.lit(0))
    if _fullest_home(classes) * _AROUND > cell_rows:  # else no anchor can hold more
        heavy = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("n_home")).filter(F.col("n") > cell_rows), "heavy-anchors")
        if not heavy.isEmpty():
            heavy = heavy.select("key", F.ceil(F.col("n") / cell_rows).cast("int").alias("probes"), F.greatest(F.lit(1), F.ceil(F.col("n_home") / cell_rows)).cast("int").alias("homes"))
            joined = rows.drop("cell").join(heavy, "key", "left")
            mine = F.xxhash64("fp")
            probe = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: F.struct((i * F.col("probes") + F.pmod(mine, F.col("probes"))).cast("int").alias("cell"), F.lit(False).alias("home")))
            at_home = F.transform(F.sequence(F.lit(0), F.col("probes") - 1), lambda j: F.struct((F.pmod(mine, F.col("homes")) * F.col("probes") + j).cast("int").alias("cell"), F.lit(True).alias("home")))
            split = joined.filter("probes IS NOT NULL").withColumn("to", F.explode(F.when(F.col("home"), F.concat(probe, at_home)).otherwise(probe))).select("key", "fp", "rep", "to.home", "to.cell")
            rows = joined.filter("probes IS NULL").select("key", "fp", "rep", "home", F.lit(0).alias("cell")).unionByName(split)
    return _compare(rows.repartition("key", "cell").sortWithinPartitions("key", "cell"), distance, shortest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (u, v) that reach a smaller node; root is the smallest.

    Alternating large-star and small-star steps; each step is a written table.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, now = now, stored(small, "edges")
        drop(before)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(sums)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: id, fp (signed long), component (smallest id reachable over links)."""
    fps = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    edges = links(classes.filter("rep IS NOT NULL"), distance, cell_rows)
    roots = classes.join(components(edges), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return fps.join(roots, "fp", "left")


def shingle_set(text: bytes, words: int = SET_WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of the text's shingles (fewer words: the whole sequence; none: the empty one)."""
    parts = text.lower().split()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    hashes = np.sort(np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def set_fingerprints(hashes: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Fingerprints of a set: of its hashes, mixed anew for each."""
    counts = np.zeros((tables, 64), np.int64)
    with np.errstate(over="ignore"):
        factors = mixed(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for at in range(0, len(hashes), 255):  # 255 ones fit a byte
            x = factors[:, None] * hashes[at : at + 255]
            x ^= x >> np.uint64(32)
            counts += _LANES[x.astype("<u8").view(np.uint8).reshape(tables, -1, 8)].sum(axis=1).view(np.uint8)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u8").reshape(-1)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _prints(texts: DataFrame, tables: int) -> tuple[DataFrame, np.ndarray]:
    """(node, fps) of each text, written, and in how many sets the shingles of each bucket are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["node", "fps", "slice", "counts"], np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t) for t in as_bytes(part.column(1))]
                counts += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([set_fingerprints(x, tables) for x in sets]), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.list_(pa.int64()))], names)
        n = BUCKETS // SLICE
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(np.arange(n), pa.int32()), _lists(list(counts.view(np.uint64).reshape(n, SLICE)))], names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[number] = found.get(number, 0) + np.asarray(counts.values)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int32()), _lists([x.view(np.uint64) for x in found.values()])], ["slice", "counts"])

    made = stored(texts.mapInArrow(run, "node bigint, fps array<bigint>, slice int, counts array<bigint>"), "set-counts")
    total = np.zeros(BUCKETS, np.int64)
    for number, counts in made.filter("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(summed, "slice int, counts array<bigint>").collect():
        total[number * SLICE : (number + 1) * SLICE] = counts
    prints = made.filter("slice IS NULL").groupBy("node").agg(F.first("fps").alias("fps"))  # equal texts have equal sets
    prints = stored(prints, "set-fingerprints")
    drop(made)
    return prints, total


def prefix(hashes: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles, those of lower grade first: any fixed order loses nothing."""
    order = np.lexsort((hashes, grades[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]))
    return hashes[order[: len(hashes) + (-NUM * len(hashes) // DEN) + 1]]


def _parity(hashes: np.ndarray) -> np.ndarray:
    """The signature of a set, none (zeros) for a large one."""
    odd = np.bincount((hashes >> np.uint64(40) & np.uint64(255)).astype(np.int64) if len(hashes) <= SHORT else [], minlength=256) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def _prefixes(texts: DataFrame, grades: np.ndarray) -> DataFrame:
    """(node, n, prefix, sig) of each text: the size of its set, its first shingles and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, found, sigs = [], [], []
                for text in as_bytes(part.column(1)):
                    hashes = shingle_set(text)
                    sizes.append(len(hashes))
                    found.append(prefix(hashes, grades))
                    sigs.append(_parity(hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), _lists(found), _lists(sigs)], ["node", "n", "prefix", "sig"])

    return texts.mapInArrow(run, "node bigint, n int, prefix array<bigint>, sig array<bigint>")


def crossing(cell: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, i: np.ndarray, *more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows with their shingle's number, ascending: pairs of nodes of different roots that share a shingle and may match by length, position and signature.

    more: the signature's four numbers, and then shingles that stand before this one (or the node, if there is none);
    rows that share one of these are left out, as they meet at it.
    """
    sig, before = more[:4], more[4:]
    # in each cell by the size of the roots' groups; the largest group comes last, and meets only what stands before
    order = np.lexsort((root, cell))
    cell, node, root, n, i = (x[order] for x in (cell, node, root, n, i))
    starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (root[1:] != root[:-1]))))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    again = np.lexsort((np.repeat(starts, sizes), np.repeat(sizes, sizes), cell))
    cell, node, root, n, i = (x[again] for x in (cell, node, root, n, i))
    sig, before = ([x[order[again]] for x in columns] for columns in (sig, before))
    group = np.cumsum(np.concatenate(([True], (cell[1:] != cell[:-1]) | (root[1:] != root[:-1])))) - 1
    begin = np.searchsorted(group, group, "right")  # the next group's first row
    count = np.searchsorted(cell, cell, "right") - begin
    done, at = np.concatenate(([0], np.cumsum(count))), 0
    while at < len(cell):
        to = max(at + 1, int(np.searchsorted(done, done[at] + _PAIRS, "right")) - 1)
        left = np.repeat(np.arange(at, to), count[at:to])
        right = np.arange(len(left)) - np.repeat(done[at:to] - done[at], count[at:to]) + np.repeat(begin[at:to], count[at:to])
        x, y = n[left], n[right]
        least = -(-NUM * (x + y) // (NUM + DEN))  # shared shingles of a match
        close = DEN * np.minimum(x, y) >= NUM * np.maximum(x, y)
        close &= np.minimum(i[left], i[right]) + np.minimum(x - i[left], y - i[right]) >= least
        left, right, most = left[close], right[close], (x + y - 2 * least)[close]
        if sig:
            differ = sum(np.bitwise_count(s[left] ^ s[right]).astype(np.int64) for s in sig)
            close = (differ <= most) | (n[left] > SHORT) | (n[right] > SHORT)
            left, right = left[close], right[close]
        for x in before:
            apart = np.ones(len(left), bool)
            for y in before:
                apart &= x[left] != y[right]
            left, right = left[apart], right[apart]
        u, v = node[left], node[right]
        if len(u):
            found = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
            yield found[0], found[1]
        at = to


def to_middles(cell: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, i: np.ndarray, *sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As crossing(), but each row only with the one at which its shingle stands first: a text without rare shingles of its own is in the middle of its copies."""
    order = np.lexsort((node, i, cell))
    cell, node, root, n, i = (x[order] for x in (cell, node, root, n, i))
    middle = np.searchsorted(cell, cell)
    least = -(-NUM * (n + n[middle]) // (NUM + DEN))
    close = (root != root[middle]) & (DEN * np.minimum(n, n[middle]) >= NUM * np.maximum(n, n[middle]))
    close &= i[middle] + np.minimum(n - i, n[middle] - i[middle]) >= least
    if close.any():
        yield node[close], node[middle[close]]


def _crossing(rows: DataFrame, make=crossing) -> DataFrame:
    """Pairs (u, v) as make() finds them in rows (token, node, root, n, i, and what else it uses); a pair may come many times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            token = columns[0]
            cut = len(token) if last else int(np.searchsorted(token, token[-1]))
            if cut:
                for u, v in make(*(x[:cut] for x in columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            held, count = [[x[cut:] for x in columns]], len(token) - cut

        limit = 50_000
        for batch in batches:
            if batch.num_rows:
                held.append([np.asarray(column).astype(np.int64) for column in batch.columns])
                count += batch.num_rows
                if count > limit:
                    yield from flush(False)
                    limit = max(50_000, 2 * count)  # what is left is one shingle's
        if count:
            yield from flush(True)

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "u bigint, v bigint")


def _filtered(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame | None:
    """The rows whose long `by` is in the written table keys, and a few others, by a filter; None if that is too large to broadcast."""
    slots = filter_slots(keys.count(), 16)
    if not slots:
        return None
    h = F.col(by)
    bits = bit_filter(keys.withColumnRenamed(by, "h"), slots).toDF("__slot", "__bits")
    kept = rows.withColumn("__slot", filter_slot(h, slots)).join(F.broadcast(bits), "__slot").filter(has_bit(F.col("__bits"), filter_bit(h)))
    return kept.drop("__slot", "__bits")


def _ends(pairs: DataFrame) -> DataFrame:
    """(node) of the texts in pairs, written."""
    return stored(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "near-nodes")


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the texts in pairs, one of each, written; the others are left out by a filter while that is small enough."""
    nodes = _ends(pairs)
    kept = _filtered(texts, nodes, "node")
    kept = texts.join(nodes, "node", "left_semi") if kept is None else kept
    found = stored(kept.groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    drop(nodes)
    return found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar, written. Texts move, which are shorter than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                u, v = (part.column(k).to_pylist() for k in (0, 1))
                before, known = known, {}
                similar = []
                for x, y, text_x, text_y in zip(u, v, as_bytes(part.column(2)), as_bytes(part.column(3)), strict=True):
                    for node, text in ((x, text_x), (y, text_y)):
                        if node not in known:
                            known[node] = before[node] if node in before else shingle_set(text)
                    one, other = known[x], known[y]
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    similar.append((NUM + DEN) * shared >= NUM * (len(one) + len(other)))
                chosen = pa.array(similar, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(chosen) for k in (0, 1)], ["u", "v"])

    found = _texts_of(pairs, texts)
    u, v = (found.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
    both = pairs.select("u", "v").join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v")
    similar = stored(both.mapInArrow(run, "u bigint, v bigint"), "near-links")
    drop(found)
    return similar


def wide_parity(hashes: np.ndarray) -> bytes:
    """A signature like _parity()'s, with as many bits as the set has shingles, or up to twice as many."""
    bits = 1 << max(8, min(24, (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes >> np.uint64(40) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_be_similar(one: bytes, n: int, other: bytes, m: int) -> bool:
    """False if the signatures of sets of n and m shingles differ in more bits than similar sets in shingles."""
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)  # folded to the bits of the other
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= n + m + 2 * (-NUM * (n + m) // (NUM + DEN))


def _plausible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that their sets' wide signatures don't exclude, written: these are a small part of the texts."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, sigs = [], []
                for text in as_bytes(part.column(1)):
                    hashes = shingle_set(text)
                    sizes.append(len(hashes))
                    sigs.append(wide_parity(hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["node", "n", "sig"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            chosen = pa.array([may_be_similar(*x) for x in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(chosen) for k in (0, 1)], ["u", "v"])

    nodes = _ends(pairs)
    kept = _filtered(texts, nodes, "node")
    kept = texts.join(nodes, "node", "left_semi") if kept is None else kept
    sigs = kept.select("node", "text").mapInArrow(signatures, "node bigint, n int, sig binary").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    sigs = stored(sigs, "near-signatures")
    drop(nodes)
    u, v = (sigs.toDF(c, f"n_{c}", f"sig_{c}") for c in "uv")
    both = pairs.select("u", "v").join(u, "u").join(v, "v").select("u", "v", "sig_u", "n_u", "sig_v", "n_v")
    found = stored(both.mapInArrow(compare, "u bigint, v bigint"), "near-plausible")
    drop(sigs)
    return found


def _all_verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """As _verified(), for pairs of which a text may have many: in parts, so that not many copies of the texts are on disk at once."""
    plausible = _plausible(pairs, texts)
    nodes = _ends(plausible)
    parts = max(1, -(-4 * plausible.count() // max(NODES, nodes.count())))
    drop(nodes)
    part = F.pmod(F.xxhash64("u", "v"), F.lit(parts))
    links = reduce(DataFrame.unionByName, [_verified(plausible.filter(part == k) if parts > 1 else plausible, texts) for k in range(parts)])
    drop(plausible)
    return links


def _best(pairs: DataFrame) -> DataFrame:
    """For each text its pair that comes most often, of equal ones that with the smallest number: distinct (u, v), u < v, written."""
    counted = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("u", "v").agg(F.count("*").alias("times")), "near-met")
    ends = counted.unionByName(counted.select(F.col("v").alias("u"), F.col("u").alias("v"), "times"))
    best = ends.groupBy("u").agg(F.min(F.struct(-F.col("times"), "v")).alias("b")).select("u", "b.v")
    best = stored(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-best")
    drop(counted)
    return best


def _shared(prefixes: DataFrame) -> DataFrame:
    """(token, node, n, i, s0 to s3), written: the prefixes' shingles that stand in others, too; by a filter while that is small enough."""
    sig = [F.get("sig", F.lit(k)).alias(f"s{k}") for k in range(4)]
    rows = prefixes.select("node", "n", *sig, F.posexplode("prefix").alias("i", "token"))
    shared = stored(rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "near-shared")
    kept = _filtered(rows, shared, "token")
    found = stored(rows.join(shared, "token") if kept is None else kept, "near-rows")
    drop(shared)
    return found


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (token, node, root, ...) whose shingle stands in texts of several components, which few do after the middles, and the written shingles, found on narrow rows."""
    tokens = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    tokens = stored(tokens, "near-apart")
    kept = _filtered(rows, tokens, "token")
    return rows.join(tokens, "token", "left_semi") if kept is None else kept, tokens


def _with_before(rows: DataFrame) -> DataFrame:
    """The rows (token, node, i, ...) with the node's BEFORE shingles that stand before each; those that are missing are the node."""
    ordered = Window.partitionBy("node").orderBy("i")
    return rows.select("*", *[F.coalesce(F.lag("token", k).over(ordered), "node").alias(f"b{k}") for k in range(1, BEFORE + 1)])


def _first_links(prints: DataFrame, texts: DataFrame, tables: int, reach: int, cell_rows: int) -> DataFrame:
    """The first round: for each text the link that most fingerprints and segments show, those that are similar."""
    each = prints.select("node", F.posexplode("fps").alias("part", "fp"))
    classes = stored(each.groupBy(F.col("part").cast("bigint").alias("part"), "fp").agg(F.min("node").alias("rep"), F.count("*").alias("texts")), "set-classes")
    met = _met(classes, reach, cell_rows, True)
    # texts with the same fingerprint, by their class
    same = each.join(classes.filter("texts > 1").select("part", "fp", "rep"), ["part", "fp"]).filter("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    first = _best(met.unionByName(same))
    u, v = (prints.toDF(c, f"fps_{c}") for c in "uv")
    differ = F.aggregate(F.zip_with("fps_u", "fps_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    close = stored(first.join(u, "u").join(v, "v").filter(differ <= FAR * tables).select("u", "v"), "near-first")
    drop(classes, first)
    found = _verified(close, texts)
    drop(close)
    return found


def similar_texts(docs: DataFrame, text_col: str = "text", tables: int = TABLES, reach: int = REACH, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(node, root) of the texts that are similar to others; node is xxhash64 of the text (null as empty), root the smallest of the component.

    Texts that are their component's root, or alone, are left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    prints, counts = _prints(texts, tables)
    found = _first_links(prints, texts, tables, reach, cell_rows)
    drop(prints)
    # the second round: all links between components, of each text first the likeliest ones, as large groups are soon one
    prefixes = stored(_prefixes(texts, np.round(2 * np.log2(counts + 1)).astype(np.int64)), "near-prefixes")
    shared = _shared(prefixes)
    drop(prefixes)

    def rows(*columns: str) -> DataFrame:
        roots = components(found)
        side = F.broadcast(roots) if roots.count() <= BROADCAST_ROOTS else roots
        return shared.join(side, "node", "left").withColumn("root", F.coalesce("root", "node")).select("token", "node", "root", "n", "i", *columns)

    for _ in range(MIDDLES):
        likely = _best(_crossing(rows(), to_middles))
        found = found.unionByName(_verified(likely, texts))
        drop(likely)
    apart, tokens = _apart(rows("s0", "s1", "s2", "s3"))
    rest = stored(_crossing(_with_before(apart)).distinct(), "near-rest")
    drop(shared, tokens)
    found = found.unionByName(_all_verified(rest, texts))
    drop(rest)
    return components(found)
