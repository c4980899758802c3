import base64
import hashlib
import os
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pageloom.llm import common, exact, lines, lm_score, media, mixing, pieces, quality, simhash, toxicity, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot int"


def docs_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, None, "x", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def nasty():
    """Nulls, empty and long texts, ties and repeated rows."""
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    return [None, "", " \n\t ", "one", "a b c", base, base, base + " end", base.replace("w7 ", "x7 "), base.replace("w99 ", "yy "), "lorem " * 30_000, "é" * 5000, "UPPER case", "upper CASE", base]


def brute_fingerprint(text):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 4]) for i in range(len(parts) - 3)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] > label[j]:
                    label[i], changed = label[j], True
    return label


def test_simhash_against_brute_force(spark):
    texts = nasty()
    got = {r["id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fp"] & 0xFFFFFFFFFFFFFFFF for i in range(len(texts))] == fps
    assert [got[i]["component"] for i in range(len(texts))] == brute_components(fps)
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [1 << 16, 40])
def test_simhash_links_lose_nothing(spark, cell_rows):
    rng = random.Random(1)
    fps = list({(c := rng.getrandbits(64)) for _ in range(150)})
    for _ in range(450):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, cell_rows=cell_rows)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps)


def brute_near(texts):
    """Of each component of five-word Jaccard similarity 0.8, the first place."""
    sets = []
    for t in texts:
        p = (t or "").encode().lower().split()
        sets.append({tuple(p[i : i + 5]) for i in range(len(p) - 4)} or {tuple(p)})
    label, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[i] > label[j] and 5 * len(a & b) >= 4 * len(a | b):
                    label[i], changed = label[j], True
    return {i for i, x in enumerate(label) if i == x}


def test_near_stage_against_brute_jaccard(spark):
    import corpus_pipeline as P

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 250))) for _ in range(40)]
    for _ in range(110):  # chains of copies of copies, edits around the bound
        words = rng.choice(texts).split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [*nasty()[3:5], nasty()[5], *nasty()[8:], None, ""]
    texts = list({t: None for t in texts})
    kept = P.near_stage(spark, docs_of(spark, texts), DATA)
    want = brute_near(texts)
    assert len(want) < len(texts) - 30
    assert {r["doc_id"] for r in kept.collect()} == want
    assert P.near_stage(spark, kept.limit(0), DATA).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert {r["doc_id"] for r in P.near_stage(spark, docs, DATA).collect()} == {rows[i][0] for i in brute_near([t for _, t in rows])}


def test_similar_texts_lose_no_link(spark):
    texts = []
    for k in (1, 2, 3, 220, 269, 338, 444, 468, 580, 673, 825, 877, 902):  # 40 shingles in 50: at the bound; from 220 on fingerprints don't meet
        words = [f"p{k}q{i}" for i in range(54)]
        texts += [" ".join(words), " ".join(words[:44])]
    assert simhash.similar_texts(docs_of(spark, texts)).count() == 13
    # copies of a text that aren't all similar to each other
    base = [f"b{i}" for i in range(104)]
    many = [" ".join([*base[: 104 - 2 * j], *[f"m{j}n{i}" for i in range(2 * j)]]) for j in range(11)]
    assert simhash.similar_texts(docs_of(spark, many)).count() == len(many) - len(brute_near(many))


def test_similar_texts_leave_links_only(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:-1], "other"]), "apart from these", None]
    assert simhash.similar_texts(docs_of(spark, texts)).count() == 1
    left = {x.name.rsplit("-", 1)[0] for x in set(folder.iterdir()) - before}
    assert left == {"edges", "near-links"}  # no texts, sets, fingerprints or prefixes


def test_rows_of_one_component_are_left_out(spark):
    rows = spark.createDataFrame([(k << 20, node, root) for k, node, root in ((1, 10, 5), (1, 11, 5), (2, 10, 5), (2, 12, 6), (3, 12, 6))], "token bigint, node bigint, root bigint")
    assert sorted(map(tuple, simhash._apart(rows)[0].collect())) == [(2 << 20, 10, 5), (2 << 20, 12, 6)]


def test_wide_signatures_exclude_only_what_differs():
    rng, tried = np.random.default_rng(3), set()
    for n in (1, 7, 300, 1500, 5000):
        one = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0, 0.05, 0.2, 0.24, 0.6, 1):  # and sets of another size, whose signature may be longer
            other = np.concatenate((one[int(n * share) :], rng.integers(0, 1 << 63, int(n * share / 9)).astype(np.uint64), np.zeros(1, np.uint64)))
            shared = len(np.intersect1d(one, other))
            similar = 9 * shared >= 4 * (len(one) + len(other))
            found = simhash.may_be_similar(simhash.wide_parity(one), len(one), simhash.wide_parity(other), len(other))
            assert found or not similar
            tried.add((similar, found))
        apart = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert n == 1 or not simhash.may_be_similar(simhash.wide_parity(one), n, simhash.wide_parity(apart), n)
    assert {(True, True), (False, False)} <= tried


def test_all_pairs_are_verified_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODES", 1)
    base = [f"w{i}" for i in range(700)]
    texts = [" ".join(base[:k]) for k in (700, 650, 600, 550)] + ["apart " * 600]
    rows = docs_of(spark, texts).select(F.xxhash64("text").alias("node"), "text")
    rows = rows.unionByName(rows)
    node = {r["text"]: r["node"] for r in rows.collect()}
    pairs = spark.createDataFrame([(node[texts[i]], node[texts[j]]) for i in range(5) for j in range(i)], "u bigint, v bigint")
    got = sorted((r["u"], r["v"]) for r in simhash._all_verified(pairs, rows).collect())
    assert got == sorted((node[texts[i]], node[texts[j]]) for i in range(4) for j in range(i) if (i, j) != (3, 0))


def test_crossing_is_all_pairs():
    rng = np.random.default_rng(4)
    cell, node = np.sort(rng.integers(0, 9, 400)), rng.integers(0, 90, 400)
    root, n, i = node % 11, 4 + node % 3, np.minimum(node % 5, 1)
    got = {(int(a), int(b)) for u, v in simhash.crossing(cell, node, root, n, i) for a, b in zip(u, v, strict=True)}
    want = set()
    for x in range(400):
        for y in range(400):
            least = -(-4 * (n[x] + n[y]) // 9)
            if cell[x] == cell[y] and root[x] != root[y] and node[x] < node[y] and 5 * min(n[x], n[y]) >= 4 * max(n[x], n[y]) and min(i[x], i[y]) + min(n[x] - i[x], n[y] - i[y]) >= least:
                want.add((int(node[x]), int(node[y])))
    assert got == want and want


def test_crossing_meets_a_pair_at_its_first_shingle(spark):
    rng, rows, prefixes = np.random.default_rng(8), [], {}
    for node in range(-40, 0):  # passages of 30 shingles of which each text has most, in one order
        taken = np.sort(rng.choice(30, 26, replace=False)) + 1000 * (node % 3)
        prefixes[node] = {int(t) for t in taken}
        rows += [(int(t) << 40, node, node, 400, i) for i, t in enumerate(taken)]
    table = spark.createDataFrame(rows, "token bigint, node bigint, root bigint, n int, i int")
    got = [tuple(r) for r in simhash._crossing(simhash._with_before(table)).collect()]
    want = {(x, y) for x in prefixes for y in prefixes if x < y and prefixes[x] & prefixes[y]}
    assert set(got) == want and len(got) == len(want)
    # texts whose shared shingles stand far apart still meet
    far = [(k << 40, 10 * x, 10 * x, 400, i) for x in (-2, -1) for i, k in enumerate([*range(x * 30, x * 30 + 12), 5000, *range(x * 30 + 12, x * 30 + 29), 6000])]
    table = spark.createDataFrame(far, "token bigint, node bigint, root bigint, n int, i int")
    assert {tuple(r) for r in simhash._crossing(simhash._with_before(table)).collect()} == {(-20, -10)}


def test_exact(spark):
    texts = nasty()
    rows = docs_of(spark, texts).unionByName(docs_of(spark, ["x", "x", "x"], [None, 90, 90]))
    for keep in ("min", "max"):
        got = [(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(rows, keep=keep).collect()]
        groups = {}
        for r in rows.collect():
            groups.setdefault(r["text"] or "", []).append(r["doc_id"])
        pick = min if keep == "min" else max
        want = [(i, pick(x for x in ids if x is not None), len(ids), i == pick(x for x in ids if x is not None)) for ids in groups.values() for i in ids]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_groups(rows.limit(0)).count() == 0


def test_exact_compares_bytes(spark):
    weak = lambda text: F.unhex(F.md5(F.substring(text, 1, 1)))  # noqa: E731  collides on purpose
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs_of(spark, ["aa", "ab", "aa", "b", "c", "c"]), digest=weak).collect()}
    assert got == {0: (0, 2), 2: (0, 2), 1: (1, 1), 3: (3, 1), 4: (4, 2), 5: (4, 2)}


def brute_lines(rows):
    sets, seen = [], set()
    for i, t in sorted(set(rows), key=lambda r: (r[0], r[1])):
        for n, line in enumerate(t.split("\n")):
            words = frozenset(line.replace("\t", " ").replace("\r", " ").split(" ")) - {""}
            if words:
                sets.append((i, n, words))
    for k, (i, n, a) in enumerate(sets):
        if any(len(a & b) * 9 >= 4 * (len(a) + len(b)) for _, _, b in sets[:k]):
            seen.add((i, n))
    return seen


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(300)]
    made = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    for _ in range(120):
        line = list(rng.choice(made))
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = rng.choice(vocabulary)
        made.append(line)
    rng.shuffle(made)
    texts = ["\n".join(" ".join(x) for x in made[i : i + 6]) for i in range(0, len(made), 6)]
    texts += ["", "\n\n", "\tw1  w2\r\nw2 w1", "w1 w2"]
    got = {r["id"]: set(r["removed"]) for r in lines.duplicate_lines(docs_of(spark, [*texts, None])).collect()}
    want = brute_lines(list(enumerate(texts)))
    assert {(i, n) for i, x in got.items() for n in x} == want
    clean = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, [*texts, None])).collect()}
    assert clean[len(texts)] is None
    assert all(clean[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want) for i, t in enumerate(texts))
    assert lines.duplicate_lines(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_line_candidates_of_narrow_rows(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    held = []
    for size in (6, 20, 60, 79, 80, 81, 100, 160) * 6:  # signatures of 64 bits and of 256
        one = rng.sample(words, size)
        held += [one, one[: size - size // 10] + rng.sample(words, size // 12), one[1:] + ["rare"]]
    docs = spark.createDataFrame([(i, "\n".join(" ".join(w) for w in held[3 * i : 3 * i + 3])) for i in range(48)], "doc_id bigint, text string").repartition(5)
    texts = lines._text(docs, "doc_id", "text")
    sets = lines.stored(lines._sets(texts, lines.rarity(texts)), "test-sets")
    entries = lines.stored(sets.drop("text_h").withColumn("entry", F.monotonically_increasing_id()), "test-entries")
    rows = entries.select(*lines._ENTRY, *lines._SIG, "n", F.posexplode("prefix").alias("i", "word"))
    want = rows.alias("x").join(rows.alias("y"), lines._may_match("x", "y") & (lines._earlier("x", "y") | lines._earlier("y", "x")), "left_semi")
    got = lines.candidates(entries)
    key = lambda df: sorted(tuple(r) for r in df.select(*lines._ENTRY, *lines._SIG, "n", "i", "word").collect())
    assert key(got) == key(want) and 0 < got.count() < rows.count()
    # the first place counts by doc, then line, whatever the order of rows
    same = spark.createDataFrame([(d, "x y z\nq r\nz y x") for d in (5, -3, 1 << 40, -(1 << 62))] + [(None, "q r")], "doc_id bigint, text string").repartition(4)
    found = {r["id"]: list(r["removed"]) for r in lines.duplicate_lines(same).collect()}
    assert found == {None: [], -(1 << 62): [1, 2], -3: [0, 1, 2], 5: [0, 1, 2], 1 << 40: [0, 1, 2]}


def test_mixing_keeps_within_a_block(spark):
    weights = {"a": 5, "b": 3, "c": 2}
    rows = spark.createDataFrame([(i, s, i) for s, n in (("a", 500), ("b", 300), ("c", 200)) for i in range(n)] + [(None, None, 0), (None, None, 0)], "doc_id long, source string, slots int")
    got = mixing.mix(rows.filter("source is not null"), weights, block_rows=1, bucket_rows=64).orderBy("__mix_slot").collect()
    assert [r["__mix_slot"] for r in got] == list(range(1000))
    done = dict.fromkeys(weights, 0)
    for t, r in enumerate(got, 1):
        assert r["__mix_release"] <= r["__mix_slot"] < r["__mix_deadline"]
        done[r["source"]] += 1
        assert all(abs(done[s] - t * k / 10) < 1 for s, k in weights.items())
    full = mixing.mix(rows, block_rows=16)
    assert full.count() == 1002 and full.select("__mix_position").distinct().count() == 1002
    assert mixing.mix(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(rows, {"a": 0})


def test_mixing_plan_places_all_blocks():
    for blocks in ({"a": 7, "b": 1, "c": 23}, {"a": 1}, {}):
        segments = mixing.plan(blocks, {"a": 3, "b": 2, "c": 4})
        slots = [p["slot0"] + f * p["frame"] + s for p in segments for f in range(p["frames"]) for s in p["slots"]]
        assert sorted(slots) == list(range(sum(blocks.values())))


def sequence(segments):
    """Source by slot."""
    at = {p["slot0"] + f * p["frame"] + s: p["key"] for p in segments for f in range(p["frames"]) for s in p["slots"]}
    assert sorted(at) == list(range(len(at)))
    return [at[t] for t in range(len(at))]


def test_mixing_stays_within_a_block_of_the_live_targets():
    rng = random.Random(6)
    cases = [({"a": 1, "b": 100}, {"a": 100, "b": 100}), ({"a": 150, "b": 400}, {"a": 100, "b": 100}), ({"a": 530, "b": 300, "c": 217}, {"a": 50, "b": 30, "c": 20})]
    for _ in range(60):
        names = [f"s{i}" for i in range(rng.randint(1, 9))]
        cases.append(({s: rng.choice((1, 3, 20, 150)) + rng.randint(0, 40) for s in names}, {s: rng.randint(1, 30) for s in names}))
    for blocks, weights in cases:
        left, done, target, seen = dict(blocks), dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0.0), []
        for s in sequence(mixing.plan(blocks, weights)):
            live = [x for x in left if left[x]]
            if live != seen:  # one has run out: targets are counted from here
                seen, done, target = live, dict.fromkeys(live, 0), dict.fromkeys(live, 0.0)
            for x in live:
                target[x] += weights[x] / sum(weights[y] for y in live)
            done[s] += 1
            left[s] -= 1
            assert all(abs(done[x] - target[x]) < 1 - 1e-9 for x in live if left[x]), (blocks, weights)
        assert not any(left.values())


def test_mixing_of_many_sources_in_groups(spark):
    rng = random.Random(7)
    rows = [(i, f"s{rng.randrange(40)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"a.b": F.lit(1), "__mix_key": F.lit("k"), "__mix_order": F.col("doc_id"), "row": F.lit(2)})
    sizes = {s: sum(x == s for _, x in rows) for _, s in rows}
    weights = {s: 1 + i % 4 for i, s in enumerate(sorted(sizes))}
    for group_sources in (256, 12, 5):
        got = mixing.mix(docs, weights, block_rows=1, group_sources=group_sources).orderBy("__mix_slot").collect()
        assert [r["__mix_slot"] for r in got] == list(range(2000)) and sorted(r["doc_id"] for r in got) == list(range(2000))
        assert all(r["__mix_order"] == r["doc_id"] and r["__mix_key"] == "k" and r["a.b"] == 1 and r["row"] == 2 for r in got)
        done, total = dict.fromkeys(sizes, 0), sum(weights[s] for s in sizes)
        for t, r in enumerate(got[:400], 1):  # all sources live
            done[r["source"]] += 1
            assert all(abs(done[s] - t * weights[s] / total) < (1 if group_sources == 256 else 3) for s in sizes)
    assert mixing.mix(docs, block_rows=1, group_sources=2000).count() == 2000


def test_mixing_numbers_rows_as_a_walk_does(spark):
    docs = docs_of(spark, [str(i) for i in range(700)], [i // 2 if i % 9 else None for i in range(700)])
    got = mixing.mix(docs, {"s0": 3, None: 2}, tie_cols=("text",), block_rows=4, bucket_rows=50).collect()
    again = mixing.mix(docs.repartition(5), {"s0": 3, None: 2}, tie_cols=("text",), block_rows=4, bucket_rows=50).collect()
    assert {(r["text"], r["__mix_position"]) for r in got} == {(r["text"], r["__mix_position"]) for r in again}
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["__mix_block"]), []).append(r)
    assert all(len({r["__mix_slot"] for r in x}) == 1 for x in blocks.values())
    counts = {s: sum(r["source"] == s for r in got) for s in ("s0", "s1", "s2", None)}
    keys = {s: "?" if s is None else f"={s}" for s in counts}
    order = sequence(mixing.plan({keys[s]: -(-n // 4) for s, n in counts.items()}, {"=s0": 3, "=s1": 1, "=s2": 1, "?": 2}))
    assert all(order[x[0]["__mix_slot"]] == keys[s] for (s, _), x in blocks.items())
    assert all(len({r["__mix_position"] - 4 * r["__mix_slot"] for r in x}) == len(x) <= 4 for x in blocks.values())


def test_warc_against_brute_force(spark):
    magic = "before WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nafter"
    html = [None, "", "<p>é</p>", "<p>é</p>", magic, magic, "x" * 300_000, "WARC/1.0\r\n", "tail\r\n\r\n", "<p>é</p>"]
    rows = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(rows).collect()}
    last = {h or "": i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        data = (h or "").encode()
        k = last[h or ""]
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if k == i else "revisit", None if k == i else k)
    assert len(got) == len(html)
    assert warc.archive(rows.limit(0)).count() == 0


def test_media_round_trip(spark):
    texts = nasty()
    got = {r["doc_id"]: r for r in media.features(media.encode(docs_of(spark, texts), "text", "doc_id"), "media", "doc_id", "n_bytes").collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        table = media.from_stream(r["tensors"])
        assert table["log_mel"].type.shape == [media.FRAMES, media.MELS] and len(table) >= 1
    assert got[5]["feature"] == got[6]["feature"]
    with pytest.raises(ValueError):
        media.from_wav(b"RIFFxxxx")


def test_resampling_blocks_agree():
    x = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    phases = media._filter_phases()
    whole = media.resampled(x, 0, 3000, phases)
    assert np.allclose(np.concatenate((media.resampled(x, 0, 1000, phases), media.resampled(x, 1000, 2000, phases))), whole, atol=1e-6)


def test_media_segments():
    energy = np.array([0, 0, 0, 0, 5, 1, 0.8, 5, 0, 0, 0, 0, 0, 0, 9, 0, 0, 0], float)
    assert media.segments(energy).tolist() == [[4, 8], [14, 15]]


def test_pieces_round_trip_and_seed(spark):
    texts = [*nasty(), "a▁b", "日本語🙂", "x" * 1000, "  lead", "\x00\r\n", *["international considerations notwithstanding " * 40] * 2]
    coded = pieces.encode(docs_of(spark, texts), keep=("doc_id",))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded, keep=("doc_id",)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    both = pieces.encode(docs_of(spark, texts), keep=("doc_id",), decoded=True).collect()
    assert all(r["text"] == back[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in both)
    first = {r["doc_id"]: r["ids"] for r in coded.collect()}
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(docs_of(spark, texts).repartition(7), keep=("doc_id",)).collect()}
    assert first == again
    assert first[len(texts) - 2] != first[len(texts) - 1]  # one text, two keys
    assert pieces.encode(docs_of(spark, ["a"]).limit(0), keep=("doc_id",)).count() == 0


def test_pieces_are_sampled_by_weight():
    s = pieces.Sampler([("<unk>", 2), ("a", 0), ("b", 0), ("ab", 0)], theta=1.0)
    n = 20_000
    got = sum(len(x) == 1 for x in s.encode(["ab"] * n, list(range(n)))) / n
    p = np.exp(s.log_p)
    assert abs(got - p[3] / (p[3] + p[1] * p[2])) < 0.015


def all_ways(text, ids):
    """Each way to write text in pieces, with its weight's logarithm."""
    if not text:
        return [((), 0.0)]
    return [((i, *rest), w + v) for p, (i, v) in ids.items() if text.startswith(p) for rest, w in all_ways(text[len(p) :], ids)]


@pytest.mark.parametrize("text", ["ab aba", "a  ba\nab", " babab", "abaababa"])
def test_pieces_against_all_ways(text):
    # over the whole text, spaces included: nothing is lost by cutting it into words
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁▁", "▁ab", "\n"]
    s = pieces.Sampler([("<unk>", 2), *[(p, 0) for p in names]], theta=1.0)
    ways = all_ways(text.replace(" ", "▁"), {p: (i, s.log_p[i]) for i, p in enumerate(names, 1)})
    p = np.exp([w for _, w in ways])
    n = 30_000
    drawn = {}
    for x in s.encode([text] * n, list(range(n))):
        drawn[tuple(x.tolist())] = drawn.get(tuple(x.tolist()), 0) + 1
    assert set(drawn) <= {k for k, _ in ways} and len(ways) > 4
    assert sum(abs(drawn.get(k, 0) / n - q) for (k, _), q in zip(ways, p / p.sum(), strict=True)) < 0.05


def test_pieces_cross_any_place_of_a_long_word(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 100)
    s = pieces.Sampler([("<unk>", 2), ("a", 0), ("aa", 0)], theta=1.0)
    n = 3000
    ends = np.zeros(301)
    for x in s.encode(["a" * 300] * n, list(range(n))):
        ends[np.cumsum(x)] += 1  # the id is the piece's length
    assert ends[300] == n and np.ptp(ends[20:280] / n) < 0.07
    whole = s.encode(["aa a aaa " * 60, "a"], [5, 6])
    monkeypatch.setattr(pieces, "BLOCK", 200_000)
    assert [x.tolist() for x in whole] == [x.tolist() for x in s.encode(["aa a aaa " * 60, "a"], [5, 6])]


def test_pieces_of_odd_bytes(spark):
    rows = spark.sql("select cast(X'61FF62EDA08063' as string) as text, cast(null as bigint) as doc_id, 'x' as ids_ union all select '', 1, 'y' union all select cast(null as string), null, 'z'")
    back = pieces.decode(pieces.encode(rows, keep=("ids_",)), keep=("ids_",)).select("ids_", F.hex(F.col("text").cast("binary")).alias("h")).collect()
    assert {r["ids_"]: r["h"] for r in back} == {"x": "61FF62EDA08063", "y": "", "z": ""}
    odd = spark.createDataFrame([([1, -5, 99999, 2],), (None,)], "ids array<int>")
    assert sorted(r["n_pieces"] for r in pieces.decode(odd).collect()) == [0, 2]


def test_quality_separates_and_counts(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.resample(docs, labels)
    rows = got.join(labels, got["id"] == labels["doc_id"]).select("selected", "quality").collect()
    good, bad = ([r["selected"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2
    odd = docs_of(spark, nasty())
    none = quality.resample(odd, labels.limit(0)).collect()
    assert {r["id"] for r in none if not r["selected"]} == {0, 1}
    for k in (0, 4):
        assert quality.resample(odd, labels.limit(0), k=k).filter("selected").count() == k
    assert quality.resample(odd.limit(0), labels).count() == 0


def brute_grams(text):
    """Counts of hashed n-grams of bytes, and of neighbouring words, one by one."""
    counts, data = [0] * quality.BUCKETS, text.encode()
    for n in quality.SIZES:
        for i in range(len(data) - n + 1):
            key = int.from_bytes(data[i : i + n], "big")
            counts[((key + n * 0x632BE5AB) * 0x9E3779B1 & 0xFFFFFFFF) >> 18] += 1
    words = text.split()
    for a, b in zip(words, words[1:]):
        counts[int(a == b)] += quality.PAIR_WEIGHT
    return counts


def test_quality_against_plain_resampling(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "cd", "efg", "x"] if i % 3 else ["zz", "q", "9"]) for _ in range(rng.randint(1, 60))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    got = {r["id"]: r for r in quality.resample(docs_of(spark, texts), labels, k=120, sharpness=6.0).collect()}
    each = np.array([brute_grams(t) for t in texts], float)
    ratio = [np.log((x + 0.5) / (x + 0.5).sum()) for x in (each[[i for i in range(0, 200, 2) if i % 3]].sum(axis=0), each.sum(axis=0))]
    importance = 6.0 * (each @ (ratio[0] - ratio[1])) / (each.sum(axis=1) + quality.PRIOR)
    score = importance + [quality.gumbel(str(i).encode()) for i in range(200)]
    assert np.allclose([got[i]["importance"] for i in range(200)], importance) and np.allclose([got[i]["score"] for i in range(200)], score)
    top, plain = (set(np.argsort(-x)[:120].tolist()) for x in (score, importance))
    assert {i for i in got if got[i]["selected"]} == top
    assert len(top - plain) > 5  # the noise decides
    rows = quality.selected_rows(docs_of(spark, texts).withColumn("a.b", F.lit(1)).withColumn("score", F.lit("s")), labels, k=120, sharpness=6.0)
    assert {r["doc_id"] for r in rows.collect()} == top and rows.columns[-2:] == ["a.b", "score"]


def test_gumbel_draws_by_weight():
    weights = np.array([0.0, 1.0, 2.0])
    wins = np.bincount([np.argmax(weights + [quality.gumbel(f"{i}-{j}".encode()) for j in range(3)]) for i in range(20_000)])
    assert np.allclose(wins / 20_000, np.exp(weights) / np.exp(weights).sum(), atol=0.015)


def test_kth_score(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=12_000), 2).tolist()
    rows = spark.createDataFrame(list(enumerate(values)), "id long, score double")
    ordered = sorted(((v, i) for i, v in enumerate(values)), reverse=True)
    for k in (1, 777, 9000):
        assert quality.kth_score(rows, k) == ordered[k - 1]


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{os.path.dirname(DATA)}/sf0.01/documents.parquet"), spark.read.parquet(f"{os.path.dirname(DATA)}/sf0.01/labels.parquet")
    even, odd = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = toxicity.toxicity(docs, even)
    rows = got.join(odd, got["id"] == odd["doc_id"]).select(got["toxic"], odd["toxic"].alias("truth"), "severity", "grade").collect()
    assert np.mean([r["toxic"] for r in rows if r["truth"] == 0]) < 0.02
    assert np.mean([r["toxic"] for r in rows if r["truth"] == 1]) > 0.6
    assert all(0 <= r["severity"] <= 3 and (r["grade"] > 0) == r["toxic"] for r in rows)
    assert toxicity.toxicity(docs_of(spark, nasty()), labels.limit(0)).filter("toxic").count() == 0


def test_toxicity_slopes_and_grades(spark):
    rng = np.random.default_rng(1)
    x, theta, weight = rng.normal(size=30), np.array([-0.5, 0.3, 1.4]), rng.random((30, 1))
    above = rng.integers(0, 4, 30)[:, None] > np.arange(3)
    by_row, by_theta = toxicity._slopes(x, above, weight, theta)
    step = lambda v, i: np.where(np.arange(len(v)) == i, 1e-6, 0)
    for i in range(30):
        assert abs((toxicity._loss(x + step(x, i), above, weight, theta) - toxicity._loss(x - step(x, i), above, weight, theta)) / 2e-6 - by_row[i]) < 1e-6
    for j in range(3):
        assert abs((toxicity._loss(x, above, weight, theta + step(theta, j)) - toxicity._loss(x, above, weight, theta - step(theta, j))) / 2e-6 - by_theta[j]) < 1e-6
    # four given grades: a word of grade g is in documents of grade g and above
    grades = rng.integers(0, 4, 1200)
    texts = [" ".join([f"w{k}" for k in rng.integers(0, 300, 40)] + [f"bad{g}{rng.integers(3)}" for g in range(1, v + 1)]) for v in grades]
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(grades) if i < 800], "doc_id long, toxic int")
    got = {r["id"]: r for r in toxicity.toxicity(docs_of(spark, texts), labels).collect()}
    held = range(800, 1200)
    assert np.mean([got[i]["grade"] == grades[i] for i in held]) > 0.9
    assert np.mean([abs(got[i]["severity"] - grades[i]) for i in held]) < 0.5
    assert all(0 <= got[i]["severity"] <= 3 for i in got)
    assert toxicity.toxicity(docs_of(spark, ["a"]).limit(0), labels).count() == 0


def test_warc_under_another_layout(spark):
    magic = "x WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n y"
    rows = spark.createDataFrame([(i, f"http://h/{i}", (magic if i % 10 == 0 else "<p>") + f" {i} " * 30) for i in range(1500)], "page_id long, url string, html string").coalesce(1)
    settings = {"spark.sql.files.openCostInBytes": "1000", "spark.sql.leafNodeDefaultParallelism": "4"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        back = warc.archive(rows)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "32")
        got = [(r["page_id"], r["payload_bytes"]) for r in back.collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted(got) == [(i, len((magic if i % 10 == 0 else "<p>") + f" {i} " * 30)) for i in range(1500)]


def test_warc_broken_chain(spark, tmp_path):
    record = lambda n: f"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: {n}\r\nContent-Length: 5\r\n\r\nhello"
    (tmp_path / "a.warc").write_bytes((record(1) + "\r\n\r\n" + record(2) + "\r\n\r\nodd" + record(3) + "\r\n\r\n").encode())
    (tmp_path / "b.warc").write_bytes((record(4) + "\r\n\r\n" + record(5)[:-2]).encode())
    assert sorted(r["page_id"] for r in warc.read(spark, str(tmp_path)).collect()) == [1, 2, 4]


def test_media_against_plain_sums(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, 700).astype(np.uint8)
    signal, phases = (x.astype(float) - 128) / 128, media._filter_phases()
    taps = np.zeros((2 * media.HALF_TAPS + 1) * media.UP)
    for p in range(media.UP):
        taps[p :: media.UP] = phases[p][::-1]
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = signal
    want = np.convolve(up, taps)[media.HALF_TAPS * media.UP :][:: media.DOWN]
    total = -(-len(x) * media.UP // media.DOWN)
    assert np.allclose(media.resampled(x, 0, total, phases), want[:total], atol=1e-5)
    mel, rate = media.log_mel(x), media.RATE * media.UP / media.DOWN
    padded = np.concatenate((want[:total], np.zeros(media.WINDOW)))
    n, bank = np.arange(media.WINDOW), media._mel_bank(rate)
    for k in range(len(mel) - 1):  # beyond the end the filter's tail goes on
        frame = padded[k * media.HOP : k * media.HOP + media.WINDOW] * (0.5 - 0.5 * np.cos(2 * np.pi * n / media.WINDOW))
        power = [abs((frame * np.exp(-2j * np.pi * f * n / media.WINDOW)).sum()) ** 2 for f in range(media.WINDOW // 2 + 1)]
        assert np.allclose(mel[k], 10 * np.log10(np.array(power) @ bank + media.FLOOR), atol=0.02)
    rows = spark.createDataFrame([(1, media.to_wav(x.tobytes())), (2, b"RIFF"), (3, None)], "i int, media binary")
    got = {r["i"]: r for r in media.features(rows, "media", "i").collect()}
    table = media.from_stream(got[1]["tensors"])
    assert np.array_equal(table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, media.MELS)[: len(mel)], mel)
    assert table["end_s"].to_pylist()[-1] * rate == pytest.approx(len(mel) * media.HOP + media.WINDOW - media.HOP)
    assert [[a * rate / media.HOP, b * rate / media.HOP] for a, b in got[1]["spans"]] == pytest.approx(media.segments(mel.mean(axis=1)).tolist())
    assert got[2]["payload_bytes"] is None and got[2]["media_bytes"] == 4 and got[3]["feature"] is None
    assert media.features(rows.limit(0), "media", "i").count() == 0


def test_lm_prefers_corpus_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = lm_score.score(docs).collect()
    assert all(r["n_tokens"] == 0 or r["log_likelihood"] < 0 for r in got)
    odd = {r["id"]: r for r in lm_score.score(docs_of(spark, nasty())).collect()}
    assert odd[0]["n_tokens"] == 0 and odd[0]["mean_log_likelihood"] is None
    assert odd[5]["log_likelihood"] == odd[6]["log_likelihood"]
    assert lm_score.score(docs.limit(0)).count() == 0


def test_lm_scores_a_token_alike_at_any_place():
    rng = np.random.default_rng(5)
    net = lm_score.start((1e6 / np.arange(1, 1500)).astype(np.int64))
    net.parameters[3][:] = rng.standard_normal(net.parameters[3].shape)
    sides, centre = rng.integers(0, 1499, (lm_score.BATCH, 4)), rng.integers(0, 1499, lm_score.BATCH)
    want = lm_score._log_p(net, sides, centre)
    assert np.array_equal(lm_score._log_p(net, sides[::-1], centre[::-1])[::-1], want)
    for n in (1, 2, 3, 17, 804, 2047):
        assert np.array_equal(lm_score._log_p(net, sides[:n], centre[:n]), want[:n])
    for k in range(64):
        assert lm_score._log_p(net, sides[k : k + 1], centre[k : k + 1])[0] == want[k]
    assert len(lm_score._log_p(net, sides[:0], centre[:0])) == 0


def test_lm_learns_both_sides():
    # the first of each pair follows from the one to its right, the second from the one to its left
    rng = np.random.default_rng(0)
    seqs = [np.stack((k + 10, k), axis=1).reshape(-1).astype(np.uint8) for k in rng.integers(0, 5, (800, 30))]
    net = lm_score.train(lm_score.start(), seqs, rate=0.1)
    sides, centre = lm_score.windows(seqs[:50])
    z = lm_score.forward(net, sides)[2][np.arange(len(centre)), centre]
    assert z.mean() > -0.3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, DATA)
        assert kept.columns == columns, name
        path = str(tmp_path / name.split()[0])
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        if name == "exact dedup":
            assert kept.count() == before.select("text").distinct().count()
        if name == "SimHash near-dedup":
            ids, texts = zip(*sorted((r["doc_id"], r["text"]) for r in before.collect()), strict=True)
            assert {r["doc_id"] for r in kept.collect()} == {ids[i] for i in brute_near(texts)}
        if name.startswith("mixing"):
            assert kept.count() == before.count()
    out = P.STAGES[-1][1](spark, kept, DATA)
    assert out.count() == kept.count() and out.filter("NOT lossless").count() == 0


def test_pipeline_result_follows_the_mix(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    sizes = {"a": 3600, "b": 1600, "c": 400}
    rows = [(i, f"text {i} " * (1 + i * 7 % 50), "en", s, None, "x", 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(P, "STAGES", P.STAGES[-2:])
    got = P.run(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) == len({r["position"] for r in got})
    weights = mixing.tempered({f"={s}": n for s, n in sizes.items()})
    done = dict.fromkeys(sizes, 0)
    for t, r in enumerate(got, 1):
        done[r["source"]] += 1
        if t % mixing.BLOCK_ROWS == 0 and t <= 1600:  # the first frame of 100 blocks
            assert all(abs(done[s] - t * weights[f"={s}"] / sum(weights.values())) <= mixing.BLOCK_ROWS for s in sizes), t
    again = {r["doc_id"]: r["position"] for r in P.pieces_stage(spark, spark.createDataFrame(rows, DOCS).repartition(3), str(tmp_path)).collect()}
    assert again == {r["doc_id"]: r["position"] for r in got}


def test_lm_hears_the_order_of_content_words(spark):
    # 3000 equally frequent words in 20 topics; the topic changes every 30 words
    rng = np.random.default_rng(4)

    def made():
        return [f"t{t}x{rng.integers(150)}y" for t in rng.permutation(20)[:10] for _ in range(30)]

    held = [made() for _ in range(20)]
    texts = [" ".join(made()) for _ in range(1500)] + [" ".join(w) for w in held] + [" ".join(rng.permutation(w)) for w in held]
    got = {r["id"]: r["log_likelihood"] for r in lm_score.score(docs_of(spark, texts)).collect()}
    better = [got[1500 + i] - got[1520 + i] for i in range(20)]
    assert np.mean(better) > 100 and min(better) > 0


def test_lm_vocabulary_follows_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "MIN_WORDS", 2)
    monkeypatch.setattr(lm_score, "WORDS_ROOT", 0)
    # both rare words share a leaf and stand alone: their scores differ by their own counts, not by pooled ones
    texts = ["a a a b b"] * 30 + ["rare1zq"] + ["rare2zq"] * 3
    got = {r["id"]: r["log_likelihood"] for r in lm_score.score(docs_of(spark, texts)).collect()}
    assert got[31] - got[30] == pytest.approx(np.log(3), abs=1e-3)


@pytest.mark.parametrize("shard_tokens", [10, 1000])
def test_lm_trains_twice_at_every_size(spark, monkeypatch, shard_tokens):
    passes, trained = [], lm_score._trained
    monkeypatch.setattr(lm_score, "_trained", lambda shards, net: passes.append(1) or trained(shards, net))
    assert lm_score.score(docs_of(spark, ["a b c d e"] * 6), shard_tokens=shard_tokens).count() == 6
    assert len(passes) == 2


def test_pipeline_stages_decide_by_id_and_text(spark):
    import corpus_pipeline as P

    long = " ".join(f"w{i}" for i in range(200))
    rows = docs_of(spark, ["lone", "lone", "both", "both", "first", "second", long, long + " end"], [None, None, None, 7, 8, 8, None, None])
    kept = sorted(((r["doc_id"], r["text"]) for r in P.exact_stage(spark, rows, DATA).collect()), key=str)
    assert kept == sorted([(None, "lone"), (7, "both"), (8, "first"), (8, "second"), (None, long), (None, long + " end")], key=str)
    kept = [(r["doc_id"], r["text"]) for r in P.near_stage(spark, rows.filter("text <> 'lone' and text <> 'both'"), DATA).collect()]
    assert len(kept) == 3 and {(8, "first"), (8, "second")} < set(kept)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))).unionByName(docs.withColumn("text", F.lit(None).cast("string")))
    kept = P.quality_stage(spark, more, DATA)
    assert kept.filter("text IS NULL").count() == 0 and kept.filter("doc_id IS NULL").count() > 0


def test_tree_top_as_a_matrix_has_the_paths_signs():
    tree = lm_score.Tree(np.arange(1, 400) ** 2)
    for leaf in range(tree.leaves):
        nodes, signs, _, _ = tree.paths(np.array([leaf]))
        row = np.zeros(len(tree.bias) - tree.top, np.int8)
        row[nodes[nodes >= tree.top] - tree.top] = signs[nodes >= tree.top]
        assert np.array_equal(tree.crossed[leaf], row)
