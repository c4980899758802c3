"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text's lattice holds every vocabulary piece that matches, and the bytes of a
character that no piece of its own covers. It falls apart where no piece can cross:
before the spaces that follow something else, and around white space that no longer
piece holds (Sampler checks both against the vocabulary). These parts, words here, may
be of any length and are not cut further, so no way through the text's lattice is lost.
Forward filtering sums the weight of all ways to reach each position of a word;
backward sampling then draws, from the end, the piece that leads to a position in
proportion to that weight. A piece's weight is (rank + 2) ** -THETA, its rank being
the order in which the vocabulary lists it. The uniform numbers are a hash of seed,
row key, word and step, so a row's segmentation is the same wherever and whenever it
is drawn. Words are drawn together in numpy, in blocks of about BLOCK characters (or
one longer word); only the lattices of distinct words are built, and they are
forgotten beyond CACHE_NODES positions.

Spaces become U+2581 as in the vocabulary; a literal U+2581 in a text and bytes that
are no UTF-8 are coded as bytes, so decoding gives back every text.

The vocabulary file is read on the driver (its path is a parameter) and its pieces
are broadcast (a few hundred kilobytes).

Defined results: null and empty texts have no pieces and decode to the empty text;
rows with a null key are seeded by the text alone; rows equal in key and text get
equal pieces; a text of any length is coded whole; columns not in `keep` are left out,
kept ones may have any name but the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 1.5
SEED = 3
#: Characters that are drawn together.
BLOCK = 200_000
#: Positions of lattices held.
CACHE_NODES = 500_000
#: Longer words are learnt one by one.
LONG_WORD = 200
_SPACE, _LITERAL = 0x2581, 0x110000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0x100000001B3)
#: Shares of an edge and draws are whole numbers out of this.
_ONE = 1 << 30
#: Shift that leaves the first 20 bits of a piece's hash.
_INDEX = np.uint64(44)


def vocabulary(model: str = MODEL) -> list[tuple[str, int]]:
    """(piece, kind) by id; kinds: 0 text, 1 byte, 2 neither (unknown, control)."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: 1 if read.is_byte(i) else 2 if read.is_unknown(i) or read.is_control(i) or read.is_unused(i) else 0
    return [(read.id_to_piece(i), kind(i)) for i in range(read.get_piece_size())]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class Sampler:
    def __init__(self, pieces: list[tuple[str, int]], theta: float = THETA, seed: int = SEED):
        self.n, self.seed = len(pieces), seed
        self.bytes_of = spellings(pieces)
        self.byte_id = np.zeros(256, np.int64)
        for i, (_, kind) in enumerate(pieces):
            if kind == 1:
                self.byte_id[self.bytes_of[i][0]] = i
        text = [(p, i) for i, (p, kind) in enumerate(pieces) if kind == 0 and p]
        self.longest = max(len(p) for p, _ in text)
        if any("▁" in p.lstrip("▁") for p, _ in text):
            raise ValueError("a piece holds a space after something else: texts can't be cut into words")
        inside = {c for p, _ in text if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in inside)
        self.word = re.compile(rf" *[^ {alone}]+| +" + (f"|[{alone}]+" if alone else ""))
        keys = np.array([self._key(p) for p, _ in text], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in text], np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have the same hash")
        # where the keys with the same first bits begin; and whether a piece begins with a string
        first = (self.keys >> _INDEX).astype(np.int64)
        self.begin = np.searchsorted(first, np.arange((1 << 20) + 1)).astype(np.int32)
        self.crowd = int(np.bincount(first).max())
        self.starts = np.zeros(1 << 20, bool)
        self.starts[[self._key(p[:k]) >> int(_INDEX) for p, _ in text for k in range(1, len(p) + 1)]] = True
        self.log_p = -theta * np.log(np.arange(self.n) + 2.0)
        self.byte_p = float(self.log_p[-1]) * 2
        self.forget()

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * 0x100000001B3 + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.end = np.zeros(0, np.int32)  # by word: node of its end
        self.start = np.zeros(0, np.int32)  # by word: node of its start
        self.nodes = 0
        # by node: its first edge; by edge, sorted by the node it leads to: cumulated share, piece, the node it comes from
        self.node_edge, self.edge_upto = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.edge_id, self.edge_from = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where edges begin, their lengths and pieces; left: characters to the word's end."""
        at = np.arange(len(chars), dtype=np.int32)
        h = np.zeros(len(chars), np.uint64)
        single = np.zeros(len(chars), bool)
        froms, sizes, ids = [], [], []
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                if not len(at):
                    break
                h = h * _ROLL + chars[at + (n - 1)] + np.uint64(1)
                key = h * _MULT
                bucket = (key >> _INDEX).astype(np.int32)
                some = np.flatnonzero(self.starts[bucket])  # the others begin no piece, nor do longer strings from there
                if len(some) < len(at):
                    at, h, key, bucket = at[some], h[some], key[some], bucket[some]
                place, last = self.begin[bucket], self.begin[bucket + 1]
                for _ in range(self.crowd):
                    open_ = np.flatnonzero(place < last)
                    if not len(open_):
                        break
                    here = place[open_]
                    hit = self.keys[here] == key[open_]
                    found = at[open_[hit]]
                    froms.append(found)
                    sizes.append(np.full(len(found), n, np.int32))
                    ids.append(self.ids[here[hit]])
                    if n == 1:
                        single[found] = True
                    if self.crowd > 1:
                        place = place + 1
                more = np.flatnonzero(left[at] > n)
                at, h = at[more], h[more]
        bare = np.flatnonzero(~single).astype(np.int32)
        froms.append(bare)
        sizes.append(np.ones(len(bare), np.int32))
        ids.append((self.n + np.where(chars[bare] == _LITERAL, _SPACE, chars[bare])).astype(np.int32))  # n + code point: its bytes
        return np.concatenate(froms), np.concatenate(sizes), np.concatenate(ids)

    def _learn(self, words: list[str]) -> None:
        """Lattices of new words, forward-filtered."""
        length = np.fromiter(map(len, words), np.int32, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars = np.where(chars == _SPACE, np.uint64(_LITERAL), np.where(chars == 32, np.uint64(_SPACE), chars))
        first = np.cumsum(length, dtype=np.int32) - length
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), length)
        source, size, piece = self._edges(chars, (first + length)[word_of] - np.arange(len(chars), dtype=np.int32))
        word = word_of[source]  # a word of k characters has k + 1 nodes
        step = source + size - first[word]  # position of the edge's end in its word
        source += word
        target = source + size
        points = piece.astype(np.int64) - self.n
        weight = self.log_p[np.minimum(piece, self.n - 1)]
        coded = np.flatnonzero(points >= 0)
        utf8 = 1 + (points[coded] >= 0x80).astype(np.int64) + (points[coded] >= 0x800) + (points[coded] >= 0x10000)
        weight[coded] = self.byte_p * np.where((points[coded] >= 0xDC80) & (points[coded] <= 0xDCFF), 1, utf8)
        # all words' first positions, then all second ones; within a position by target
        top = int(length.max())
        order = np.argsort((step.astype(np.int64) * (len(chars) + len(words) + 1) + target) * (self.longest + 1) + size)  # unique numbers: one order
        source, target, piece, weight, step = source[order], target[order], piece[order], weight[order], step[order]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(step, minlength=top + 1)))).tolist()
        alpha = np.zeros(len(chars) + len(words))
        share = np.empty(len(weight))
        begin = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        lots = np.searchsorted(begin, bounds).tolist()
        sizes = np.diff(np.concatenate((begin, [len(target)])))
        for k in range(1, top + 1):
            a, b, i, j = bounds[k], bounds[k + 1], lots[k], lots[k + 1]
            if a == b:
                continue
            total, at, many = alpha[source[a:b]] + weight[a:b], begin[i:j] - a, sizes[i:j]
            most = np.maximum.reduceat(total, at)
            part = np.exp(total - np.repeat(most, many))
            mass = np.add.reduceat(part, at)
            alpha[target[begin[i:j]]] = most + np.log(mass)
            share[a:b] = part / np.repeat(mass, many)
        # the most likely edge first: the draw then seldom looks further; whole numbers, so that results depend on the word alone
        share = np.rint(share * _ONE).astype(np.int64)
        order = np.argsort((target.astype(np.int64) << 31 | _ONE - share) << 5 | target - source)
        source, target, piece, share = source[order], target[order], piece[order], share[order]
        running = np.cumsum(share)
        first_edge = np.searchsorted(target, np.arange(len(alpha) + 1))
        many = np.diff(first_edge)
        at_first = np.concatenate(([0], running))[first_edge[:-1]]
        upto = running - np.repeat(at_first, many)
        upto[first_edge[1:][many > 0] - 1] = _ONE  # the last edge takes what rounding leaves
        self.words.update(zip(words, range(len(self.end), len(self.end) + len(words)), strict=True))
        starts = first + np.arange(len(words), dtype=np.int32) + self.nodes
        self.start, self.end = np.concatenate((self.start, starts)), np.concatenate((self.end, starts + length))
        self.edge_upto = np.concatenate((self.edge_upto, upto.astype(np.int32)))
        self.edge_id = np.concatenate((self.edge_id, piece))
        self.node_edge = np.concatenate((self.node_edge, (first_edge[:-1] + len(self.edge_from)).astype(np.int32)))
        self.edge_from = np.concatenate((self.edge_from, source + np.int32(self.nodes)))
        self.nodes += len(alpha)

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text; keys are 64-bit numbers of the rows."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []  # row, number of the first word, words
        size = 0

        def flush() -> None:
            nonlocal held, size
            for (row, _, _), ids in zip(held, self._encode([x[2] for x in held], [keys[x[0]] for x in held], [x[1] for x in held]), strict=True):
                out[row].append(ids)
            held, size = [], 0

        for row, text in enumerate(texts):
            if size and size + len(text) > BLOCK:
                flush()
            if size + len(text) <= BLOCK:
                held.append((row, 0, self.word.findall(text)))
                size += len(text)
                continue
            words, number = [], 0
            for match in self.word.finditer(text):  # a longer text goes in parts
                words.append(match[0])
                size += len(match[0])
                if size > BLOCK:
                    held.append((row, number, words))
                    number, words = number + len(words), []
                    flush()
            held.append((row, number, words))
        flush()
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, np.int32)]) for x in out]

    def _encode(self, lists: list[list[str]], keys: list[int], firsts: list[int]) -> list[np.ndarray]:
        if self.nodes > CACHE_NODES:
            self.forget()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = [w for x in lists for w in x]
        if not flat:
            return [np.zeros(0, np.int32) for _ in lists]
        known = self.words
        new = [w for w in dict.fromkeys(flat) if w not in known]
        if short := [w for w in new if len(w) <= LONG_WORD]:
            self._learn(short)
        for w in new if len(short) < len(new) else ():
            if len(w) > LONG_WORD:
                self._learn([w])
        word = np.fromiter(map(known.__getitem__, flat), np.int32, len(flat))
        begin = np.cumsum(counts) - counts
        row_key = np.repeat(np.array(keys, np.uint64), counts)
        number = np.arange(len(flat)) + np.repeat(np.array(firsts) - begin, counts)
        with np.errstate(over="ignore"):
            stream = _mix(row_key + _MULT * (number + 1).astype(np.uint64))
        node, stop = self.end[word], self.start[word]
        alive = np.arange(len(flat), dtype=np.int32)
        drawn_word, drawn_piece, steps = [], [], np.zeros(len(flat), np.int64)
        step = 0
        while len(alive):
            step += 1
            with np.errstate(over="ignore"):
                u = (_mix(stream + _MULT * np.uint64(step)) >> np.uint64(34)).astype(np.int32)
            edge = self.node_edge[node]
            on = np.flatnonzero(self.edge_upto[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[self.edge_upto[edge[on]] <= u[on]]
            drawn_word.append(alive)
            drawn_piece.append(self.edge_id[edge])
            node = self.edge_from[edge]
            steps[alive] += 1
            go = np.flatnonzero(node != stop)
            alive, node, stop, stream = alive[go], node[go], stop[go], stream[go]
        last = np.cumsum(steps)
        pieces = np.empty(int(last[-1]), np.int32)
        for k, (who, what) in enumerate(zip(drawn_word, drawn_piece, strict=True)):
            pieces[last[who] - 1 - k] = what  # drawn from the end
        bounds = np.concatenate(([0], last))[np.concatenate((begin, [len(flat)]))]
        as_bytes_ = np.flatnonzero(pieces >= self.n)
        ids = pieces
        if len(as_bytes_):
            size = np.ones(len(pieces), np.int64)
            points, where = np.unique(pieces[as_bytes_], return_inverse=True)
            coded = [chr(p - self.n).encode("utf-8", "surrogateescape") for p in points.tolist()]
            size[as_bytes_] = np.array([len(x) for x in coded], np.int64)[where]
            offset = np.concatenate(([0], np.cumsum(size)))
            ids = np.repeat(pieces, size)
            place = offset[as_bytes_]
            for j in range(4):
                has = np.array([len(x) > j for x in coded])[where]
                ids[place[has] + j] = self.byte_id[np.array([x[j] if len(x) > j else 0 for x in coded])[where[has]]]
            bounds = offset[bounds]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def row_key(self, key: str | None, text: bytes) -> int:
        return xxhash.xxh64_intdigest(text if key is None else key.encode(), self.seed)


def spellings(pieces: list[tuple[str, int]]) -> list[bytes]:
    """The bytes that each id stands for."""
    return [b"" if kind == 2 else bytes([int(p[1:-1], 16)]) if kind == 1 else p.replace("▁", " ").encode() for p, kind in pieces]


def encode(rows: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), model: str = MODEL, theta: float = THETA, seed: int = SEED, decoded: bool = False) -> DataFrame:
    """keep columns, and ids array<int>: a sampled segmentation of each text; decoded: and what decode() makes of ids, in the same worker."""
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(pieces.value, theta, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                data = as_bytes(part.column(part.num_columns - 1))
                keys = [sampler.row_key(k, t) for k, t in zip(part.column(part.num_columns - 2).to_pylist(), data, strict=True)]
                found = sampler.encode([t.decode("utf-8", "surrogateescape") for t in data], keys)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], ids, *(_decoded(ids, sampler.bytes_of) if decoded else ())], names)

    picked = rows.select(*keep, F.col(key_col).cast("string").alias("__piece_key"), F.col(text_col).cast("string").alias("__piece_text"))
    schema = picked.drop("__piece_key", "__piece_text").schema.add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("n_pieces", T.LongType()).add("text", T.StringType()) if decoded else schema
    names = schema.names
    return picked.mapInArrow(run, schema)


def _decoded(column: pa.ListArray, spelled: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Numbers of pieces, and texts, of lists of ids."""
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    ids = column.flatten().to_numpy(zero_copy_only=False)  # null lists have none
    good = (ids >= 0) & (ids < len(spelled))
    if not good.all():
        ids, ends = ids[good], np.concatenate(([0], np.cumsum(good)))[ends]
    found = list(map(spelled.__getitem__, ids.tolist()))
    texts = [b"".join(found[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.array(np.diff(ends)), pa.array(texts, pa.binary()).view(pa.string())


def decode(rows: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = (), model: str = MODEL) -> DataFrame:
    """keep columns, n_pieces, and text: the pieces joined, byte pieces as bytes. Ids out of range are dropped."""
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = spellings(pieces.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_decoded(part.column(part.num_columns - 1), spelled)], names)

    picked = rows.select(*keep, F.col(ids_col).cast("array<int>").alias("__piece_ids"))
    schema = picked.drop("__piece_ids").schema.add("n_pieces", T.LongType()).add("text", T.StringType())
    names = schema.names
    return picked.mapInArrow(run, schema)
