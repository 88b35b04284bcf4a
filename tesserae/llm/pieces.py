"""SentencePiece-style encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a position, and a chain of byte pieces for
every character that is no piece. A piece of merge rank r weighs (r + 3)**-alpha, a byte piece (2 * size)**-alpha. Forward
filtering sums the weight of all segmentations up to each position; backward sampling then draws one segmentation with
its exact probability. Random numbers are a hash of (seed, row key, unit, step), so a row is always cut alike: sums are added
in the order of a unit's own edges, powers of two apart, and draws compare integers, hence nothing depends on the batch.

No piece continues across certain places, such as before a space. The lattice falls apart there into units; the distinct
ones of a batch are filtered together, position by position, and the draws of all units are made together too.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import _INV, _MULT, _power, buffers, mix, released

MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
_SPACE = "▁"
_TOP = np.uint64((1 << 32) - 1)
_NEWLINE, _BLANK, _LETTER, _OTHER = range(4)
_LONG = 1000
_BITS = 18


@dataclass(frozen=True)
class Params:
    """``model`` is the path of a SentencePiece model on the driver; about ``block`` characters are cut together."""

    model: str = MODEL
    alpha: float = 1.0
    seed: int = 17
    block: int = 500_000


class Vocabulary:
    """Surface forms, weights and byte pieces of a model; small, and sent to executors with the task."""

    def __init__(self, surfaces: list[bytes], ids: dict[str, int], weights: dict[int, float], byte_ids: list[int], byte_weight: float):
        self.surfaces, self.ids, self.weights, self.byte_ids, self.byte_weight = surfaces, ids, weights, np.array(byte_ids, np.int32), byte_weight
        self.weight = np.zeros(len(surfaces))
        self.weight[list(weights)] = list(weights.values())
        self._tables()
        self.kind, self.cut = self._kinds()

    @classmethod
    def load(cls, p: Params) -> "Vocabulary":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=p.model)
        n, ids, weights, surfaces, byte_ids, rank = sp.get_piece_size(), {}, {}, [], [0] * 256, 0
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surfaces.append(b"")
            else:
                text = piece.replace(_SPACE, " ")
                surfaces.append(text.encode())
                ids[text], weights[i] = i, (rank + 3.0) ** -p.alpha
                rank += 1
        return cls(surfaces, ids, weights, byte_ids, (2.0 * n) ** -p.alpha)

    def _tables(self) -> None:
        """Names of the pieces by their slot in a table of first places, and how many a slot holds at most."""
        self.lengths, names, piece = sorted(set(map(len, self.ids))), [], []
        for size in self.lengths:
            own = [t for t in self.ids if len(t) == size]
            points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
            names.append(_named(((points.astype(np.uint64) + np.uint64(1)) * _power(_MULT, size)).sum(1, dtype=np.uint64), size))
            piece += [self.ids[t] for t in own]
        names = np.concatenate(names)
        order = np.argsort(_slot(names), kind="stable")
        slot = _slot(names)[order]
        self.slots = np.full(1 << _BITS, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot))[::-1]
        self.chain = int(np.bincount(slot).max())
        self.names = np.append(names[order], np.zeros(self.chain, np.uint64))
        self.piece = np.append(np.array(piece, np.int64)[order], np.zeros(self.chain, np.int64))

    def _kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The kind of every code point, and whether no piece continues from a character of one kind to one of another."""
        letter = np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))), bool, 0x110000)
        kind = np.where(letter, _LETTER, _OTHER).astype(np.uint8)
        kind[ord("\n")], kind[ord(" ")] = _NEWLINE, _BLANK
        # letters that stand before something else inside a piece count as something else
        kind[[ord(a) for t in self.ids for a, b in zip(t, t[1:]) if letter[ord(a)] and not letter[ord(b)]]] = _OTHER
        cut = np.ones(16, bool)
        for t in self.ids:
            k = kind[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
            cut[k[:-1] * 4 + k[1:]] = False
        return kind, cut


def _named(h: np.ndarray, length: int) -> np.ndarray:
    """Rolling hashes of runs of ``length`` characters, told apart by their length."""
    return (h + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _heads(x: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _filter_one(start: list[int], end: list[int], weight: list[float]) -> list[float]:
    """The shares of the edges of one long part, sorted by end."""
    low, out, i = start[0], [], 0
    mantissa, exponent = [1.0], [0]  # of the part's begin and of each character's end
    while i < len(end):
        j, at = i, end[i]
        while j < len(end) and end[j] == at:
            j += 1
        top = max(exponent[s - low] for s in start[i:j])
        own = [math.ldexp(mantissa[s - low] * w, exponent[s - low] - top) for s, w in zip(start[i:j], weight[i:j])]
        total = sum(own)
        out += [x / total for x in own]
        m, grown = math.frexp(total)
        mantissa.append(m)
        exponent.append(top + grown)
        i = j
    return out


class Lattice:
    """The filtered lattices of some units, laid end to end: node i is the end of character i.

    Edges are sorted by node; ``key`` is the node and, in the low 32 bits, the share of the weight of the edges up to this
    one. A draw r picks the first edge with key >= (node, r). A negative piece is a character in bytes.
    """

    def __init__(self, v: Vocabulary, points: np.ndarray, begin: np.ndarray, size: np.ndarray):
        n = len(points)
        first = np.repeat(begin, size)
        start, end, piece = self._edges(v, points, first + np.repeat(size, size) - np.arange(n))
        weight = np.where(piece >= 0, v.weight[piece], v.byte_weight ** _utf8(-1 - piece))
        # a lattice falls apart once more at places that no edge crosses
        crossed = np.cumsum(np.bincount(start + 1, minlength=n + 2) - np.bincount(end + 1, minlength=n + 2))[:n]
        part = np.maximum.accumulate(np.where(crossed == 0, np.arange(n), 0))
        head = _heads(end)
        many = np.diff(np.append(head, len(end)))
        share = self._filter(start, end, weight, part, n)
        rank = np.arange(len(end)) - np.repeat(head, many)
        for r in range(1, int(many.max(initial=1))):
            i = np.flatnonzero(rank == r)
            share[i] += share[i - 1]
        low = np.minimum(share * 4294967296.0, 4294967295.0).astype(np.uint64)
        low[head + many - 1] = _TOP
        self.key = end.astype(np.uint64) << np.uint64(32) | low
        self.prev, self.piece = np.where(start == first[start], -1, start - 1), piece

    @staticmethod
    def _edges(v: Vocabulary, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) by end, then start."""
        n = len(points)
        total = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(_MULT, n), dtype=np.uint64))
        inverse, i, found = _power(_INV, n), np.arange(n), []
        single = np.zeros(n, bool)
        for length in v.lengths:
            i = i[left[i] >= length]
            h = _named((total[i + length] - total[i]) * inverse[i], length)
            k = v.slots[_slot(h)]
            some = np.flatnonzero(k >= 0)
            at, h, k = i[some], h[some], k[some]
            for _ in range(v.chain):  # the pieces of a slot stand in a row
                hit = v.names[k] == h
                found.append((at[hit], at[hit] + length - 1, v.piece[k[hit]]))
                at, h, k = at[~hit], h[~hit], k[~hit] + 1
            if length == 1:
                for start, _, _ in found:
                    single[start] = True
        own = np.flatnonzero(~single)
        found.insert(0, (own, own, -1 - points[own].astype(np.int64)))
        start, end, piece = (np.concatenate(x) for x in zip(*found[::-1]))  # the longest first, each in the order of its ends
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]

    @staticmethod
    def _filter(start: np.ndarray, end: np.ndarray, weight: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """Each edge's share of the weight that reaches its end. Sums are kept as mantissas and exponents, so none vanishes.

        Parts are filtered together, place by place; those of more than ``_LONG`` characters, of which few can be in one
        batch, each by itself. Which way a part goes depends on the part alone.
        """
        size = np.bincount(part, minlength=n)[part]
        x, fresh = np.empty(len(start)), start == part[start]
        long = size[end] > _LONG
        alone = np.flatnonzero(long)
        for part_edges in np.split(alone, _heads(part[end[alone]])[1:]) if len(alone) else ():
            x[part_edges] = _filter_one(start[part_edges].tolist(), end[part_edges].tolist(), weight[part_edges].tolist())
        own = np.flatnonzero(~long)
        place = (end - part[end])[own].astype(np.uint16)
        by = own[np.argsort(place, kind="stable")]
        start, end, weight, fresh = start[by], end[by], weight[by], fresh[by]
        mantissa, exponent, out = np.zeros(n), np.zeros(n, np.int32), np.empty(len(by))
        cut = np.cumsum(np.append(0, np.bincount(place)))
        for a, b in zip(cut[:-1], cut[1:]):
            s, e, new = start[a:b] - 1, end[a:b], fresh[a:b]
            m, power = np.where(new, 1.0, mantissa[s]) * weight[a:b], np.where(new, 0, exponent[s])
            head = _heads(e)
            many = np.diff(np.append(head, b - a))
            top = np.maximum.reduceat(power, head)
            m = np.ldexp(m, power - np.repeat(top, many))
            total = np.add.reduceat(m, head)
            out[a:b] = m / np.repeat(total, many)
            mantissa[e[head]], grown = np.frexp(total)
            exponent[e[head]] = top + grown
        x[by] = out
        return x

    def draw(self, at: np.ndarray, seed: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all units in order, how many each has) of a segmentation of the unit that ends at each node of ``at``.

        ``who`` is the order in which the units are visited; it changes nothing but the time.
        """
        steps, length, step, at = [], np.zeros(len(at), np.int64), 0, at[who]
        while len(who):
            step += 1
            r = mix(seed[who] + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1)) >> np.uint64(32)
            edge = np.searchsorted(self.key, at.astype(np.uint64) << np.uint64(32) | r, "left")
            length[who] = step
            steps.append((who, self.piece[edge]))
            at = self.prev[edge]
            more = at >= 0
            at, who = at[more], who[more]
        stop = np.cumsum(length)
        out = np.empty(stop[-1] if len(stop) else 0, np.int64)
        for k, (w, q) in enumerate(steps):
            out[stop[w] - 1 - k] = q
        return out, length


def _utf8(points: np.ndarray) -> np.ndarray:
    """How many bytes each code point has."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Sampler:
    """Cuts texts into sampled pieces."""

    def __init__(self, v: Vocabulary, p: Params):
        self.v, self.p = v, p

    def encode(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, n + 1 offsets)."""
        v = self.v
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n, first = len(points), np.cumsum([0, *map(len, texts)])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = v.kind[points]
        edge = np.append(True, v.cut[kind[:-1] * 4 + kind[1:]])
        edge[first[first < n]] = True
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, n))
        total = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(_MULT, n), dtype=np.uint64))
        name = mix((total[begin + size] - total[begin]) * _power(_INV, n)[begin] + size.astype(np.uint64))
        del total, edge, kind
        _, where, which = np.unique(name, return_index=True, return_inverse=True)
        own = size[where]
        stop = np.cumsum(own)
        lattice = Lattice(v, points[np.repeat(begin[where] - (stop - own), own) + np.arange(stop[-1])], stop - own, own)
        of = np.searchsorted(begin, first)  # the units of each text
        count = np.diff(of)
        within = np.arange(len(begin)) - np.repeat(of[:-1], count)
        seed = mix(np.repeat(mix(keys.astype(np.uint64) ^ np.uint64(self.p.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), count) + within.astype(np.uint64))
        by = np.argsort(which, kind="stable")  # equal units together: their draws look at the same edges
        out, length = lattice.draw(stop[which] - 1, seed, by)
        offsets = np.append(0, np.cumsum(length))[of]
        return self._spell(out, offsets) if (out < 0).any() else (out.astype(np.int32), offsets)

    def _spell(self, pieces: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes."""
        points = np.where(pieces < 0, -1 - pieces, 0)
        size = np.where(pieces < 0, _utf8(points), 1)
        stop = np.append(0, np.cumsum(size))
        out = np.repeat(pieces, size)
        for k in range(4):
            i = np.flatnonzero((pieces < 0) & (size > k))
            lead, tail = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[i]], points[i] >> 6 * (size[i] - 1 - k)
            out[stop[i] + k] = self.v.byte_ids[tail | lead if k == 0 else tail & 0x3F | 0x80]
        return out.astype(np.int32), stop[offsets]


def decode(ids, surfaces: list[bytes]) -> str:
    """The text of a list of ids: the inverse of every sampled segmentation."""
    return b"".join([surfaces[i] for i in ids]).decode()


def lossless(ids: np.ndarray, offsets: np.ndarray, surfaces: pa.Array, texts: pa.Array) -> np.ndarray:
    """Whether the surfaces of each text's ids are its bytes again."""
    data, first = buffers(surfaces.take(pa.array(ids)))
    told, at = buffers(texts)
    mine = first[offsets]
    if np.array_equal(mine, at):
        wrong = np.flatnonzero(data != told)
        ok = np.ones(len(texts), bool)
        ok[np.searchsorted(at, wrong, "right") - 1] = False
        return ok
    return np.array([np.array_equal(data[a:b], told[c:d]) for a, b, c, d in zip(mine[:-1], mine[1:], at[:-1], at[1:])], bool)


def _rows(p: Params, v: Vocabulary, at: int, key: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, surfaces = Sampler(v, p), pa.array(v.surfaces, pa.large_binary())
        for b in batches:
            _, offsets = buffers(b.column(at))
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + p.block, "right")) - 1))
                part = b.slice(i, j - i)
                column, i = part.column(at), j
                none = np.array(column.is_null())
                keys = np.array(row_keys(part.column(key)))
                ids, cut = sampler.encode(keys, [t or "" for t in column.to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32), mask=np.append(none, False)), pa.array(ids))
                yield pa.record_batch([*part.columns, lists, pa.array(lossless(ids, cut, surfaces, column), mask=none)], names)

    return released(run)


def row_keys(column: pa.Array) -> np.ndarray:
    """A number for each row key: integers stand for themselves, other kinds for the hash of their text; null is 0."""
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64(), safe=False).fill_null(0).to_numpy(zero_copy_only=False)
    data, offsets = buffers(column.cast(pa.large_string()))
    total = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * _power(_MULT, len(data)), dtype=np.uint64))
    h = mix((total[offsets[1:]] - total[offsets[:-1]]) * _power(_INV, len(data) + 1)[offsets[:-1]])
    return np.where(np.diff(offsets) > 0, h, np.uint64(0)).view(np.int64)


def encode(docs: DataFrame, p: Params = Params(), text: bool = False) -> DataFrame:
    """(doc_id, pieces, lossless) of every row: sampled ids, and whether decoding them gave the text back.

    ``text=True`` keeps all columns of ``docs`` in front. A null text has null pieces; an empty one has none. A null id is
    keyed as 0, one that is no integer by its text; repeated rows of an id are cut alike; columns of these names that ``docs``
    has are replaced. An empty table gives an empty one. Characters outside the vocabulary, U+2581 itself too, become bytes.
    """
    v = Vocabulary.load(p)
    rows = docs.drop("pieces", "lossless") if text else docs.select("doc_id", "text")
    names = [*rows.columns, "pieces", "lossless"]
    run = _rows(p, v, rows.columns.index("text"), rows.columns.index("doc_id"), names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", pieces array<int>, lossless boolean"
    out = rows.mapInArrow(run, schema)
    return out if text else out.drop("text")
