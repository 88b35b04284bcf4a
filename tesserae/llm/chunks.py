"""Content-defined chunking of media payloads, and their reconstruction from deduplicated chunks.

A gear hash rolls over the bytes; a cut follows each byte at which its low bits vanish, at least ``least`` and at most
``most`` bytes after the last cut. The hash depends on the last 32 bytes alone, so that equal content is cut alike
wherever it stands, and it is computed for all bytes at once by doubling the window five times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ._text import released, slices

_GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Params:
    """Chunk sizes in bytes; ``bits`` vanishing bits make the mean about ``least + 2**bits``. ``least`` is 32 or more.

    ``samples`` bounds the payloads that the compression dictionary is made from.
    """

    least: int = 256
    bits: int = 10
    most: int = 8192
    level: int = 6
    samples: int = 400


def gear(data: np.ndarray) -> np.ndarray:
    """uint32 rolling hash at each byte over the 32 bytes that end there."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        if len(h) > w:
            new = h.copy()
            new[w:] += h[:-w] << np.uint32(w)
            h = new
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, p: Params) -> list[list[int]]:
    """Ends of the chunks of each payload, relative to ``data``. An empty payload has none."""
    # the last byte moves the low bits of the hash, so the mask takes the high ones
    spots = np.flatnonzero(gear(data) >> np.uint32(32 - p.bits) == 0) + 1
    lo, hi = np.searchsorted(spots, offsets[:-1], "right"), np.searchsorted(spots, offsets[1:], "left")
    out = []
    for d in range(len(offsets) - 1):
        at, end, ends = int(offsets[d]), int(offsets[d + 1]), []
        for s in spots[lo[d] : hi[d]].tolist():
            while s - at > p.most:
                at += p.most
                ends.append(at)
            if s - at >= p.least:
                at = s
                ends.append(at)
        while end - at > p.most:
            at += p.most
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(ends)
    return out


def _press(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _unpress(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def dictionary(payloads: DataFrame, p: Params) -> bytes:
    """A compression dictionary from at most ``samples`` payloads; empty where they are too few. It changes sizes alone."""
    # the cut is found on hashes alone, so that no task sends payloads that another one's hashes beat
    h = F.xxhash64("payload")
    cut = payloads.select(h.alias("h")).orderBy("h").limit(p.samples).agg(F.max("h")).first()[0]
    rows = payloads.where(h <= F.lit(cut)).select(F.substring("payload", 1, 1 << 16).alias("x")).limit(p.samples).collect()
    try:
        return zstandard.train_dictionary(1 << 16, [bytes(r.x) for r in rows]).as_bytes() if len(rows) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def references(payloads: DataFrame, p: Params = Params()) -> DataFrame:
    """(blob, nth, digest) of every chunk of ``payloads(payload)``: the ordered chunk lists. A blob is a payload's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in slices(b.column(0), 1 << 21):
                raw, rows = data.tobytes(), ([], [], [])
                for begin, stop, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts(data, offsets, p)):
                    blob = hashlib.sha256(raw[begin:stop]).digest()
                    for nth, end in enumerate(ends):
                        for column, value in zip(rows, (blob, nth, hashlib.sha256(raw[begin:end]).digest())):
                            column.append(value)
                        begin = end
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int32(), pa.binary()))], ["blob", "nth", "digest"])

    return payloads.select("payload").mapInArrow(released(run), "blob binary, nth int, digest binary")


PLAIN, LENT, BORROWED = 0, 1, 2


def roles(refs: DataFrame) -> DataFrame:
    """(blob, nth, digest, role) of the chunks that stand in several places: the first place lends it, the others borrow."""
    owners = refs.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("blob", "nth")).alias("owner")).where("n > 1")
    mine = F.struct("blob", "nth") == F.col("owner")
    return refs.join(owners, "digest").select("blob", "nth", "digest", F.when(mine, LENT).otherwise(BORROWED).alias("role"))


_STORE = "blob binary, size bigint, borrows int, lends int, parts array<struct<nth:int,size:int,digest:binary,role:int>>, frame binary"


def store(payloads: DataFrame, shared: DataFrame, p: Params, words: bytes) -> DataFrame:
    """A row for each blob: its chunk list, and a compressed frame of those of its chunks that it doesn't borrow.

    Every distinct chunk is in one frame only. A payload moves once, compressed, to meet the roles of its chunks.
    """

    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _press(words, p.level)
        for b in batches:
            raw = b.column(0).to_pylist()
            yield pa.record_batch([pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([press.compress(x) for x in raw], pa.binary())], ["blob", "whole"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = _press(words, p.level), _unpress(words)
        kind = pa.list_(pa.struct([("nth", pa.int32()), ("size", pa.int32()), ("digest", pa.binary()), ("role", pa.int32())]))
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k in range(b.num_rows):
                raw = unpress.decompress(b.column(1)[k].as_py())
                role = {x["nth"]: x["role"] for x in b.column(2)[k].as_py() or ()}
                data, begin, parts, own = np.frombuffer(raw, np.uint8), 0, [], []
                for nth, end in enumerate(cuts(data, np.array([0, len(raw)]), p)[0]):
                    chunk = raw[begin:end]
                    parts.append({"nth": nth, "size": len(chunk), "digest": hashlib.sha256(chunk).digest(), "role": role.get(nth, PLAIN)})
                    if parts[-1]["role"] != BORROWED:
                        own.append(chunk)
                    begin = end
                values = list(role.values())
                for column, value in zip(rows, (b.column(0)[k].as_py(), len(raw), values.count(BORROWED), values.count(LENT), parts, press.compress(b"".join(own)))):
                    column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), kind, pa.binary()))], ["blob", "size", "borrows", "lends", "parts", "frame"])

    whole = payloads.select("payload").mapInArrow(released(shut), "blob binary, whole binary").groupBy("blob").agg(F.first("whole").alias("whole"))
    marks = shared.groupBy("blob").agg(F.collect_list(F.struct("nth", "role")).alias("marks"))
    return whole.join(marks, "blob", "left").select("blob", "whole", "marks").mapInArrow(released(lay), _STORE)


def _lend(words: bytes, level: int):
    """The bytes of the lent chunks of store rows (parts, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = _press(words, level), _unpress(words)
        for b in batches:
            out: tuple[list, list] = ([], [])
            for k in range(b.num_rows):
                raw, at = unpress.decompress(b.column(1)[k].as_py()), 0
                for part in b.column(0)[k].as_py():
                    if part["role"] != BORROWED:
                        if part["role"] == LENT:
                            out[0].append(part["digest"])
                            out[1].append(press.compress(raw[at : at + part["size"]]))
                        at += part["size"]
            yield pa.record_batch([pa.array(x, pa.binary()) for x in out], ["digest", "packed"])

    return run


def _rebuild(words: bytes):
    """Put payloads together from (blob, size, parts, frame, fetched) and hold every chunk and the whole against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = _unpress(words)
        for b in batches:
            out = []
            for k in range(b.num_rows):
                blob, size, parts = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py()
                raw, at, sha, ok = unpress.decompress(b.column(3)[k].as_py()), 0, hashlib.sha256(), True
                fetched = {x["nth"]: x["packed"] for x in b.column(4)[k].as_py() or ()}
                for part in parts:
                    if part["role"] == BORROWED:
                        packed = fetched.get(part["nth"])
                        chunk = unpress.decompress(packed) if packed is not None else b""
                    else:
                        chunk = raw[at : at + part["size"]]
                        at += part["size"]
                    ok &= hashlib.sha256(chunk).digest() == part["digest"]
                    sha.update(chunk)
                out.append((blob, len(parts), size, ok and sha.digest() == blob))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["blob", "chunks", "size", "verified"])

    return run


_BUILT = "blob binary, chunks int, size bigint, verified boolean"


def reconstruct(stored: DataFrame, words: bytes, level: int = 3) -> DataFrame:
    """(blob, chunks, size, verified) of every stored payload, rebuilt and checked.

    A payload that borrows nothing is rebuilt where it lies; for the others the lent chunks come by a join on the digest.
    """
    none = F.lit(None).cast("array<struct<nth:int,packed:binary>>").alias("fetched")
    alone = stored.where("borrows = 0").select("blob", "size", "parts", "frame", none)
    needs = stored.where("borrows > 0")
    wanted = needs.select("blob", F.explode("parts").alias("x")).where(F.col("x.role") == BORROWED).select("blob", "x.nth", "x.digest")
    lent = stored.where("lends > 0").select("parts", "frame").mapInArrow(released(_lend(words, level)), "digest binary, packed binary")
    fetched = wanted.join(lent, "digest").groupBy("blob").agg(F.collect_list(F.struct("nth", "packed")).alias("fetched"))
    joined = needs.join(fetched, "blob", "left").select("blob", "size", "parts", "frame", "fetched")
    return alone.mapInArrow(released(_rebuild(words)), _BUILT).unionByName(joined.mapInArrow(released(_rebuild(words)), _BUILT))


def chunked(media: DataFrame, key: str, payload: str, p: Params = Params()) -> DataFrame:
    """(media_id, chunks, size, verified) of every payload after a round trip through the deduplicated store.

    ``verified`` says that each chunk and the whole have their digests again. An empty payload has 0 chunks. Rows with a null
    key or payload are left out; equal rows give one row, and a key with several payloads a row for each of them. Keys may be of
    any kind, and an empty table gives an empty one.
    """
    rows = media.select(F.col(key).alias("media_id"), F.col(payload).cast("binary").alias("payload")).dropna()
    payloads, words = rows.select("payload"), dictionary(rows.select("payload"), p)
    refs = materialize(references(payloads, p).distinct(), "chunk-references")
    shared = materialize(roles(refs), "chunk-roles")  # a table of its own, so that its shuffles are gone before payloads move
    stored = materialize(store(payloads, shared, p, words), "chunk-store")
    names = rows.select("media_id", F.unhex(F.sha2("payload", 256)).alias("blob")).distinct()
    return names.join(reconstruct(stored, words, p.level), "blob").select("media_id", "chunks", "size", "verified")
