"""Removal of repeated passages by suffixes sorted block by block, with a difference cover for long ties.

Equal passages of ``length`` bytes have the same smallest anchor (hash of a shorter substring), so consecutive starts of
one smallest anchor travel together, as a piece of text, to the bucket of that anchor.  A first exchange of anchors
alone finds those that occur in two places; only pieces around them are sent.  In a bucket the starts are sorted as
suffixes, one range of first bytes at a time: by their first 32 bytes, and where these tie by the ranks of a difference
cover sample, for two suffixes always reach sampled positions together within a period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from newsgraph.session import cut_lineage

from .common import as_bytes, slices

#: Bytes of a passage.
LENGTH = 50
#: Difference cover: every difference modulo the period is one of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of documents in one slice, and of text in one bucket on average.
SLICE, BUCKET = 8 << 20, 8 << 20
#: Suffixes sorted at once, bytes hashed at once, and starts in one piece at most.
BLOCK, _CHUNK, _PIECE = 1 << 20, 1 << 20, 512
_LAST = (1 << 63) - 1

_FACTOR, _MIX, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 40) - 1)


def _shifts() -> np.ndarray:
    """Steps after which two positions, by their remainders, are both sampled."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for x in range(PERIOD):
        for y in range(PERIOD):
            out[x, y] = next(s for s in range(PERIOD) if (x + s) % PERIOD in COVER and (y + s) % PERIOD in COVER)
    return out


class Anchors:
    """Pieces of concatenated texts: runs of starts of passages that have one smallest anchor."""

    def __init__(self, length: int = LENGTH):
        if length < 40:
            raise ValueError("a passage has 40 bytes at least")
        self.length, self.size = length, length - PERIOD + 1
        most = _CHUNK + length
        self.powers = np.full(most, _FACTOR, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.inverses = np.full(most, pow(_FACTOR, -1, 1 << 64), np.uint64)
        self.inverses[0] = 1
        self.inverses = np.multiply.accumulate(self.inverses)

    def smallest(self, data: np.ndarray) -> np.ndarray:
        """Smallest anchor of the passage at each start of ``data``."""
        n = len(data)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(data * self.powers[:n], out=sums[1:])
        h = sums[self.size:] - sums[:-self.size]
        h *= self.inverses[:len(h)]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        for step in (1, 2, 4, 8):
            h = np.minimum(h[:-step], h[step:])
        return np.minimum(h[:-(PERIOD - 16)], h[PERIOD - 16:])

    def pieces(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, number of starts and anchor of each piece; no passage crosses texts, of ``sizes``."""
        firsts = np.cumsum(sizes) - sizes
        found = []
        edge = np.zeros(len(data) + 1, np.int8)
        long = sizes >= self.length
        edge[firsts[long]] += 1
        np.subtract.at(edge, firsts[long] + sizes[long] - self.length + 1, 1)
        for at in range(0, max(0, len(data) - self.length + 1), _CHUNK):
            part = data[at:at + _CHUNK + self.length - 1]
            low = self.smallest(part)
            valid = np.cumsum(edge[at:at + len(low)], dtype=np.int8) + (edge[:at].sum(dtype=np.int64) if at else 0) > 0
            same = np.zeros(len(low) + 1, bool)
            same[1:-1] = valid[1:] & valid[:-1] & (low[1:] == low[:-1])
            begin, end = np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:]) + 1
            count = end - begin
            if len(count) and count.max() > _PIECE:
                times = -(-count // _PIECE)
                which = np.repeat(np.arange(len(count)), times)
                step = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)) * _PIECE
                begin, count = begin[which] + step, np.minimum(count[which] - step, _PIECE)
            found.append((begin + at, count, low[begin]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found))


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place, as numbers in the order of the bytes."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))[at].astype(np.uint64)


def refine(text: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by that many words of eight bytes, and where it differs from the one before."""
    key = _words(text, at)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(1, words):
        tied = ~new
        tied[:-1] |= ~new[1:]
        a = np.flatnonzero(tied)
        if not len(a):
            break
        group = np.cumsum(new)[a]
        key = _words(text, at[order[a]] + 8 * k)
        o = np.lexsort((key, group))
        order[a], key = order[a][o], key[o]
        new[a[1:]] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return order, new


class Cover:
    """Ranks of the sampled suffixes of a text, and suffixes in order by them."""

    shifts = _shifts()

    def __init__(self, text: np.ndarray, end: int, length: int):
        self.text, self.length = text, length
        at = (np.arange(0, end, PERIOD)[:, None] + np.array(COVER)).ravel()
        self.rank = np.zeros(len(at), np.int64)
        inside = np.flatnonzero(at < end)
        order, new = refine(text, at[inside], -(-length // 8))
        self.rank[inside[order]] = np.cumsum(new)
        self.member = np.zeros(PERIOD, np.int64)
        self.member[list(COVER)] = np.arange(len(COVER))

    def ranks(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * len(COVER) + self.member[at % PERIOD]]

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, and where its passage differs from that of the one before.

        Ties beyond the period are parted around a pivot each, all groups at once, by the ranks that both sides reach.
        """
        order, new = refine(self.text, at, 4)
        apart = new.copy()
        done = np.zeros(len(at), bool)
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            a = np.flatnonzero(tied & ~done)
            if not len(a):
                break
            start = np.flatnonzero(new[a])
            size = np.diff(np.r_[start, len(a)])
            group = np.repeat(np.arange(len(start)), size)
            x, pivot = at[order[a]], at[order[a[start + size // 2]]][group]
            shift = self.shifts[x % PERIOD, pivot % PERIOD]
            side = np.sign(self.ranks(x + shift) - self.ranks(pivot + shift))
            o = np.lexsort((side, group))
            order[a], side = order[a][o], side[o]
            new[a[1:]] = (side[1:] != side[:-1]) | (group[1:] != group[:-1])
            done[a] = side == 0
        near = np.flatnonzero(~apart)  # equal in their first 32 bytes
        here, before = at[order[near]], at[order[near - 1]]
        for k in [*range(32, self.length - 8, 8), self.length - 8]:
            same = _words(self.text, here + k) == _words(self.text, before + k)
            apart[near[~same]] = True
            near, here, before = near[same], here[same], before[same]
        return order, apart


def earliest(pieces: list[bytes], first: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of ``first`` over all pieces that hold each passage, start by start, and where each piece's starts begin."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces) + bytes(128), np.uint8)
    starts = sizes - length + 1
    begin = np.cumsum(starts) - starts
    piece = np.repeat(np.arange(len(pieces)), starts)
    at = np.arange(int(starts.sum())) - np.repeat(begin - (np.cumsum(sizes) - sizes), starts)
    cover = Cover(text, int(sizes.sum()), length)
    out = np.empty(len(at), np.int64)
    if len(at) > block:
        key = _words(text, at)
        sample = np.sort(key[::max(1, len(key) // 65536)])
        cuts = np.unique(sample[len(sample) * np.arange(1, -(-len(at) // block)) // -(-len(at) // block)])
        bucket = np.searchsorted(cuts, key, "right")
        blocks = (np.flatnonzero(bucket == b) for b in range(len(cuts) + 1))
    else:
        blocks = [np.arange(len(at))]
    for rows in blocks:
        if len(rows):
            order, apart = cover.sort(at[rows])
            rows = rows[order]
            edge = np.flatnonzero(apart)
            low = np.minimum.reduceat(first[piece[rows]], edge)
            out[rows] = np.repeat(low, np.diff(np.r_[edge, len(rows)]))
    return out, begin


def _load(batch: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Columns, bytes of all texts together, and sizes of a packed slice."""
    rows = next(iter(pa.ipc.open_stream(batch)))
    texts = [x or b"" for x in as_bytes(rows.column("__text"))]
    return rows, np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def pack(docs: DataFrame, key: str, keep: list[str], text: str, size: int = SLICE) -> DataFrame:
    """Slices of documents: ``uid``, ``size`` (bytes of text) and ``batch`` (columns ``keep``, key and text, compressed)."""
    rows = docs.select(*keep, F.col(key).cast("bigint").alias("__key"), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", size):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in part.columns], schema=part.schema))
                packed = out.getvalue().to_pybytes()
                total = sum(len(x or b"") for x in as_bytes(part.column("__text")))
                yield pa.RecordBatch.from_pydict({"uid": pa.array([xxhash.xxh64_intdigest(packed) - (1 << 63)], pa.int64()),
                                                  "size": pa.array([total], pa.int64()), "batch": pa.array([packed], pa.binary())})

    return rows.mapInArrow(run, "uid bigint, size bigint, batch binary")


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _numbers(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by_bucket(values: np.ndarray, buckets: int):
    """Rows of each bucket that has any."""
    bucket = ((values >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
    for s, e in zip(edge, [*edge[1:], len(order)]):
        yield int(bucket[order[s]]), order[s:e]


def in_two(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Of each list without repeats the values that another list has too: all are sorted once, however many lists."""
    values = np.concatenate(lists)
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    found = np.zeros(len(values), bool)
    found[order] = np.r_[False, same] | np.r_[same, False]
    edges = np.cumsum([0, *map(len, lists)])
    return [values[a:b][found[a:b]] for a, b in zip(edges, edges[1:])]


def shared_anchors(packed: DataFrame, length: int, buckets: int) -> DataFrame:
    """``uid`` and ``hashes`` of the anchors of a slice that another slice has too, by bucket."""

    def send(batches):
        anchors = Anchors(length)
        for batch in batches:
            for uid, data in zip(batch.column("uid").to_pylist(), batch.column("batch").to_pylist()):
                _, bytes_, sizes = _load(data)
                values = np.unique(anchors.pieces(bytes_, sizes)[2] * _SPREAD)
                rows = [(b, uid, _five(values[which] & _LOW)) for b, which in _by_bucket(values, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "uid", "hashes"])

    def meet(table: pa.Table) -> pa.Table:
        lists = in_two([_numbers(x) for x in table.column("hashes").to_pylist()])
        out = [(uid, _five(mine)) for uid, mine in zip(table.column("uid").to_pylist(), lists) if len(mine)]
        return pa.table({"uid": pa.array([x[0] for x in out], pa.int64()), "hashes": pa.array([x[1] for x in out], pa.binary())})

    return packed.select("uid", "batch").mapInArrow(send, "bucket int, uid bigint, hashes binary").groupBy("bucket").applyInArrow(meet, "uid bigint, hashes binary")


def _pack_arrays(press, *arrays: np.ndarray) -> list[bytes]:
    return [press(a.tobytes()) for a in arrays]


PIECES = "bucket int, uid bigint, text binary, sizes binary, counts binary, docs binary, places binary, starts binary"


def send_pieces(packed: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """Pieces around shared anchors by bucket, each text once a slice with the documents and starts that have it."""

    def run(batches):
        anchors, press = Anchors(length), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for uid, data, lists in zip(*(batch.column(c).to_pylist() for c in ("uid", "batch", "lists"))):
                rows, bytes_, sizes = _load(data)
                begin, count, low = anchors.pieces(bytes_, sizes)
                low = low * _SPREAD
                values, where, times = np.unique(low, return_inverse=True, return_counts=True)
                known = np.sort(np.concatenate([_numbers(x) for x in lists])) if lists else np.zeros(0, np.uint64)
                chosen = np.flatnonzero(((times > 1) | np.isin(values & _LOW, known))[where])
                if not len(chosen):
                    continue
                firsts = np.cumsum(sizes) - sizes
                place = np.searchsorted(firsts, begin[chosen], "right") - 1
                keys = np.array([_LAST if x is None else x for x in rows.column("__key").to_pylist()], np.int64)[place]
                start = (begin[chosen] - firsts[place]).astype(np.int64)
                raw = bytes_.tobytes()
                names: list = []
                for b, which in _by_bucket(low[chosen], buckets):
                    known_texts: dict[bytes, int] = {}
                    piece = np.fromiter((known_texts.setdefault(raw[s:s + n + length - 1], len(known_texts)) for s, n in zip(
                        begin[chosen[which]].tolist(), count[chosen[which]].tolist())), np.int64, len(which))
                    order = which[np.argsort(piece, kind="stable")]
                    names.append((b, uid, press(b"".join(known_texts)), *_pack_arrays(
                        press, np.fromiter(map(len, known_texts), np.int32, len(known_texts)), np.bincount(piece).astype(np.int32),
                        keys[order], place[order].astype(np.int32), start[order])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                    zip(*names), (pa.int32(), pa.int64(), *[pa.binary()] * 6))], names=[c.split()[0] for c in PIECES.split(", ")])

    lists = shared.groupBy("uid").agg(F.collect_list("hashes").alias("lists"))
    return packed.select("uid", "batch").join(lists, "uid", "left").mapInArrow(run, PIECES)


def removed(pieces: DataFrame, length: int, block: int) -> DataFrame:
    """``uid``, ``places``, ``starts`` and ``ends`` of the passages of a slice that an earlier document has too."""

    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        texts: dict[bytes, int] = {}
        piece, docs, out = [], [], []
        rows = table.to_pylist()
        for row in rows:
            text, at = open_(row["text"]), 0
            mine = []
            for size in np.frombuffer(open_(row["sizes"]), np.int32).tolist():
                mine.append(texts.setdefault(text[at:at + size], len(texts)))
                at += size
            piece.append(np.repeat(np.array(mine), np.frombuffer(open_(row["counts"]), np.int32)))
            docs.append(np.frombuffer(open_(row["docs"]), np.int64))
        ends = np.cumsum([len(x) for x in docs])
        piece, docs = np.concatenate(piece), np.concatenate(docs)
        first = np.full(len(texts), _LAST, np.int64)
        np.minimum.at(first, piece, docs)
        low, begin = earliest(list(texts), first, length, block)
        least, most = np.minimum.reduceat(low, begin), np.maximum.reduceat(low, begin)
        starts = np.diff(np.r_[begin, len(low)])
        for row, e, s in zip(rows, ends, [0, *ends[:-1]]):
            mine, own = piece[s:e], docs[s:e]
            place, start = np.frombuffer(open_(row["places"]), np.int32), np.frombuffer(open_(row["starts"]), np.int64)
            whole = np.flatnonzero(own > most[mine])
            part = np.flatnonzero((own > least[mine]) & (own <= most[mine]))
            n = starts[mine[part]]
            which = np.repeat(part, n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            hit = low[begin[mine[which]] + step] < own[which]
            new = hit.copy()
            new[1:] &= ~(hit[:-1] & (which[1:] == which[:-1]))
            last = hit.copy()
            last[:-1] &= ~(hit[1:] & (which[1:] == which[:-1]))
            a, b = np.flatnonzero(new), np.flatnonzero(last)
            places = np.r_[place[whole], place[which[a]]]
            if len(places):
                out.append((row["uid"], places.astype(np.int32).tobytes(), np.r_[start[whole], start[which[a]] + step[a]].tobytes(),
                            np.r_[start[whole] + starts[mine[whole]] + length - 1, start[which[b]] + step[b] + length].tobytes()))
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(
            (("uid", pa.int64()), ("places", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())))})

    return pieces.groupBy("bucket").applyInArrow(run, "uid bigint, places binary, starts binary, ends binary")


def deduplicate(
    docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", length: int = LENGTH, slice_bytes: int = SLICE, bucket_bytes: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """Columns ``keep``, ``kept`` (remaining bytes), ``n_bytes``, ``n_removed``, and ``starts`` and ``ends`` of maximal removed runs.

    A byte goes if it lies in a passage of ``length`` bytes that also starts in a document of smaller key, in the input
    as given.  A null text is empty; a text shorter than a passage stays whole.  A null key comes after all others, so
    such rows lose what keyed documents have and take nothing; rows of equal key take nothing from each other.  Texts of
    any length are taken whole, repeated rows each give a row, and an empty table gives none.  An own column replaces a
    kept one of the same name.
    """
    out = "kept binary, n_bytes bigint, n_removed bigint, starts array<bigint>, ends array<bigint>"
    keep = [c for c in keep if c not in StructType.fromDDL(out).names]
    packed = cut_lineage(pack(docs, key, keep, text, slice_bytes))
    buckets = 1 + int(packed.agg(F.sum("size")).first()[0] or 0) // bucket_bytes
    pieces = send_pieces(packed, shared_anchors(packed, length, buckets), length, buckets)
    found = removed(pieces, length, block)
    lists = found.groupBy("uid").agg(F.collect_list(F.struct("places", "starts", "ends")).alias("lists"))
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(out)])

    def finish(batches):
        for batch in batches:
            for data, lists in zip(batch.column("batch").to_pylist(), batch.column("lists").to_pylist()):
                rows, bytes_, sizes = _load(data)
                firsts = np.cumsum(sizes) - sizes
                begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x in lists or []:
                    at = firsts[np.frombuffer(x["places"], np.int32)]
                    begin.append(at + np.frombuffer(x["starts"], np.int64))
                    end.append(at + np.frombuffer(x["ends"], np.int64))
                begin, end = np.concatenate(begin), np.concatenate(end)
                order = np.argsort(begin)
                begin, end = begin[order], end[order]
                doc = np.searchsorted(firsts + sizes, begin, "right")
                reach = np.maximum.accumulate(end)  # ends never pass their own text, so no run joins two texts but by touching
                new = np.ones(len(begin), bool)
                new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
                a = np.flatnonzero(new)
                begin, end, doc = begin[a], reach[np.r_[a[1:], len(reach)] - 1] if len(a) else end, doc[a]
                gone = np.zeros(len(bytes_) + 1, np.int8)
                np.add.at(gone, begin, 1)
                np.subtract.at(gone, end, 1)
                left = np.cumsum(gone[:-1], dtype=np.int8) == 0
                keep_to = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[left], minlength=len(sizes)))]
                kept = bytes_[left].tobytes()
                edge = np.searchsorted(doc, np.arange(len(sizes) + 1))
                local = [begin - firsts[doc], end - firsts[doc]]
                yield pa.RecordBatch.from_arrays([
                    *(rows.column(c) for c in keep), pa.array([kept[s:e] for s, e in zip(keep_to, keep_to[1:])], pa.binary()), pa.array(sizes),
                    pa.array(sizes - np.diff(keep_to)), *(pa.array([x[s:e].tolist() for s, e in zip(edge, edge[1:])], pa.list_(pa.int64())) for x in local)],
                    names=schema.names)

    return packed.select("uid", "batch").join(lists, "uid", "left").mapInArrow(finish, schema)
