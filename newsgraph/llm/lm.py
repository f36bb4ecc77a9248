"""Language-model scores from a log-frequency Bloom filter of n-gram counts, and an exact add-one base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsgraph.session import cut_lineage

from .common import LOWER, UPPER, as_bytes, held_out, map_texts, slices

#: Bits of the filter at least; it grows with the n-grams, none of which is left out.
FILTER_BITS = 1 << 27
#: Bits of the largest filter that is broadcast; n-grams of the texts meet the segments of a larger one in a join.
MOST_BROADCAST = 1 << 29
#: Bytes of segments, and of texts, that meet in one group of that join, about.
_PART = 32 << 20
#: Bits set for each n-gram and level.
PROBES = 4
#: Words of a larger share than one in so many are head words: so many at most, broadcast as hash and count (16 bytes).
HEAD = 1 << 20
#: Weight of the bigram estimate.
BIGRAM = 0.6
#: n-gram entries that one counting group gets, about.
GROUP = 1 << 19
#: Tokens gathered in a task before equal n-grams are added up.
_GATHER = 1 << 22
_BLOCK = 1 << 20
_SLICE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(size, _BLOCK + 1) - 1, b)))) for b in (_BASE, _INVERSE)]
    return _powers


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and one past the last byte, and the 64-bit hash, of each run of bytes that are no ASCII white space.

    The hash is a polynomial in the bytes, a difference of running sums: no step per word.  Blocks of a megabyte, each
    ended between words, bound the memory whatever the text.
    """
    found, at = [], 0
    while at < len(data):
        stop = at + _BLOCK
        while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
            step = np.flatnonzero(_SPACE[np.frombuffer(data[stop : stop + 4096], np.uint8)])
            stop += int(step[0]) if len(step) else 4096
        b = np.frombuffer(data[at:stop], np.uint8)
        power, inverse = _power(len(b) + 1)
        inside = np.diff(np.concatenate(([0], ~_SPACE[b], [0])).astype(np.int8))
        first, last = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[b] * power[: len(b)], dtype=np.uint64)))
        found.append((first + at, last + at, mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))))
        at = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*found)))


def tokens(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer; each word's start, end and hash; and each word's text."""
    data = [(t or b"").lower() for t in texts]
    buffer = b"\n".join(data)
    starts, ends, hashes = words(buffer)
    offsets = np.cumsum([0, *(len(d) + 1 for d in data)])
    return buffer, starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def grams(hashes: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token sequence of ``count`` texts, an end after each: unigram and bigram hashes, text, and the first tokens."""
    total = len(hashes) + count
    at = np.arange(len(hashes)) + owner
    one, whose = np.full(total, END), np.empty(total, np.int64)
    one[at] = hashes
    stops = np.ones(total, bool)
    stops[at] = False
    whose[at] = owner
    whose[stops] = np.arange(count)
    first = np.concatenate(([True], stops[:-1]))[:total]
    before = np.where(first, START, np.concatenate((one[:1], one[:-1])))
    return one, mix(before * np.uint64(0xD6E8FEB86659FD93) + one), whose, first


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


@dataclass
class Filter:
    """Bits in segments, one a counting group in their order; where each starts, and the end; mean counts by level."""

    bits: np.ndarray
    starts: np.ndarray
    mean: np.ndarray

    def place(self, h: np.ndarray, level: np.ndarray | int, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit of a probe.  The n-grams are of groups with a segment."""
        group = _group(h, len(self.starts) - 1)
        start = self.starts[group]
        size = (8 * (self.starts[group + 1] - start)).astype(np.uint64)
        bit = mix(_rest(h) * np.uint64(0xA0761D6478BD642F) + np.asarray(level).astype(np.uint64) * np.uint64(PROBES) + np.uint64(probe)) % size
        return start + (bit >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level found by probing upwards; 0 for an n-gram that was not learned."""
        level = np.ones(len(h), np.int64)
        left = np.flatnonzero(np.diff(self.starts)[_group(h, len(self.starts) - 1)])
        top = np.zeros(len(h), np.int64)
        while len(left):
            for probe in range(PROBES):
                byte, mask = self.place(h[left], level[left], probe)
                left = left[(self.bits[byte] & mask) != 0]
            left = left[level[left] < len(self.mean) - 1] if len(left) else left
            top[left] = level[left]
            level[left] += 1
        return top

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Mean count of the level found; 0 for an n-gram that was not learned."""
        return self.mean[self.levels(h)]


def assembled(segments: dict[int, bytes], groups: int, mean: np.ndarray) -> Filter:
    """The filter of some groups' segments."""
    sizes = np.zeros(groups, np.int64)
    for g, segment in segments.items():
        sizes[g] = len(segment)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    bits = np.zeros(starts[-1], np.uint8)
    for g, segment in segments.items():
        bits[starts[g] : starts[g + 1]] = np.frombuffer(segment, np.uint8)
    return Filter(bits, starts, mean)


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % groups


def _rest(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 48) - 1)


def _pack(h: np.ndarray, counts: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each group, the low 48 bits of its n-grams and their counts."""
    group = _group(h, groups)
    order = np.argsort(group, kind="stable")
    h, counts, edges = h[order], counts[order], np.searchsorted(group[order], np.arange(groups + 1))
    low = h.view(np.uint8).reshape(-1, 8)[:, :6]
    for g in range(groups):
        a, b = edges[g], edges[g + 1]
        if a < b:
            yield g, low[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def counted(docs: DataFrame, groups: int, text: str = "text") -> DataFrame:
    """Partial counts of all uni- and bigrams: ``grp``, ``grams``, ``counts``, a row a group and some million tokens."""

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch, "t", _SLICE):
                texts = as_bytes(part.column("t"))
                _, _, _, hashes, owner = tokens(texts)
                one, two, _, first = grams(hashes, owner, len(texts))
                both = np.concatenate((one, two, np.full(first.sum(), START)))
                parts.append(_added([(both, np.ones(len(both), np.int64))]))
                size += len(both)
                if size >= _GATHER:
                    yield from _blobs(parts, groups)
                    parts, size = [], 0
        if parts:
            yield from _blobs(parts, groups)

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "grp int, grams binary, counts binary")


def _blobs(parts, groups: int) -> Iterator[pa.RecordBatch]:
    rows = list(_pack(*_added(parts), groups))
    for i in range(0, len(rows), 256):
        g, a, b = zip(*rows[i : i + 256])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["grp", "grams", "counts"])


def segments(docs: DataFrame, tokens_in: int, text: str = "text", bits: int = FILTER_BITS) -> tuple[DataFrame, int, int, np.ndarray]:
    """Segments of the filter over all of ``docs`` (``grp``, ``segment``), the groups, bytes in all, and mean counts by level.

    ``tokens_in`` (their tokens) sets how many groups count n-grams side by side.  Tasks add up equal n-grams and send
    packed partial counts to each group, so a frequent n-gram is one entry a task.  A group adds these, quantises the
    counts and fills its own segment, sized to be at most half full with every n-gram at all of its levels, and to its
    share of ``bits`` at least.  The segments are written to the shared folder; only sums by level reach the driver.
    """
    groups = 16
    while groups * GROUP < 2 * tokens_in:
        groups *= 2
    least = max(1, bits // 8 // groups)

    def fill(key, table):
        parts = []
        for low, n in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist()):
            h = np.zeros((len(low) // 6, 8), np.uint8)
            h[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
            parts.append((h.view("<u8").ravel(), np.frombuffer(n, "<u4").astype(np.int64)))
        h, n = _added(parts)
        level = levels(n)
        held = np.bincount(level, minlength=65)[:65]
        total = np.bincount(level, weights=n, minlength=65)[:65]
        size = max(least, int(np.ceil(PROBES * level.sum() / (0.69 * 8))))
        own = Filter(np.zeros(size, np.uint8), np.array([0, size]), np.zeros(65))
        for j in range(1, int(level.max()) + 1):
            some = h[level >= j]
            for probe in range(PROBES):
                byte, mask = own.place(some, j, probe)
                np.bitwise_or.at(own.bits, byte, mask)
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([own.bits.tobytes()], pa.binary()),
                         "held": pa.array([held.tolist()], pa.list_(pa.int64())), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    made = cut_lineage(counted(docs, groups, text).groupBy("grp").applyInArrow(fill, "grp int, segment binary, held array<bigint>, total array<double>"))
    size = made.agg(F.coalesce(F.sum(F.octet_length("segment").cast("bigint")), F.lit(0))).first()[0]
    held, total = np.zeros(65), np.zeros(65)
    for row in made.select(F.posexplode(F.arrays_zip("held", "total"))).groupBy("pos").agg(F.sum("col.held").alias("held"), F.sum("col.total").alias("total")).collect():
        held[row["pos"]], total[row["pos"]] = row["held"], row["total"]
    return made.select("grp", "segment"), groups, size, np.divide(total, held, out=np.zeros(65), where=held > 0)


def build(docs: DataFrame, tokens_in: int, text: str = "text", bits: int = FILTER_BITS) -> Filter:
    """The filter over all of ``docs``, with the :func:`segments` brought to the driver."""
    made, groups, _, mean = segments(docs, tokens_in, text, bits)
    return assembled({r["grp"]: r["segment"] for r in made.toLocalIterator()}, groups, mean)


def estimate(c1: np.ndarray, c2: np.ndarray, first: np.ndarray, start: float, add_one: int, bigram: float) -> np.ndarray:
    """log10 of each token's interpolated estimate, from counts of its unigram and bigram in token order."""
    c0 = np.where(first, start, np.concatenate((c1[:1], c1[:-1])))
    p2 = np.minimum(1.0, np.divide(c2, c0, out=np.zeros(len(c0)), where=c0 > 0))
    return np.log10(bigram * p2 + (1 - bigram) * (c1 + 1) / add_one)


def joined_scores(
    source: DataFrame, made: DataFrame, groups: int, size: int, mean: np.ndarray, ends: int, add_one: int, bigram: float, part: int = _PART,
) -> DataFrame:
    """``k``, ``digest`` and ``score`` of the texts ``t``, by a filter too large to broadcast.

    Slices of the texts send their distinct n-grams, packed, to the parts of the filter, and get levels back in the same
    order; a slice's places of n-grams travel with them.  A part holds about ``part`` bytes of segments.  Many texts meet
    copies of the parts, as many as keep what meets in one of them near ``part`` bytes of text.
    """
    kind = source.schema["k"].dataType.simpleString()
    read = source.agg(F.coalesce(F.sum(F.octet_length("t").cast("bigint")), F.lit(0))).first()[0]
    parts = min(groups, -(-size // part))
    copies = max(1, -(-read // (part * parts)))
    names = ["slice", "part", "copy", "grams", "keys", "digests", "sizes", "places"]
    carried = f"keys array<{kind}>, digests binary, sizes binary, places binary"

    def send(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get(), 0
        for batch in batches:
            for some in slices(batch, "t", _SLICE):
                texts = as_bytes(some.column("t"))
                _, _, _, hashes, owner = tokens(texts)
                one, two, _, _ = grams(hashes, owner, len(texts))
                distinct, places = np.unique(np.concatenate((one, two)), return_inverse=True)
                to = _group(distinct, groups) * parts // groups
                order = np.argsort(to, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                distinct, edges = distinct[order], np.searchsorted(to[order], np.arange(parts + 1))
                digests = np.array([xxhash.xxh64_intdigest(t or b"") for t in texts], np.uint64)
                name, copy = f"{task.partitionId()}:{number}", (task.partitionId() + number) % copies
                number += 1
                filled = np.flatnonzero(np.diff(edges))
                m = len(filled)
                none = pa.nulls(m, pa.binary())
                keys = some.column("k")
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * m, pa.string()), pa.array(filled, pa.int32()), pa.array([copy] * m, pa.int32()),
                    pa.array([distinct[edges[g] : edges[g + 1]].tobytes() for g in filled], pa.binary()), pa.nulls(m, pa.list_(keys.type)), none, none, none], names=names)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name]), pa.array([number % parts], pa.int32()), pa.array([copy], pa.int32()), pa.nulls(1, pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([digests.tobytes()]),
                    pa.array([(np.bincount(owner, minlength=len(texts)) + 1).astype(np.int64).tobytes()]), pa.array([rank[places].tobytes()])], names=names)

    def look(key, left, right):
        f = assembled(dict(zip(right.column("grp").to_pylist(), right.column("segment").to_pylist())), groups, mean)
        found = [None if g is None else f.levels(np.frombuffer(g, np.uint64)).astype(np.uint8).tobytes() for g in left.column("grams").to_pylist()]
        return left.drop_columns(["copy", "grams"]).append_column("levels", pa.array(found, pa.binary())).combine_chunks()

    def finish(key, table):
        rows = table.select(["part", "levels", "digests", "sizes", "places"]).to_pylist()
        own = next(i for i, r in enumerate(rows) if r["places"] is not None)
        level = np.frombuffer(b"".join(r["levels"] for r in sorted((r for r in rows if r["levels"] is not None), key=lambda r: r["part"])), np.uint8)
        sizes, places = np.frombuffer(rows[own]["sizes"], np.int64), np.frombuffer(rows[own]["places"], np.int32)
        c1, c2 = np.split(mean[level][places], 2)
        first = np.zeros(len(c1), bool)
        first[np.cumsum(sizes) - sizes] = True
        p = estimate(c1, c2, first, mean[levels(np.array([ends]))[0]], add_one, bigram)
        keys = table.column("keys").combine_chunks().slice(own, 1).flatten()
        return pa.table({"k": keys, "digest": pa.array(np.frombuffer(rows[own]["digests"], np.int64)),
                         "score": pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=p, minlength=len(sizes)))})

    sent = source.mapInArrow(send, f"slice string, part int, copy int, grams binary, {carried}")
    held = made.select((F.col("grp").cast("bigint") * parts / groups).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "grp", "segment")
    found = sent.groupBy("part", "copy").cogroup(held.groupBy("part", "copy")).applyInArrow(look, f"slice string, part int, {carried}, levels binary")
    return found.groupBy("slice").applyInArrow(finish, f"k {kind}, digest bigint, score double")


def score(
    docs: DataFrame, learn: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", head: int = HEAD, bits: int = FILTER_BITS,
    bigram: float = BIGRAM, most: int = MOST_BROADCAST,
) -> DataFrame:
    """Columns ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each text of ``docs``.

    ``learn`` are the texts learned from.  Tokens are runs without ASCII white space, A-Z in lower case, and one end a
    text.  ``base_score`` sums log10 of add-one unigram estimates from exact counts; ``score`` is log10 of bigram
    estimates from the filter, interpolated with its unigrams; one of over ``most`` bits is joined.  Counts of head words (a share over 1 / ``head``, so
    fewer than ``head`` words) are broadcast; the rest of a text's words, once a text, meet the table of counts in a
    join on the word, which no word can dominate.  A null text is empty: one end.  Rows that repeat key and text stay
    separate rows with equal values.  With nothing to learn from all counts are zero.  An empty table gives no rows, texts
    of any length are read whole, and no other column is read or passed, whatever its name.
    """
    context = docs.sparkSession.sparkContext
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    # the empty word stands for the end
    each = learn.select(F.explode(F.array_append(F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), ""), "")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("c"))
    counts = cut_lineage(counts)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("e")).first()
    n, v, ends = total["n"], total["v"], total["e"]

    def hashed():
        return lambda column: [pa.array([int(words(w)[2][0].view(np.int64)) for w in as_bytes(column)], pa.int64())]

    frequent = counts.filter((F.col("c") * head > n) & (F.col("word") != ""))
    rare = counts.filter(F.col("c") * head <= n)
    top = [(r["h"], r["c"]) for r in map_texts(frequent, hashed, "h bigint", ["c"], "word").toLocalIterator()]
    known = np.array([h for h, _ in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    shared = context.broadcast((known[order], np.array([c for _, c in top], np.int64)[order]))
    made, groups, size_bytes, mean = segments(learn, n, text, bits)
    small = 8 * size_bytes <= most
    model = context.broadcast(assembled({r["grp"]: r["segment"] for r in made.toLocalIterator()}, groups, mean)) if small else None
    logs = np.log10(n + v + 1)

    out = "digest bigint, word string, times int, n_tokens bigint, n_known bigint, base double, score double"
    names = ["k", "digest", "word", "times", "n_tokens", "n_known", "base", "score"]

    def run(batches):
        head_hash, head_count = shared.value
        f = model.value if small else None
        head_log = np.log10(head_count + 1)
        for batch in batches:
            for part in slices(batch, "t", _SLICE):
                texts = as_bytes(part.column("t"))
                buffer, starts, stops, hashes, owner = tokens(texts)
                if len(head_hash):
                    at = np.minimum(np.searchsorted(head_hash, hashes), len(head_hash) - 1)
                    in_head = head_hash[at] == hashes
                else:
                    at, in_head = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                size = len(texts)
                n_tokens = np.bincount(owner, minlength=size) + 1
                n_known = np.bincount(owner[in_head], minlength=size) + (ends > 0)
                base = np.bincount(owner[in_head], weights=head_log[at[in_head]] if len(head_hash) else None, minlength=size) + np.log10(ends + 1) - n_tokens * logs
                # the model
                scores = pa.nulls(size, pa.float64())
                if small:
                    one, two, whose, first = grams(hashes, owner, size)
                    u, back1 = np.unique(one, return_inverse=True)
                    b, back2 = np.unique(two, return_inverse=True)
                    p = estimate(f.counts(u)[back1], f.counts(b)[back2], first, mean[levels(np.array([ends]))[0]], n + v + 1, bigram)
                    scores = pa.array(np.bincount(whose, weights=p, minlength=size))
                # words left to the join, once a text
                tail = np.flatnonzero(~in_head)
                tail = tail[np.lexsort((hashes[tail], owner[tail]))]
                new = np.ones(len(tail), bool)
                new[1:] = (hashes[tail][1:] != hashes[tail][:-1]) | (owner[tail][1:] != owner[tail][:-1])
                firsts = np.flatnonzero(new)
                times = np.diff(np.append(firsts, len(tail)))
                tail = tail[firsts]
                digests = np.array([xxhash.xxh64_intdigest(t or b"") for t in texts], np.uint64).view(np.int64)
                keys = part.column("k")
                # a row a text, under a word that no text holds and that spreads the rows
                heads = pa.RecordBatch.from_arrays([
                    keys, pa.array(digests), pa.array([f"\n{d}:{i}" for i, d in enumerate(digests)], pa.string()), pa.array(np.ones(size, np.int32)),
                    pa.array(n_tokens), pa.array(n_known), pa.array(base), scores], names=names)
                yield heads
                for i in range(0, len(tail), 1 << 16):
                    some = tail[i : i + (1 << 16)]
                    whom, m = owner[some], len(some)
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(whom)), pa.array(digests[whom]), pa.array([buffer[s:e] for s, e in zip(starts[some], stops[some])], pa.binary()).cast(pa.string()),
                        pa.array(times[i : i + m].astype(np.int32)), none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)

    source = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    rows = source.mapInArrow(run, f"k {kind}, {out}").join(rare.withColumnRenamed("c", "c_rare"), "word", "left")
    if not small:
        rows = rows.unionByName(joined_scores(source, made, groups, size_bytes, mean, ends, n + v + 1, bigram), allowMissingColumns=True)
    heads = F.col("n_tokens").isNotNull()
    found = rows.groupBy("k", "digest").agg(
        F.sum(F.when(heads, F.lit(1)).otherwise(0)).alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("known"), F.max("base").alias("base"),
        F.max("score").alias("score"), F.sum(F.when(~heads & F.col("c_rare").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.when(~heads, F.col("times") * F.log10(F.coalesce("c_rare", F.lit(0)) + 1)).otherwise(0.0)).alias("sum"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(
        F.col("k").alias(key), "n_tokens", (F.col("known") + (F.col("more") / F.col("copies")).cast("bigint")).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + F.col("sum") / F.col("copies")).alias("base_score"), "score")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, rest: int = 2) -> DataFrame:
    """:func:`score` of all documents, learned from those that are not held out, with ``held_out``."""
    learn = docs.filter(~held_out(F.col(key), modulus, rest))
    found = score(docs, learn, [key], key, text)
    return found.withColumn("held_out", held_out(F.col(key), modulus, rest))
