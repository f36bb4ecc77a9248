"""Spelling variants: words one edit apart, found by a banded edit matrix over sorted lists of words.

A pair within one edit agrees on the first or on the last half of the word, so lists of words that share a half meet in
one place.  Each list is sorted and scanned with its own words as queries, all at once: the matrix rows of a prefix serve
every word that has it, by the common prefixes of neighbours in the list, and ranges whose prefix is already more than
one edit away are left out.  A list that is too long is split again by halves of what its words do not share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgraph.session import cut_lineage

from .common import LOWER, UPPER, slices

#: Code points of a word, and its occurrences, at least.
LEAST_POINTS, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as the word.
RATIO = 10
#: Runs whose sum this number divides lose a code point.
DROPPED = 31
#: Words of a list that is scanned; longer lists are split.
MOST = 1 << 15
#: Words, and cells of the matrix of code points, scanned at once.
_ROWS, _CELLS = 1 << 16, 1 << 23
#: Counts that a task holds before it hands them on.
_HELD = 1 << 18

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_POINTS)
_FOLD = str.maketrans(UPPER, LOWER)


def runs(doc_id: int | None, text: str | None) -> Counter:
    """Counts of the words of a text that are long enough; a null id counts as the empty string."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall((text or "").translate(_FOLD))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROPPED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_POINTS:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` (occurrences) of the words of all texts that occur often enough."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for doc_id, value in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    held.update(runs(doc_id, value))
                if len(held) > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def halves(lists: DataFrame) -> DataFrame:
    """Lists split in two: words of a list that share the next half of the rest, and those that share the last.

    A list of class ``points`` holds words of that length and one more, which share ``head`` first and ``tail`` last
    code points.  Only pairs whose common prefix is shorter than ``before`` are its own; so every pair has one list.
    """
    half = F.expr("int((points - head - tail) div 2)")
    cut = lists.select("word", "n", "points", F.explode(F.array(
        F.struct((F.col("head") + half).alias("head"), "tail", "before"),
        F.struct("head", (F.col("tail") + half).alias("tail"), F.least("before", F.col("head") + half).alias("before")))).alias("cut"))
    return cut.select("word", "n", "points", "cut.*").withColumn(
        "list", F.xxhash64("points", "head", "tail", "before", F.expr("substr(word, 1, head)"), F.expr("right(word, tail)")))


def _matrix(parts: list[str], width: int) -> np.ndarray:
    """Code points of words, a row a word; zeros behind its end."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(parts), width), np.uint32)
    rows = np.repeat(np.arange(len(parts)), sizes)
    out[rows, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = codes
    return out


def scan(lists: np.ndarray, parts: list[str], points: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one list that are one edit apart, where i has ``points`` code points and j as many or one more.

    Rows come sorted by list and part.  Rows of pairs of equal length come once, the smaller first.  The matrix of a
    query and a prefix of d code points has two cells in the band, for d and d - 1 code points of the query.
    """
    m = _matrix(parts, points + 2)
    count = len(parts)
    sizes = (m != 0).sum(1)
    first = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    lcp = np.empty(count, np.int64)  # with the row before, -1 at the start of a list
    lcp[0], lcp[1:] = -1, (m[1:] != m[:-1]).argmax(1)
    lcp[first] = -1
    which = np.searchsorted(first, np.arange(count), "right") - 1
    ends = np.r_[first[1:], count]
    query = np.flatnonzero((sizes == points) & (ends[which] - first[which] > 1))
    low, high = first[which[query]], ends[which[query]]
    same, behind = np.zeros(len(query), np.int8), np.full(len(query), 2, np.int8)
    left, right = [], []
    for d in range(points + 2):
        if not len(query):
            break
        starts = np.flatnonzero(lcp <= d)
        a, b = np.searchsorted(starts, low), np.searchsorted(starts, high)
        state = np.repeat(np.arange(len(query)), b - a)
        child = np.arange(len(state)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[state]
        begin = starts[child]
        end = np.minimum(np.r_[starts[1:], count][child], high[state])
        q, e0, e1 = query[state], same[state], behind[state]
        c = m[begin, d]
        over = c == 0
        if over.any():  # a word ends here; its distance is in the cell of the whole query
            hit = over & (np.where(d == points, e0, np.where(d == points + 1, e1, 2)) == 1) & ((d > points) | (begin > q))
            left.append(q[hit])
            right.append(begin[hit])
        now = np.minimum(e0 + (c != m[q, d]), 2).astype(np.int8) if d < points else np.full(len(q), 2, np.int8)
        late = np.minimum(e1 + (c != m[q, d - 1]), 2).astype(np.int8) if 0 < d <= points else np.full(len(q), 2, np.int8)
        late = np.minimum(late, e0 + 1).astype(np.int8)
        live = ~over & (np.minimum(now, late) < 2)
        query, low, high, same, behind = q[live], begin[live], end[live], now[live], late[live]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _near(batch: dict) -> pa.RecordBatch | None:
    """Per word of some lists of one class and cut: how many near words, and the count and word of the best."""
    points, head, tail = batch["points"][0], batch["head"][0], batch["tail"][0]
    words, n = batch["word"], np.array(batch["n"], np.int64)
    i, j = scan(np.array(batch["list"], np.int64), batch["free"], points - head - tail)
    if len(i):
        m = _matrix(words, points + 2)  # of whole words: after an insertion a common prefix may reach into the tail
        keep = np.concatenate([(m[i[s:s + 8192]] != m[j[s:s + 8192]]).argmax(1) for s in range(0, len(i), 8192)]) < np.array(batch["before"])[i]
        i, j = i[keep], j[keep]
    if not len(i):
        return None
    i, j = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[x] for x in i[at]], pa.string()), "n_near": pa.array(np.diff(np.r_[at, len(i)]), pa.int64()),
        "best_n": pa.array(n[j[at]], pa.int64()), "best": pa.array([words[x] for x in j[at]], pa.string())})


def _scan_lists(batches):
    """Whole lists together, as many of one class and cut as the bounds allow."""
    held: dict[str, list] = {}

    def flush():
        out = _near(held)
        held.clear()
        return out

    for batch in batches:
        rows = batch.to_pydict()
        names, size = list(rows), batch.num_rows
        kind = list(zip(rows["points"], rows["head"], rows["tail"]))
        start = 0
        for at in range(1, size + 1):
            if at < size and rows["list"][at] == rows["list"][at - 1] and kind[at] == kind[at - 1]:
                continue
            if held:  # the list goes on, or another of the kind follows
                last = (held["points"][-1], held["head"][-1], held["tail"][-1])
                full = len(held["word"]) > min(_ROWS, _CELLS // (last[0] + 2))
                if last != kind[start] or full and held["list"][-1] != rows["list"][start]:
                    out = flush()
                    if out is not None:
                        yield out
            for name in names:
                held.setdefault(name, []).extend(rows[name][start:at])
            start = at
    if held:
        out = flush()
        if out is not None:
            yield out


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``minus``, ``word``: the near word of largest n, then smallest) of words with near words.

    ``words`` has distinct ``word`` and ``n``.  A list of over ``most`` words is split until it is short or its words
    share all but one code point, so no list grows with the vocabulary and no pair is lost.
    """
    points = F.length("word")
    lists = words.select("word", "n", F.explode(F.array(points, points - 1)).alias("points")).withColumns({
        "head": F.lit(0), "tail": F.lit(0), "before": F.lit(2**31 - 1)})
    lists, ready = halves(lists.filter("points > 1")), None
    while True:
        long = cut_lineage(lists.filter("points - head - tail > 1").groupBy("list").agg(F.count("*").alias("size")).filter(F.col("size") > most).select("list"))
        if long.isEmpty():
            break
        short = lists.join(long, "list", "left_anti")
        ready = short if ready is None else ready.unionByName(short)
        lists = cut_lineage(halves(lists.join(long, "list", "left_semi")))
    lists = lists if ready is None else lists.unionByName(ready)
    lists = lists.withColumn("free", F.expr("substr(word, head + 1, length(word) - head - tail)"))
    dealt = lists.repartition("list").sortWithinPartitions("points", "head", "tail", "list", "free")
    found = dealt.mapInArrow(_scan_lists, "word string, n_near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of ``forms`` (``word``, ``form``): the last word that forms lead to.

    A form occurs at least ``RATIO`` times as often, so chains are short; each round doubles what a word has followed.
    """
    found = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = cut_lineage(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not found.filter("moved").isEmpty()
        found = found.drop("moved")
        if not moved:
            return found


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of the texts.

    Two words are near if one inserted, deleted or replaced code point makes one the other.  The form of a word is its
    near word of largest n, ties to the smallest in code-point order, if that n is ``ratio`` times the word's at least.
    A null text has no words, a null key is the empty string, repeated rows count again, and texts and words of any
    length are taken whole.  An empty table has no words.  Other columns do not pass and may have any names.
    """
    words = cut_lineage(vocabulary(docs, key, text))
    best_n = -F.col("best.minus")
    formed = words.join(near_words(words, most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best_n >= ratio * F.col("n"), F.struct(F.col("best.word").alias("form"), best_n.alias("form_n"))).alias("f"))
    formed = cut_lineage(formed.select("word", "n", "n_near", "f.form", "f.form_n"))
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
