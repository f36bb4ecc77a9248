"""Benchmark decontamination: windows of test words in a broadcast hash set, scanned over token windows of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD_BYTES, as_bytes, map_texts

#: Words of a window.
WINDOW = 10
#: Benchmark windows broadcast at once; a longer benchmark is scanned in several passes.
MOST_WINDOWS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = b"\0"


class Windows:
    """Hash set of one block of benchmark windows.  Words are numbered from 1; 0 is a word of no window."""

    def __init__(self, size: int):
        self.size, self.items, self.count = size, [], 0
        self.vocabulary: dict[bytes, int] = {_BREAK: -1}
        self.by_length: dict[int, dict[bytes, list[int]]] = {}

    def add(self, item: str | None, text: str) -> None:
        words = text.encode().translate(WORD_BYTES).split()
        if not words:
            return
        ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
        length, number = min(len(ids), self.size), len(self.items)
        self.items.append(item)
        found = self.by_length.setdefault(length, {})
        for i in range(len(ids) - length + 1):
            holders = found.setdefault(ids[i : i + length].tobytes(), [])
            if not holders or holders[-1] != number:
                holders.append(number)
        self.count += len(ids) - length + 1

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Start, length and items of every occurrence of a window.  A window of known words only is looked up."""
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for length, found in self.by_length.items():
            starts = np.flatnonzero(known[length:] - known[:-length] == length) if len(ids) >= length else []
            for i in starts:
                if holders := found.get(ids[i : i + length].tobytes()):
                    yield int(i), length, holders


def blocks(benchmark: DataFrame, item: str, text: str, size: int, most: int) -> Iterator[Windows]:
    """Blocks of about ``most`` windows, one at a time on the driver.  Items without a text are left out."""
    block = Windows(size)
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).filter(F.col(text).isNotNull()).toLocalIterator():
        block.add(row[0], row[1])
        if block.count >= most:
            yield block
            block = Windows(size)
    if block.count:
        yield block


def scan(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, most: int = MOST_WINDOWS,
) -> DataFrame:
    """Columns ``keep`` with the benchmark words in each whole document.

    Words are runs of letters and digits, A-Z in lower case.  A window is ``size`` consecutive words of an item, or all
    words of a shorter one; a document's word inside an occurrence of a window is hit.  Adds ``n_words``, ``n_hit``,
    ``items`` (ids of the items with occurring windows, as sorted strings) and ``spans`` (first and one past the last
    number of each run of hit words).  The windows are broadcast in blocks of ``most``, one scan a block, so that a
    benchmark of any size is met whole.  A null or empty text has no words; an empty benchmark hits nothing; repeated
    items count once by id, and the words of an item without an id are hit while it counts as no item.  Own columns replace kept ones of the same names.
    """
    context = docs.sparkSession.sparkContext
    out = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first: int, last: int>>"
    keep = [c for c in keep if c not in ("n_words", "n_hit", "items", "spans")]
    rows, first = docs, True
    found = list(map(context.broadcast, blocks(benchmark, item_id, item_text, size, most))) or [context.broadcast(Windows(size))]
    for number, block in enumerate(found):
        last = number == len(found) - 1

        def make(block=block):
            windows: Windows = block.value
            get = windows.vocabulary.get

            def kernel(texts: pa.Array, items=None, spans=None) -> list[pa.Array]:
                data = [(x or b"").translate(WORD_BYTES) for x in as_bytes(texts)]
                words = (b" \0 ".join(data) + b" \0").split()
                ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
                ends = np.flatnonzero(ids == -1)
                starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
                edges = np.zeros(len(ids) + 1, np.int32)
                holders = [set(x) for x in items.to_pylist()] if items is not None else [set() for _ in data]
                for k, old in enumerate(spans.to_pylist() if spans is not None else []):
                    for s in old:
                        edges[starts[k] + s["first"]] += 1
                        edges[starts[k] + s["last"]] -= 1
                for i, length, who in windows.scan(ids):
                    edges[i] += 1
                    edges[i + length] -= 1
                    holders[np.searchsorted(ends, i)].update(windows.items[w] for w in who if windows.items[w] is not None)
                hit = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                firsts, lasts = turns[::2], turns[1::2]
                owner = np.searchsorted(ends, firsts)
                runs = [[] for _ in data]
                for f, t, k in zip(firsts, lasts, owner):
                    runs[k].append({"first": int(f - starts[k]), "last": int(t - starts[k])})
                total = np.concatenate(([0], np.cumsum(hit)))
                return [
                    pa.array(ends - starts, pa.int64()), pa.array(total[ends] - total[starts], pa.int64()),
                    pa.array([sorted(h) for h in holders], pa.list_(pa.string())),
                    pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ]

            return kernel

        passed = keep if last or text in keep else [*keep, text]
        rows = map_texts(rows, make, out, passed, text, also=[] if first else ["items", "spans"])
        first = False
    return rows


def cut_spans(text: str | None, spans: list[dict]) -> str | None:
    """A text without the words of ``spans`` and what stands between them; the rest is joined by one space."""
    if text is None or not spans:
        return text
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    parts, at = [], 0
    for span in spans:
        parts.append(data[at : places[span["first"]][0]].strip())
        at = places[span["last"] - 1][1]
    return b" ".join(p for p in [*parts, data[at:].strip()] if p).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without benchmark passages: ``documents`` drops each document that holds one, ``spans`` cuts the passages.

    All columns of ``docs`` stay as they are but for the texts cut.  Clean documents are left alone.  ``options`` as in
    :func:`scan`.
    """
    marks = {c: f"__doc_{c}" for c in docs.columns if c in ("n_words", "n_hit", "items", "spans")}
    rows = docs.withColumnsRenamed(marks)
    names = rows.columns
    if action == "documents":
        kept = scan(rows, benchmark, names, text, **options).filter("n_hit = 0").select(*names)
    elif action == "spans":
        marked = scan(rows, benchmark, names, text, **options)

        def make():
            def kernel(texts, spans):
                return [pa.array([cut_spans(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())]

            return kernel

        clean, hit = marked.filter("n_hit = 0").select(*names), marked.filter("n_hit > 0")
        kept = clean.unionByName(map_texts(hit, make, f"`{text}` string", names, text, also=["spans"]).select(*names))
    else:
        raise ValueError("action is 'documents' or 'spans'")
    return kept.withColumnsRenamed({v: k for k, v in marks.items()})
