import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.llm import suffixes

SCHEMA = "doc_id long, text string"


def plain(rows, length=suffixes.LENGTH):
    """Bytes left and removed runs of each row by a dictionary of all passages."""
    texts = [(key, (text or "").encode()) for key, text in rows]
    first = {}
    for key, x in texts:
        if key is not None:
            for i in range(len(x) - length + 1):
                s = x[i:i + length]
                first[s] = min(first.get(s, key), key)
    out = []
    for key, x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            low = first.get(x[i:i + length])
            if low is not None and (key is None or low < key):
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        runs = [i for i in range(len(x)) if gone[i] and (not i or not gone[i - 1])]
        out.append((key, len(x), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **how):
    made = suffixes.deduplicate(df, ["doc_id"], **how).collect()
    for r in made:
        assert sum(r.ends) - sum(r.starts) == r.n_removed and all(a < b for a, b in zip(r.starts, r.ends)) and all(b < a for b, a in zip(r.ends, r.starts[1:]))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in made), key=str)


def documents(seed, alphabet, count=60):
    rng = random.Random(seed)
    shared = ["".join(rng.choices(alphabet, k=rng.choice([49, 50, 51, 80, 700]))) for _ in range(8)]
    rows = []
    for i in range(count):
        parts = ["".join(rng.choices(alphabet, k=rng.randint(0, 90))) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(5), rng.choice(shared))
        rows.append((i, "".join(parts)))
    rows += [(100 + i, "".join(rows[7][1])) for i in range(20)]  # exact copies
    rows += [(200, "x" * 4000), (201, "x" * 2000 + "y" + "x" * 49), (5, rows[9][1]), (5, rows[9][1]), (9, rows[3][1] * 2), (300, None), (301, ""), (302, " "),
             (None, rows[9][1]), (None, "only here " * 9), (None, "only here " * 9), (400, "only here " * 9), (303, "é" * 60), (304, "€" + "é" * 40 + "e")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("alphabet, how", [
    ("ab", {}), ("abcdefgh é", {"slice_bytes": 700, "bucket_bytes": 900}), ("abc", {"slice_bytes": 3000, "block": 200}), ("ab ", {"slice_bytes": 1, "bucket_bytes": 5000, "length": 64})])
def test_equals_all_passages(spark, alphabet, how):
    rows = documents(len(alphabet), alphabet)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("uid", "kept", "size", "batch", "lists")}).repartition(5)
    got = found(df, **how)
    assert got == plain(rows, how.get("length", suffixes.LENGTH)) and sum(r[2] for r in got) > 5000


def test_long_text_and_small_chunks(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnop ", k=150_000))
    rows = [(1, text), (2, text[:100] + "Z" + text[40_000:70_000] + text[:49]), (3, "no " * 10)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    data, sizes = np.frombuffer(("".join(r[1] for r in rows)).encode(), np.uint8), np.array([len(r[1]) for r in rows])
    whole = suffixes.Anchors()
    starts = [np.concatenate([np.arange(b, b + n) for b, n in zip(*x[:2])]) for x in [whole.pieces(data, sizes)]]
    low = whole.smallest(data[:100_000])
    monkeypatch.setattr(suffixes, "_CHUNK", 1000)
    small = suffixes.Anchors().pieces(data, sizes)
    assert np.array_equal(np.sort(np.concatenate([np.arange(b, b + n) for b, n in zip(*small[:2])])), starts[0])
    for b, n, h in zip(*small):
        if b + n < len(low):
            assert (low[b:b + n] == h).all()


def test_cover_sorts_as_suffixes():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))
    rng = random.Random(2)
    raw = bytes(rng.choices(b"ab", k=40)) * 30 + bytes(rng.choices(b"ab", k=2000)) + b"a" * 300
    text = np.frombuffer(raw + bytes(128), np.uint8)
    at = np.array(rng.sample(range(len(raw) - 50), 1500))
    order, apart = suffixes.Cover(text, len(raw), 50).sort(at)
    passages = [raw[i:i + 50] for i in at[order]]
    assert passages == sorted(passages)
    assert apart.tolist() == [i == 0 or passages[i] != passages[i - 1] for i in range(len(at))]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(none) == []
    rows = [(1, None), (2, ""), (3, "short")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_anchors_of_many_slices_meet_in_one_sort():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 60, 20, dtype=np.uint64)) for _ in range(5)]
    count = {int(v): sum(v in x for x in lists) for x in lists for v in x}
    assert [x.tolist() for x in suffixes.in_two(lists)] == [[v for v in x.tolist() if count[v] > 1] for x in lists]
    many = [rng.integers(0, 1 << 18, 400, dtype=np.uint64) for _ in range(1250)]  # as of 10 GB of text
    start = time.process_time()
    suffixes.in_two(many)
    assert time.process_time() - start < 2  # a search of all shared ones for every list: 48 s
