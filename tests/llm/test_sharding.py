"""Placement against a plain construction of the table."""

import hashlib
from collections import Counter

import pytest

from newsgraph.llm import sharding


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain(names, size):
    names, owner = sorted(names), [None] * size
    orders = []
    for n in names:
        start, inverse = number(f"offset:{n}") % size, number(f"skip:{n}") % (size - 1) + 1
        orders.append(sorted(range(size), key=lambda s: (s - start) * inverse % size))
    at, turn = [0] * len(names), 0
    while None in owner:
        k = turn % len(names)
        while owner[orders[k][at[k]]] is not None:
            at[k] += 1
        owner[orders[k][at[k]]] = names[k]
        turn += 1
    return owner


def table(spark, names, size=101):
    rows = sharding.placement_table(spark, names, size).collect()
    assert sorted(r.slot for r in rows) == list(range(size))
    return {r.slot: r.shard for r in rows}


def test_table_equals_the_turns_and_is_even(spark):
    names = ["b", "a", "it's \\ odd", "d", "e"]
    got = table(spark, names)
    assert [got[s] for s in range(101)] == plain(names, 101)
    held = Counter(got.values())
    assert max(held.values()) - min(held.values()) <= 1


def test_a_lost_shard_moves_few_other_slots(spark):
    names = [f"s{i}" for i in range(8)]
    before, after = table(spark, names, 1009), table(spark, names[:-1], 1009)
    moved = sum(before[s] != after[s] for s in before if before[s] != "s7")
    assert moved < 0.2 * 1009


def test_refusals(spark):
    for names, size in (([], 101), (["a", "a"], 101), (["a"], 100), (["a", "b", "c"], 2), ([None], 101)):
        with pytest.raises(ValueError):
            sharding.placement_table(spark, names, size)


def test_place(spark, make_docs):
    lookup = sharding.placement_table(spark, ["a", "b", "c"], 101)
    docs = make_docs([(1, "x"), (1, "y"), (None, "z"), (None, None), (2, "")], clash=["slot", "shard"])
    rows = sharding.place(docs, "doc_id", lookup, 101).collect()
    assert len(rows) == 5 and {"text", "source", "slot", "shard"} <= set(rows[0].asDict())
    owner = plain(["a", "b", "c"], 101)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == number(key) % 101 and r.shard == owner[r.slot]
    assert sharding.place(docs.limit(0), "doc_id", lookup, 101).count() == 0
