import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from newsgraph.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every node of the rebuilt conversations by loops over prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(who) - 1) * words
    return sorted((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), kids.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(who) if len(made[c]) == len(k)).encode()).hexdigest()) for k, who in members.items())


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("band", [1, 3, 32])
def test_equals_loops(spark, band):
    rng = random.Random(band)
    rows = []
    for c in [*range(45), 100, 121, 122, 999]:
        for turn in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["one two", " a\tb  c", "", None])))
    rows += [(7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (None, 0, "user", "nobody")]
    rows += [(c, t, "user", f"t{t} word" if t < 30 or c == 40 else f"own {c}") for c in (40, 41, 47) for t in range(9, 40)]
    rows += [(3, 50, "user", "very long é " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a", F.lit("x")).withColumn("depth", F.lit(1)).withColumn("place", F.lit(None))
    assert found(trie.trie(df, band=band)) == plain(rows)


def test_one_conversation_of_most_rows(spark):
    rows = [(20, t, "user", f"t {t % 7}") for t in range(700)] + [(21, t, "user", f"t {t % 7}") for t in range(650)] + [(30 + c, 0, "user", "x") for c in range(9)]
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA), band=8)) == plain(rows)


def test_many_members_of_one_node(spark):
    rows = [(c, t, "user", "same words") for c in range(0, 60_000, 20) for t in range(1 + c % 3)]
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_positions_of_a_key_over_many_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    got = trie.positions(rows.repartition(7), ["k"], [F.col("v").desc()], "n")
    assert got.filter("k = 1 and n <> 4000 - v").count() == 0 and got.filter("k > 1 and n <> 1").count() == 0 and got.count() == 5000


def test_empty_and_turnless(spark):
    assert found(trie.trie(spark.createDataFrame([], SCHEMA))) == []
    # conversations with an absent base and fewer own turns than they share stay members of the root alone
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    got = found(trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    alone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1][:1]
    rows = [(c, 0, "user", "x") for c in alone]
    assert found(trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows) != []
