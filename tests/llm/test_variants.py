import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from newsgraph.llm import variants


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, ratio=variants.RATIO):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def texts(rng, letters, count):
    words = {"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(count)}
    for w in list(words):  # variants in chains
        for _ in range(2):
            at = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at + 1:]]))
    out = [w for w in sorted(words) for _ in range(rng.choice([1, 2, 3, 25, 300]))]
    rng.shuffle(out)
    return [(i, rng.choice([" ", "-1", "\n"]).join(out[i::40])) for i in range(40)]


@pytest.mark.parametrize("letters, most", [("ab", 3), ("abÀé", 8), ("abcdefgh", 1 << 15), ("ab", 1 << 15)])
def test_equals_all_pairs(spark, letters, most):
    rows = texts(random.Random(most), letters, 150)
    rows += [(None, "Variant variant variant"), (5, None), (5, ""), (5, rows[5][1]), (1, rows[1][1]), (77, ("x" * 30_000 + " ") * 3 + ("x" * 30_001 + " ") * 2), (78, "short Äpfeläpfel äpfeläpfel " * 3)]
    rows += [(90, "chainab " * 3 + "chainabc " * 40 + "chainabcd " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "id": F.lit(2)})
    got, want = found(variants.group(df, most=most)), plain(rows)
    assert got == want and sum(v[3] for v in want.values()) > 100 and any(v[0] != v[1] for v in want.values() if v[0])


def test_one_list_of_most_words(spark):
    rng = random.Random(5)
    words = sorted({"shared" + "".join(rng.choices("abcd", k=rng.randint(3, 5))) for _ in range(400)})
    rows = [(i, " ".join(words)) for i in range(2)]
    assert found(variants.group(spark.createDataFrame(rows, "doc_id long, text string"), most=16)) == plain(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(none).count() == 0
    assert variants.group(spark.createDataFrame([(1, "no word is long"), (2, None)], none.schema)).count() == 0
