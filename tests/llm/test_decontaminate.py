"""Scans against a plain search; cutting and dropping."""

import random
import re

from newsgraph.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OWN = ["n_words", "n_hit", "items", "spans"]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, size=10):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            v = words(passage)
            if not v:
                continue
            n = min(size, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.update([str(item)] if item is not None else [])
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def fixture():
    draw = random.Random(3)
    vocabulary = ["the", "of", "Straße", "élan", "x1", "2024", "and", "word", "test", "naïve"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, ""), (51, None), (None, "the of the of"), (None, "nobody knows whose test this is"), (52, "... !!"), (3, "another text of item three is long enough to count here"), (2**40, "Unique!")]
    docs = []
    for k in range(40):
        text = " ".join(draw.choices(vocabulary, k=draw.randrange(0, 60)))
        if k % 3 == 0:
            text += ", " + items[k % 12][1].upper() + "! " + " ".join(draw.choices(vocabulary, k=8))
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "\0\0 , "), (103, "unique"), (103, "unique"), (105, "(nobody knows, whose test this is)"), (None, "so unique\x00it is"), (104, "the " * 30_000 + items[9][1])]
    return docs, items


def test_scan_equals_a_plain_search(spark, make_docs):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs(docs, clash=OWN)
    for most in (1_000_000, 7):
        rows = decontaminate.scan(df, bench, ["doc_id", "n_hit"], most=most).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str) == plain(docs, items)
        assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_hit for r in rows)
    other = decontaminate.scan(df, bench, ["doc_id"], size=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in other), key=str) == plain(docs, items, 4)


def test_actions(spark, make_docs):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = make_docs([(1, "Clean text, left as it is.\n"), (2, f"Before; ONE-two THREE four five six seven eight, nine (ten)! Then after."), (3, passage), (4, None), (5, "")], clash=OWN)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: "Clean text, left as it is.\n", 2: "Before; )! Then after.", 3: "", 4: None, 5: ""}
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench, "spans").collect()} == {"old"}


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b c"), (2, None)])
    assert [(r.n_words, r.n_hit) for r in decontaminate.scan(docs, bench, ["doc_id"]).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    assert decontaminate.scan(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == 2
