"""Base scores against plain counts; the filter against true counts."""

import math
import random
from collections import Counter

import numpy as np

from newsgraph.llm import lm


def plain(learn, texts):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for t in texts]


def corpus(seed, count):
    draw = random.Random(seed)
    words = [f"{'ABcdÉñ'[i % 6]}{i}" for i in range(300)]
    return [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(300)], k=draw.randrange(0, 60))) + "\n" * (k % 3) for k, _ in enumerate(range(count))]


def test_words_of_long_and_odd_texts():
    long = b"w1 " * 400_000 + b"z" * 1_200_000 + b"\t\x0bend"
    for data in (b"", b"  ", b"a", b" a\tbb\n", "é ß x".encode(), long):
        starts, ends, hashes = lm.words(data)
        assert [data[s:e] for s, e in zip(starts, ends)] == data.split()
        by = {}
        for w, h in zip(data.split(), hashes.tolist()):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_base_scores(spark, make_docs):
    texts = corpus(1, 80) + [None, "", " \t", "B7 b7 unseen unseen", "w " * 30_000]
    learn = corpus(1, 80)[:60] + [None]
    docs = make_docs([*enumerate(texts), (None, "b7"), (None, "b7"), (0, "other text of key zero"), (5, texts[5])], clash=["score", "n_tokens", "word", "c"])
    every = texts + ["b7", "b7", "other text of key zero", texts[5]]
    keys = [*range(len(texts)), None, None, 0, 5]
    for head in (1 << 20, 50, 1):
        rows = lm.score(docs, make_docs(list(enumerate(learn))), ["doc_id"], head=head, bits=1 << 16).collect()
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)
        want = sorted(((k, a, b, n, round(s, 6)) for k, (a, b, n, s) in zip(keys, plain(learn, every))), key=str)
        assert got == want
        assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_filter_counts(spark, make_docs):
    texts = corpus(2, 300)
    model = lm.build(make_docs(list(enumerate(texts))), sum(len(t.split()) + 1 for t in texts), bits=1 << 20)
    _, _, _, hashes, owner = lm.tokens([t.encode() for t in texts])
    one, two, _, _ = lm.grams(hashes, owner, len(texts))
    true = Counter(one.tolist() + two.tolist())
    keys = np.array(list(true), np.uint64)
    level, found = lm.levels(np.array(list(true.values()))), model.counts(keys)
    assert (found > 0).all()  # a filter never forgets
    assert (lm.levels(np.maximum(found, 1)) == level).mean() > 0.9
    absent = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert (model.counts(absent) > 0).mean() < 0.1


def test_no_learned_gram_is_dropped_from_a_small_filter(spark, make_docs):
    texts = corpus(3, 300)
    model = lm.build(make_docs(list(enumerate(texts))), sum(len(t.split()) + 1 for t in texts), bits=1 << 12)
    _, _, _, hashes, owner = lm.tokens([t.encode() for t in texts])
    one, two, _, _ = lm.grams(hashes, owner, len(texts))
    keys = np.unique(np.concatenate((one, two)))
    assert 8 * len(model.bits) > 1 << 12 and (model.counts(keys) > 0).all()


def test_a_filter_too_large_to_broadcast_gives_the_same_scores(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lm, "_SLICE", 2000)
    texts = corpus(4, 120) + [None, "", "unseen words", corpus(4, 1)[0]]
    docs = make_docs([*enumerate(texts), (None, "b7"), (None, "b7"), (5, texts[5])]).repartition(3)
    learn = make_docs(list(enumerate(corpus(4, 80))))
    for bits in (1 << 22, 1 << 8, 1 << 14):  # far above need, and as full as a filter may be
        got = [sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found.collect()), key=str) for found in (
            lm.score(docs, learn, ["doc_id"], bits=bits), lm.score(docs, learn, ["doc_id"], bits=bits, most=0))]
        assert len(got[0]) == len(texts) + 3 and got[0] == got[1]
    got = [sorted(((r.doc_id, 0) for r in lm.score(docs, learn, ["doc_id"], bits=1 << 12).collect()), key=str)]
    made, groups, size, mean = lm.segments(learn, 5000, bits=1 << 22)
    source = docs.selectExpr("doc_id as k", "text as t")
    parts = [sorted(((r.k, r.digest, round(r.score, 6)) for r in lm.joined_scores(source, made, groups, size, mean, 80, 4000, 0.6, part=p).collect()), key=str) for p in (1, 150, 1 << 30)]
    assert len(parts[0]) == len(got[0]) and parts[0] == parts[1] == parts[2]


def test_model_beats_the_base_on_text_like_the_learned(spark, make_docs):
    phrase = "alpha beta gamma delta epsilon zeta eta theta"
    rows = make_docs([(i, phrase) for i in range(50)] + [(99, phrase), (100, " ".join(reversed(phrase.split())))])
    got = {r.doc_id: r for r in lm.score(rows, rows.filter("doc_id < 50"), ["doc_id"], bits=1 << 16).collect()}
    assert got[99].score > got[99].base_score and got[99].score > got[100].score


def test_empty(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    got = lm.score(docs, docs.limit(0), ["doc_id"], bits=1 << 12).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm.score(docs.limit(0), docs, ["doc_id"], bits=1 << 12).count() == 0
