"""Noisy-or model on a small language with insults."""

import random

import numpy as np
from pyspark.sql import functions as F

from newsgraph.llm import toxicity

INSULTS = ["zorgly", "blurk", "quontop"]


def corpus(seed, count):
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba de ki lo mu ta ro si".split() for b in "na te vi so lu".split()]
    rows = []
    for k in range(count):
        sentences = [" ".join(draw.choices(vocabulary, k=draw.randrange(3, 12))) for _ in range(draw.randrange(1, 9))]
        toxic = k % 5 == 0
        if toxic:
            i = draw.randrange(len(sentences))
            sentences[i] = f"{sentences[i]} {draw.choice(INSULTS).upper() if k % 2 else draw.choice(INSULTS)} you"
        rows.append((k, ". ".join(sentences) + "!", int(toxic)))
    return rows


def test_model_and_sentences(spark, make_docs):
    train, test = corpus(1, 400), corpus(2, 200)
    docs = make_docs([(k, t) for k, t, _ in train])
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in train] + [(None, 1, 1), (7, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    odd = [(1000, None), (1001, ""), (1002, " ... !!! \n"), (1003, "bana " * 20_000 + ". you ZORGLY blurk. tena"), (1003, "same key")]
    rows = toxicity.score(make_docs([(k, t) for k, t, _ in test] + odd, clash=["score", "offending", "n_sentences"]), model, ["doc_id", "text", "score"]).collect()
    by = {(r.doc_id, r.text): r for r in rows}
    right = sum((by[k, t].score >= 0.3) == bool(y) for k, t, y in test)
    assert right >= 0.97 * len(test) and len(rows) == len(test) + len(odd)
    for k, t, y in test:
        for s in by[k, t].offending if y else []:
            piece = t.encode()[s["start"] : s["stop"]].decode().lower()
            assert any(i in piece for i in INSULTS)
    assert all(by[k, t].score == 0.0 and by[k, t].n_sentences == 0 for k, t in odd[:3])
    long = by[odd[3]]
    assert long.score > 0.5 and [odd[3][1].encode()[s["start"] : s["stop"]].decode() for s in long.offending] == [" you ZORGLY blurk"]
    assert all(0 <= r.score <= 1 for r in rows)


def test_noisy_or_of_sentences():
    model = toxicity.Model(np.zeros(toxicity.FEATURES), -2.0)
    p = 1 / (1 + np.exp(2.0))
    marks = np.array([0, 1, 1, 0, 0, 1, 2, 2, 0, 2])
    sentence, text = toxicity.sentences(marks)
    assert sentence.tolist() == [0, 1, 1, 2] and text.tolist() == [0, 0, 2]
    clean = np.bincount(text, weights=np.logaddexp(0, np.full(3, model.bias)), minlength=3)
    assert np.allclose(-np.expm1(-clean), [1 - (1 - p) ** 2, 0, p])


def test_nothing_to_learn_from(spark, make_docs):
    docs, none = make_docs([(1, "a text"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, none, toxicity.trainable()) is None
    assert toxicity.learn(docs, spark.createDataFrame([(1, 1, 1)], none.schema), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None, ["doc_id"]).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    got = {r.doc_id for r in spark.range(200).withColumnRenamed("id", "doc_id").filter(toxicity.trainable()).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_scores_are_those_of_the_model_word_by_word(spark, make_docs):
    draw = random.Random(9)
    words = ["aaaabbbbx", "aaaabbyyy", "zorgly", "blurk", "bana", "teso", "zorglies"]
    weights = np.abs(np.random.default_rng(4).normal(0.4, 0.3, toxicity.FEATURES))
    model = toxicity.Model(weights, -3.0)
    sums = toxicity._Sums(weights.tolist())
    rows = [(i, ". ".join(" ".join(draw.choices(words, k=draw.randrange(1, 6))) for _ in range(draw.randrange(1, 5)))) for i in range(40)] + [(90, "aaaabbbbx aaaabbyyy aaaabbbbx")]
    got = {r.doc_id: r.score for r in toxicity.score(make_docs(rows), model, ["doc_id"]).collect()}
    for k, text in rows:
        clean = 1.0
        for sentence in text.split(". "):
            clean *= 1 - 1 / (1 + np.exp(-(-3.0 + sum(sums[w.encode()] for w in set(sentence.split())))))
        assert abs(got[k] - (1 - clean)) < 1e-9
