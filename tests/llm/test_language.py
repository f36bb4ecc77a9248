"""Forward-backward against enumeration; languages of small texts."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from newsgraph.llm import language

EN = "the cat sat on the mat and then with another thing that was there for the whole time".split()
DE = "der hund schläft auf der straße und dann mit einem anderen ding das dort die ganze zeit war".split()


def test_posteriors_equal_enumeration():
    draw = np.random.default_rng(0)
    sizes = np.array([3, 1, 0, 5])
    starts = np.cumsum(sizes) - sizes
    scores, moves = draw.normal(size=(9, 3)) * 3, draw.normal(size=(3, 3))
    got = language.posteriors(scores, starts, sizes, moves)
    for a, n in zip(starts, sizes):
        want, total = np.zeros((n, 3)), 0.0
        for path in product(range(3), repeat=int(n)) if n else []:
            w = np.exp(sum(scores[a + i, c] for i, c in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            total += w
            for i, c in enumerate(path):
                want[i, c] += w
        if n:
            assert np.allclose(got[a : a + n], want / total)


def texts(words, seed, count):
    draw = np.random.default_rng(seed)
    return [" ".join(draw.choice(words, size=draw.integers(5, 40))) for _ in range(count)]


def test_field(spark, make_docs):
    rows = [(i, t, "en") for i, t in enumerate(texts(EN, 1, 60))] + [(100 + i, t, "de") for i, t in enumerate(texts(DE, 2, 60))]
    rows += [(300, "no language", None), (301, None, "en"), (302, "", "de")]
    field = language.learn(make_docs(rows), F.lit(True))
    assert field.languages == ["de", "en"] and field.moves[0, 0] > field.moves[0, 1]
    mixed = " ".join(EN[:9] + DE[:9])
    p = language.posteriors(language.emissions(language.words_of(mixed.encode()), field.weights), np.array([0]), np.array([18]), field.moves)
    assert (p[:8, 1] > 0.5).all() and (p[10:, 0] > 0.5).all()
    odd = [(1, None), (2, ""), (3, "12 345 _ !"), (4, "²½ 12"), (5, "THE CAT"), (6, "Straße " * 30_000), (6, "the"), (None, "der Hund"), (7, "日本")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(make_docs(odd, clash=["score", "lang_pred"]), field, ["doc_id", "score"]).collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "und", "en", "de", "en", "de", got[-1][1]] and got[-1][1] in ("de", "en")
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == 0.0
    test = texts(EN, 5, 30) + texts(DE, 6, 30)
    found = language.predict(make_docs(list(enumerate(test))), field, ["doc_id"]).collect()
    assert sum((r.lang_pred == "en") == (r.doc_id < 30) for r in found) >= 58


def test_nothing_to_learn_from(spark, make_docs):
    docs = make_docs([(1, "a text"), (2, None)])
    assert language.learn(docs.limit(0), language.trainable()) is None
    assert {r.lang_pred for r in language.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), None, ["doc_id"]).count() == 0


def test_every_language_is_learned(spark, make_docs):
    import random

    draw, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:02d}": ["".join(draw.choices(letters, k=5)) for _ in range(6)] for i in range(70)}
    rows = [(i * 100 + k, " ".join(draw.choices(words, k=12)), lang) for i, (lang, words) in enumerate(own.items()) for k in range(6)]
    field = language.learn(make_docs(rows), F.lit(True))
    assert sorted(field.languages) == sorted(own)
