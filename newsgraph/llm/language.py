"""Languages of words in mixed text by a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_BYTES, as_bytes, map_texts, remainder

#: Rows that the field is fitted on, the same number of each language: those of smallest key hash.
SAMPLE = 1_000
#: Rows drawn of each language at least, however many there are.
LEAST_EACH = 20
#: Buckets of the hashed features.
FEATURES = 1 << 17
#: Words whose scores a task remembers.
REMEMBERED = 300_000
UNKNOWN = "und"
#: Words of a training sequence, and of the pieces of one language that it is put together from.
SEQUENCE, PIECE = 64, 24
_BATCH = 2_048

_WORD_CHARACTERS = re.compile(r"[^\W\d_]+")


def features(word: bytes) -> list[int]:
    """Hashed features: the word (lexicon), affixes of 1 to 4 bytes, and inner trigrams; none for a number."""
    if word.isdigit():
        return []
    crc, size = zlib.crc32, len(word)
    found = [b"w" + word, *(b"<" + word[:n] for n in range(1, min(4, size) + 1)), *(b">" + word[-n:] for n in range(1, min(4, size) + 1))]
    found += [b"-" + word[i : i + 3] for i in range(1, min(size - 3, 20))]
    return [crc(f) % FEATURES for f in found]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def has_letter(text: str | None) -> bool:
    return text is not None and any(any(map(str.isalpha, m.group())) for m in _WORD_CHARACTERS.finditer(text))


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Score of each word for each language: the summed weights of its features."""
    lists = [features(w) for w in words]
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(words), weights.shape[1]))
    if sizes.sum():
        flat = np.fromiter((f for x in lists for f in x), np.int64, sizes.sum())
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        out[sizes > 0] = np.add.reduceat(weights[flat], starts, axis=0)
    return out


def posteriors(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences at once: the probability of each language for each word.

    Sequence k is ``scores[starts[k] : starts[k] + sizes[k]]``.  Longer sequences come first, so that a step works on
    those that are still running.
    """
    emit = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    step = np.exp(moves)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    now = None
    for t in range(longest):
        at = starts[: running[t]] + t
        now = emit[at] if t == 0 else (now[: running[t]] @ step) * emit[at]
        now /= now.sum(1, keepdims=True)
        ahead[at] = now
    back = np.ones((0, emit.shape[1]))
    for t in range(longest - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        if len(back) < n:
            back = np.concatenate((back, np.ones((n - len(back), emit.shape[1]))))
        behind[at] = back
        back = (back * emit[at]) @ step.T
        back /= back.sum(1, keepdims=True)
    found = ahead * behind
    return found / found.sum(1, keepdims=True) if len(found) else found


class Field:
    """Languages, weights of hashed features and transition scores."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.moves = languages, weights, moves


def fit(rows: list[tuple[str, bytes]], rounds: int = 30, rate: float = 0.3, decay: float = 1e-5) -> Field | None:
    """Conditional random field by Adam on the likelihood of word labels.

    Each word of a row carries the row's language.  Sequences are put together from pieces of rows in an order drawn at
    random, which gives mixed text with known labels; the transitions learn how seldom the language changes.
    """
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    vocabulary: dict[bytes, int] = {}
    pieces = []
    for lang, text in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        pieces += [(number[lang], ids[i : i + PIECE]) for i in range(0, len(ids), PIECE)]
    count, kinds = len(languages), len(vocabulary)
    if not pieces:
        return Field(languages, np.zeros((FEATURES, count)), np.zeros((count, count)))
    order = np.random.default_rng(11).permutation(len(pieces))
    ids = np.concatenate([pieces[k][1] for k in order])
    labels = np.concatenate([np.full(len(pieces[k][1]), pieces[k][0]) for k in order])
    rows_, width = -(-len(ids) // SEQUENCE), SEQUENCE
    inside = np.arange(rows_ * width).reshape(rows_, width) < len(ids)
    ids, labels = (np.pad(x, (0, rows_ * width - len(x))).reshape(rows_, width) for x in (ids, labels))
    lists = [features(w) for w in vocabulary]
    kind = np.repeat(np.arange(kinds), [len(x) for x in lists])
    feature = np.array([f for x in lists for f in x], np.int64)
    truth, pairs = np.zeros((kinds, count)), np.zeros((count, count))
    np.add.at(truth, (ids[inside], labels[inside]), 1)
    both = inside[:, 1:]
    np.add.at(pairs, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    weights, moves = np.zeros((FEATURES, count)), np.zeros((count, count))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    total = inside.sum()
    for turn in range(1, rounds + 1):
        by_word = np.stack([np.bincount(kind, weights=weights[feature, c], minlength=kinds) for c in range(count)], 1)
        by_word = np.exp(by_word - by_word.max(1, keepdims=True))
        step = np.exp(moves)
        mass, expected = np.zeros((kinds, count)), np.zeros((count, count))
        for k in range(0, rows_, _BATCH):
            own, ok = ids[k : k + _BATCH], inside[k : k + _BATCH]
            emit = by_word[own]
            ahead, behind = np.empty_like(emit), np.ones_like(emit)
            now = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
            ahead[:, 0] = now
            for t in range(1, width):
                now = np.where(ok[:, t, None], (now @ step) * emit[:, t], now)
                now /= now.sum(1, keepdims=True)
                ahead[:, t] = now
            for t in range(width - 2, -1, -1):
                after = behind[:, t + 1] * emit[:, t + 1] * ok[:, t + 1, None]
                joint = ahead[:, t, :, None] * step * after[:, None, :]
                expected += (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)
                back = after @ step.T
                behind[:, t] = np.where(ok[:, t + 1, None], back / np.maximum(back.sum(1, keepdims=True), 1e-300), 1.0)
            p = ahead * behind
            p = p / p.sum(2, keepdims=True) * ok[..., None]
            mass += np.stack([np.bincount(own.ravel(), weights=p[..., c].ravel(), minlength=kinds) for c in range(count)], 1)
        g = (mass - truth) / total
        gw = np.stack([np.bincount(feature, weights=g[kind, c], minlength=FEATURES) for c in range(count)], 1) + decay * weights
        gm = (expected - pairs) / total
        for k, (value, grad) in enumerate(((weights, gw), (moves, gm))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.98 * state[2 * k + 1] + 0.02 * grad**2
            value -= rate * (state[2 * k] / (1 - 0.9**turn)) / (np.sqrt(state[2 * k + 1] / (1 - 0.98**turn)) + 1e-6)
    return Field(languages, weights, moves)


def learn(docs: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Field | None:
    """Field of every language that occurs, fitted on up to ``sample`` rows (or ``LEAST_EACH`` of each, if more), as many of each, drawn by key hash from rows with a language and a text.

    ``allowed`` (on ``key``) says which rows may be learned from; only keys and languages are ranked, limited before the
    shuffle, and the texts are fetched by a broadcast of the drawn keys.
    """
    known = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), allowed.alias("a")).filter("a").dropna()
    kinds = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not kinds:
        return None
    each = max(LEAST_EACH, sample // len(kinds))
    # of a frequent language only the rows of low hash are ranked, a few times as many as are drawn
    shares = docs.sparkSession.createDataFrame([(kind, int((1 << 30) * min(1.0, 8 * (each + 8) / count))) for kind, count in kinds.items()], "l string, low bigint")
    low = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.col("low")
    ranked = known.select("k", "l").join(F.broadcast(shares), "l").filter(low).select("k", "l").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), "k")))
    drawn = ranked.filter(F.col("r") <= each).select("k", "l").distinct()
    rows = known.select("k", "l", "t").join(F.broadcast(drawn), ["k", "l"]).select("k", "l", F.encode("t", "UTF-8").alias("t")).collect()
    return fit([(r["l"], bytes(r["t"])) for r in sorted(rows, key=lambda r: (r["l"], r["k"], bytes(r["t"])))])


def predict(docs: DataFrame, field: Field | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` and ``shares`` of each whole text.

    Every word gets a probability for each language by forward-backward over the whole text.  ``shares`` are their means
    by language, ``lang_pred`` is the language of the largest one (of equals the first by name) and ``score`` that share.
    A text that is null or has no letter is ``und`` with score 0 and no shares; so is every text if ``field`` is None.
    Repeated rows come out alike, an empty table gives none, and a text of any length is one chain, held whole by its task.
    Own columns replace kept ones of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.languages, field.weights, field.moves) if field else None)

    def make():
        if shared.value is None:
            return lambda column: [pa.array([UNKNOWN] * len(column)), pa.array(np.zeros(len(column))), pa.array([{}] * len(column), pa.map_(pa.string(), pa.float64()))]
        languages, weights, moves = shared.value
        count = len(languages)
        numbers: dict[bytes, int] = {}
        table = np.zeros((REMEMBERED, count))

        def scores_of(words: list[bytes]) -> np.ndarray:
            """Scores by word from the remembered ones; new words are added, all are forgotten when there are too many."""
            nonlocal table
            at = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
            if (at < 0).any():
                new = {words[i] for i in np.flatnonzero(at < 0)}
                if len(numbers) + len(new) > len(table):
                    numbers.clear()
                    new = set(words)
                    table = np.zeros((max(REMEMBERED, len(new)), count))
                new = sorted(new)
                base = len(numbers)
                table[base : base + len(new)] = emissions(new, weights)
                numbers.update(zip(new, range(base, base + len(new))))
                at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            return table[at]

        def kernel(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            letters = np.array([has_letter(t) for t in texts], bool)
            lists = [words_of(t) if some else [] for t, some in zip(as_bytes(pc.utf8_lower(column)), letters)]
            sizes = np.array([len(x) for x in lists], np.int64)
            starts = np.cumsum(sizes) - sizes
            p = posteriors(scores_of([w for x in lists for w in x]), starts, sizes, moves)
            some = np.flatnonzero(sizes)
            shares = np.zeros((len(texts), count))
            if len(some):
                shares[some] = np.add.reduceat(p, starts[some], axis=0) / sizes[some, None]
            best = shares.argmax(1)
            known = sizes > 0
            maps = [dict(zip(languages, row.tolist())) if k else {} for row, k in zip(shares, known)]
            return [
                pa.array([languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                pa.array(np.where(known, np.clip(shares[np.arange(len(texts)), best], 0, 1), 0.0)), pa.array([list(m.items()) for m in maps], pa.map_(pa.string(), pa.float64())),
            ]

        return kernel

    return map_texts(docs, make, "lang_pred string, score double, shares map<string, double>", keep, text, most=4 << 20)


def trainable(key: str = "doc_id", modulus: int = 3, rest: int = 1) -> Column:
    """True for the rows that may be learned from; not for those held out or without a key."""
    return F.coalesce(remainder(F.col(key), modulus) != rest, F.lit(False))
