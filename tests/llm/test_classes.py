"""Class-based scoring against plain counting, and exchanges against the likelihood itself."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from txrisk.llm import classes as K
from txrisk.llm.classes import Settings

SCHEMA = "doc_id long, text string, block string, shard int, score string, held string"
SMALL = Settings(classes=6, batches=2, block_bytes=3000)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "s", "h") for i, t in rows], SCHEMA).repartition(3)


def _corpus(n=240, seed=1):
    """Sentences of a fixed pattern of kinds of words, so that classes tell something."""
    rng = random.Random(seed)
    kinds = [["The", "a", "this"], [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(25)], [f"adv{i}" for i in range(12)]]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 9)):
            words += [rng.choice(kind) for kind in (*kinds, kinds[0], kinds[1])]
            if rng.random() < 0.2:
                words.append(f"rare{rng.randint(0, 500)}")
        rows.append((3 * i - 20, rng.choice([" ", "\n ", "\t"]).join(words)))
    return [*rows, (5001, None), (5002, ""), (5003, " \x0b\n"), (None, "the noun1 É x"), (7, rows[3][1]), (7, rows[3][1]), (9000, "ÉTÉ été Été")]


def _tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


def _held(doc_id):
    return doc_id is None or crc32(str(doc_id).encode()) % 10 == 0


def _plain(rows, of, settings):
    """Every column of the score by counting, given the classes of words."""
    k, prior = settings.classes, settings.prior
    train = [_tokens(t) for i, t in rows if not _held(i)]
    count = Counter(w for doc in train for w in doc)
    n, v = sum(count.values()), len(count)
    cls = lambda w: 0 if w is None else of[w]
    pairs, size = Counter(), Counter()
    after, before_once, once_total = Counter(), Counter(), 0
    rare = lambda w: w is not None and count[w] == 1
    for doc in train:
        for a, b in itertools.pairwise([None, *doc]):
            pairs[cls(a), cls(b)] += 1
            size[cls(a)] += 1
            before_once[cls(a)] += rare(b)
            if rare(a):
                once_total += 1
                before_once[k] += rare(b)
                if not rare(b):
                    after[cls(b)] += 1
    share = (sum(c == 1 for w, c in count.items() if w is not None) + 0.5) / (n + 1)

    def unknown(c):
        whole = once_total if c == k else size[c]
        return (before_once[c] + prior * share) / (whole + prior)

    def follows(c, d):
        own = size[d] / max(n, 1)
        row = after[d] if c == k else pairs[c, d]
        whole = sum(after.values()) if c == k else size[c]
        return (row + prior * own) / (whole + prior)

    out = []
    for i, t in rows:
        doc, at, score, base = _tokens(t), 0, 0.0, 0.0
        for w in doc:
            base += math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
            if count[w]:
                score += math.log10((1 - unknown(at)) * follows(at, cls(w)) * count[w] / size[cls(w)])
                at = cls(w)
            else:
                score += math.log10(unknown(at))
                at = k
        out.append((i, _held(i), len(doc), sum(count[w] > 0 for w in doc), n, base, score))
    return out


def _same(got, want):
    key = lambda r: repr((r[0], r[2], round(r[5], 6)))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def learnt(spark, corpus):
    return {r["word"]: (r["n"], r["class"]) for r in K.word_classes(_frame(spark, corpus), SMALL).collect()}


@pytest.fixture(scope="module")
def scored(spark, corpus):
    return K.score_texts(_frame(spark, corpus), SMALL).collect()


def test_counts_of_words(corpus, learnt):
    want = Counter(w for i, t in corpus if not _held(i) for w in _tokens(t) if w is not None)
    assert {w: n for w, (n, _) in learnt.items()} == dict(want)


def test_scores_by_counting(corpus, learnt, scored):
    _same(scored, _plain(corpus, {w: c for w, (_, c) in learnt.items()}, SMALL))


def test_better_than_single_words(scored):
    held = [r for r in scored if r.held_out and r.n_tokens > 5]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_raises_the_likelihood(corpus, learnt):
    """The moved classes explain the training pairs better than the first ones do."""
    train = [_tokens(t) for i, t in corpus if not _held(i)]
    count = Counter(w for doc in train for w in doc if w is not None)
    top = sorted(count, key=lambda w: (-count[w], w.encode()))[: SMALL.classes - 2]
    first = {w: 1 + top.index(w) if w in top else SMALL.classes - 1 for w in count}

    def likelihood(of):
        pairs, size = Counter(), Counter()
        for doc in train:
            for a, b in itertools.pairwise([None, *doc]):
                a, b = (0 if w is None else of[w] for w in (a, b))
                pairs[a, b] += 1
                size[a] += 1
        return sum(n * math.log(n) for n in pairs.values()) - 2 * sum(n * math.log(n) for n in size.values())

    assert likelihood({w: c for w, (_, c) in learnt.items()}) > likelihood(first)
    assert {c for _, c in learnt.values()} <= set(range(1, SMALL.classes))


def test_gains_are_differences_of_likelihood():
    """Each word in each class, against the whole likelihood counted anew."""
    rng = random.Random(3)
    k, words = 5, 12
    of = np.array([0] + [rng.randint(1, k - 1) for _ in range(words)])
    stream = [0] + [rng.choice([0, *range(1, words + 1), 3, 3]) for _ in range(400)] + [0]

    def likelihood(classes):
        pairs = np.zeros((k, k))
        for a, b in itertools.pairwise(stream):
            pairs[classes[a], classes[b]] += 1
        return K._xlogx(pairs).sum() - 2 * K._xlogx(pairs.sum(axis=1)).sum(), pairs

    whole, pairs = likelihood(of)
    met = Counter()
    for a, b in itertools.pairwise(stream):
        if a == b:
            met[a, 2 * k] += 1
        else:
            met[a, of[b]] += 1
            met[b, k + of[a]] += 1
    keys = sorted(x for x in met if x[0])
    count = Counter(stream[1:])
    gain = K.gains(
        pairs, of[1:], np.array([count[w] for w in range(1, words + 1)]),
        np.array([w - 1 for w, _ in keys]), np.array([s for _, s in keys]), np.array([met[x] for x in keys]),
    )
    for w in range(1, words + 1):
        for c in range(k):
            moved = of.copy()
            moved[w] = c
            assert math.isclose(gain[w - 1, c] - gain[w - 1, of[w]], likelihood(moved)[0] - whole, abs_tol=1e-8)


def test_blocks_and_partitions_do_not_matter(spark, corpus, scored):
    for size, parts in ((2500, 7), (10**9, 1)):
        other = K.score_texts(_frame(spark, corpus).repartition(parts), Settings(classes=6, batches=2, block_bytes=size))
        _same(other.collect(), [tuple(r) for r in scored])


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    k = 5
    counts = rng.integers(0, 9, (k + 1, k + 1))
    model = K._model(counts.reshape(-1), int(counts[:k, :k].sum()), 40, 7, Settings(classes=k))
    total = 10**model.known * (10**model.follows).sum(axis=1) + 10**model.unknown
    assert np.allclose(total, 1)


def test_no_rows_and_no_training_rows(spark, corpus):
    assert K.score_texts(_frame(spark, corpus).limit(0), SMALL).count() == 0
    assert K.word_classes(_frame(spark, corpus).limit(0), SMALL).count() == 0
    held = [r for r in corpus if _held(r[0])]
    rows = K.score_texts(_frame(spark, held), SMALL).collect()
    assert len(rows) == len(held)
    assert {(r.train_tokens, r.n_known, r.base_score) for r in rows} == {(0, 0, 0.0)}
    assert all(math.isclose(r.score, r.n_tokens * math.log10(0.5), rel_tol=1e-9) for r in rows)


def test_production_settings_on_a_long_text(spark):
    rows = [(1, "one two three " * 200_000), (2, "two one four"), (3, "x" * 1_000_000), (4, None), (11, "one")]
    got = K.score_texts(_frame(spark, rows))
    of = {r["word"]: r["class"] for r in K.word_classes(_frame(spark, rows)).collect()}
    _same(got.collect(), _plain(rows, of, Settings()))
