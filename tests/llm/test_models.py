import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lociq.llm.hmm import Model, score_texts
from lociq.llm.hmm import gains_of as hmm_gains
from lociq.llm.quality import STATISTICS, QualityModel, fit_quality, isotonic, keep_quality, quality_scores, statistics

from .conftest import sentence


def corpus(n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(rng, rng.randint(5, 60))
        rows.append((i, " | ".join(w + "%%%" for w in text.split()) if bad else text.capitalize() + "."))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_held_out(spark, frame):
    rows, labels = corpus()
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(frame(rows), told).collect()}
    assert len(got) == len(rows)
    out = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert sum(r.predicted == labels[r.doc_id][1] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = {r.doc_id for r in keep_quality(frame(rows), told).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_quality_odd_rows(spark, frame, odd_rows):
    rows, labels = corpus(60)
    told = spark.createDataFrame([*labels, (1, None, 0), (1, 1, 0), (None, 1, 0), (999_999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_scores(frame(odd_rows), told).count() == len(odd_rows)
    assert quality_scores(frame([]), told).count() == 0
    none = told.limit(0)
    assert all(r.score == pytest.approx(0.5, abs=0.01) for r in quality_scores(frame(odd_rows), none).collect())
    kept = keep_quality(frame(odd_rows), none)
    assert kept.count() == len(odd_rows) and kept.columns == frame(odd_rows).columns


def test_fourier_features_approximate_the_kernel():
    """Inner products of the features against the Gaussian kernel that they stand for."""
    rng = np.random.default_rng(0)
    k = len(STATISTICS)
    model = QualityModel(np.zeros(k), np.ones(k), n_fourier=20_000)
    x = rng.normal(size=(30, k))
    f = model.fourier(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * k))
    assert np.abs(f @ f.T - kernel).max() < 0.05


def test_normal_equations_as_solved_at_once(spark):
    """Sums over many partitions, in two steps, against one solution with all rows at hand."""
    rng = np.random.default_rng(1)
    k = len(STATISTICS)
    x = rng.normal(size=(400, k))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "stats array<double>, label int").repartition(7)
    model = fit_quality(rows, n_fourier=32)
    f = model.fourier(x)
    want = np.linalg.solve(f.T @ f + 1e-4 * 400 * np.diag([*np.ones(32), 1e-9]), f.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.7
    edges = np.quantile(score, [0, 0.25, 0.5, 0.75, 1])
    for a, b in zip(edges[:-1], edges[1:], strict=True):  # calibrated: the mean score of a quarter is its share of ones
        at = (score >= a) & (score <= b)
        assert abs(score[at].mean() - y[at].mean()) < 0.1


def test_calibration_on_rows_kept_out(spark):
    """Labels that statistics tell with some chance alone: scores of fresh rows are as often right as they say, which those that the
    steps would have from the ridge's own rows are not."""
    rng = np.random.default_rng(8)
    stats = rng.normal(size=(1600, len(STATISTICS)))
    chance = 1 / (1 + np.exp(-1.5 * stats[:, 0]))
    labels = (rng.random(1600) < chance).astype(int)
    taught = spark.createDataFrame([(x.tolist(), int(y)) for x, y in zip(stats[:600], labels[:600], strict=True)], "stats array<double>, label int")
    model = fit_quality(taught)
    score, y = model.score(stats[600:]), labels[600:]
    raw = model.raw(stats[:600])
    order = np.argsort(raw)
    fooled = np.interp(model.raw(stats[600:]), *isotonic(raw[order], np.ones(600), labels[:600][order].astype(float)))
    error = lambda s: sum(abs((s[g] - y[g]).sum()) for g in np.array_split(np.argsort(s, kind="stable"), 10)) / len(y)
    assert error(score) < 0.08 and error(score) < 0.6 * error(fooled)
    assert ((score - y) ** 2).mean() < ((fooled - y) ** 2).mean()


def test_ties_of_counts_keep_own_rows(spark, monkeypatch):
    import lociq.llm.hmm as hmm

    monkeypatch.setattr(hmm, "LOCAL_COUNTS", 100)
    counts = spark.createDataFrame([(f"w{i}", 1) for i in range(300)] + [("", 5)], "word string, c long")
    words = hmm.vocabulary(counts)
    assert 50 <= len(words.own) <= 100 and words.total == 305 and words.distinct == 301


def test_isotonic_rises():
    x, y = isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.5]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and y[0] == 0


def test_statistics_of_nothing():
    assert statistics("") == [0.0] * len(STATISTICS) == statistics(" \n")
    assert all(map(math.isfinite, statistics("a" * 100_000)))


def test_base_score_and_counts(frame, odd_rows):
    rng = random.Random(2)
    rows = [*odd_rows, *((100 + i, sentence(rng, rng.randint(0, 40))) for i in range(80))]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.held_out), r) for r in score_texts(frame(rows), rounds=2).collect())
    want = sorted(((str(i), len(words(t)), sum(w in counts for w in words(t)), out(i)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([r.base_score for _, r in got], [b for _, b in want])
    assert all(r.train_tokens == n and r.score < 0 for _, r in got)
    assert score_texts(frame([])).count() == 0


def test_rounds_raise_likelihood(frame):
    """Two languages: hidden states tell them apart, so held-out texts score above their words' frequencies."""
    rng = random.Random(3)
    vocabularies = [[f"{a}{b}" for a in s for b in s] for s in ("abcd", "wxyz")]
    rows = [(i, " ".join(rng.choice(vocabularies[i % 2]) for _ in range(40))) for i in range(300)]
    got = score_texts(frame(rows), rounds=8).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)


def test_words_beyond_own_rows_are_learnt(frame, monkeypatch):
    """Two languages whose telling words are all past the rows of the broadcast model: their states are learnt all the same."""
    import lociq.llm.hmm as hmm

    rng = random.Random(3)
    vocabularies = [[f"{a}{b}" for a in s for b in s] for s in ("abcd", "wxyz")]
    rows = [(i, " ".join(rng.choice(vocabularies[i % 2]) for _ in range(40))) for i in range(300)]
    monkeypatch.setattr(hmm, "OWN_ROWS", 2)
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 500)
    got = hmm.score_texts(frame(rows), rounds=8).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)


def test_gains_leave_one_distribution():
    counts = np.random.default_rng(1).gamma(1, 3, (40, 3))
    total, distinct = counts.sum(), len(counts)
    share = np.append(counts.sum(axis=1) + 1, 1) / (total + distinct + 1)
    gains = np.vstack([hmm_gains(counts, counts.sum(axis=0)), hmm_gains(np.zeros((1, 3)), counts.sum(axis=0))])
    assert np.allclose((share[:, None] * gains).sum(axis=0), 1) and np.allclose(gains[-1], 1)


def test_forward_as_brute_force():
    rng = np.random.default_rng(1)
    model = Model(np.array([5.0, 3, 2, 1]), states=3)
    model.move = rng.dirichlet(np.ones(3), 3)
    model.start = rng.dirichlet(np.ones(3))
    for n in (1, 4):
        seq = rng.integers(0, 4, n)
        total = 0.0
        for path in np.ndindex(*[3] * n):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
            total += p
        assert model.likelihood([seq, seq[:1]])[0] == pytest.approx(math.log10(total))


def test_expected_counts_as_brute_force():
    rng = np.random.default_rng(2)
    model = Model(np.array([5.0, 3, 2]), states=2)
    model.move, model.start, model.middle = rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2))
    seq, real = np.array([[0, 2, 1, 0]]), np.array([[True, True, True, False]])
    words, moves, total = np.zeros((3, 2)), np.zeros((2, 2)), 0.0
    for path in np.ndindex(2, 2, 2):
        p = model.start[path[0]] * np.prod([model.emit[seq[0, t], path[t]] for t in range(3)]) * np.prod([model.move[path[t], path[t + 1]] for t in range(2)])
        total += p
        for t in range(3):
            words[seq[0, t], path[t]] += p
        for t in range(2):
            moves[path[t], path[t + 1]] += p
    got = model.expect(seq, real, np.array([True]))
    assert np.allclose(got[:3], words / total) and np.allclose(got[-2:], moves / total)


def test_steps_of_many_sequences_as_one_by_one(monkeypatch):
    """The forward recursion takes tokens step by step from blocks of any size; words are looked up once, by place."""
    import lociq.llm.hmm as hmm

    rng = np.random.default_rng(3)
    model, gains = hmm.Model(rng.integers(1, 9, 12).astype(float)), rng.random((5, hmm.STATES)) + 0.5
    sequences = [rng.integers(0, 12, n).astype("<u2") for n in (1, 40, 3, 3, 17, 1)]
    tails = [np.where(s == 10, rng.integers(-1, 5, len(s)), -1).astype(np.int32) for s in sequences]
    expected = []
    for s, w in zip(sequences, tails, strict=True):
        now, total = model.start, 0.0
        for t, (symbol, word) in enumerate(zip(s, w, strict=True)):
            now = (now if t == 0 else now @ model.move) * model.emit[symbol] * (gains[word] if word >= 0 else 1)
            total, now = total + math.log10(now.sum()), now / now.sum()
        expected.append(total)
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(hmm, "STEP_TOKENS", size)
        assert np.allclose(model.likelihood(sequences, tails, gains), expected, rtol=1e-12)
    held = {b"b": 5, b"": 3, b"a": 2, b"c": 1}
    known, counts = hmm.Vocabulary(11, 4, {b"b": 0, b"a": 1}, held, 1, 1).places()
    assert known == {b"b": 0, b"a": 1, b"c": 2} and counts.tolist() == [5, 2, 1, -1]
