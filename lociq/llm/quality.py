"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

The statistics of a text (shares of kinds of characters, word lengths, repetition, shape of its lines) are
mapped by random Fourier features, which approximate a Gaussian kernel. Each partition sums its part of
the normal equations, Spark adds the parts up by row of the matrix, and the driver solves one system of
fixed size. Isotonic regression over a fixed grid of raw scores turns them into probabilities; the scores it learns from are those of
models that the row had no part in (its fold's equations are taken off the sum), so that it isn't fooled by what the ridge has fitted.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import may_hold, named, settle, summed

N_FOURIER = 256
RIDGE = 1e-4
WIDTH = 1.0
SEED = 7
GRID = 2048
FOLDS = 4
SLICE = 256

#: Kinds of bytes: 0 other symbols, 1 a-z, 2 A-Z, 3 digits, 4 blanks, 5 line ends, 6 stops and commas, 7 beyond ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[[32, 9]], KINDS[[10, 13]], KINDS[[46, 44]], KINDS[128:] = 1, 2, 3, 4, 5, 6, 7

STATISTICS = (
    "symbols", "lower", "upper", "digits", "blanks", "line_ends", "stops", "beyond_ascii",
    "log_words", "word_bytes", "word_spread", "distinct", "top_word", "same_next",
    "capital_words", "shouted", "marked", "lone_symbols", "log_lines", "line_words", "repeated_lines", "short_lines", "entropy", "worst_line",
)


def statistics(text: str) -> list[float]:
    """The numbers of STATISTICS for a whole text; zeros for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(KINDS[raw], minlength=8)
    shares = kinds / len(raw)
    sizes = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = np.bincount(raw, minlength=256)
    seen = seen[seen > 0] / len(raw)
    odd = sum(not x[-1].isalnum() and x[-1] not in ".," for x in words)
    lone = sum(len(x) == 1 and not x.isalnum() for x in words)
    shout = sum(len(x) > 1 and x.isupper() for x in words)
    worst = max((sum(not c.isalnum() and c not in " .,'" for c in x) / len(x) for x in lines), default=0.0)
    return [
        *shares.tolist(),
        float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), len(counts) / n**0.8, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(x[0].isupper() for x in words) / n, shout / n, odd / n, lone / n,
        float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), sum(len(x) < 40 for x in lines) / len(lines),
        float(-(seen * np.log2(seen)).sum()), worst,
    ]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SLICE rows at a time, so that few texts are held as Python strings."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, one row for each row of docs. A null text counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id long, stats array<double>")


class QualityModel:
    """Fixed-size model: scaling of the statistics, Fourier directions, weights, calibration steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n_fourier: int = N_FOURIER, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(0, WIDTH / np.sqrt(len(mean)), (len(mean), n_fourier))
        self.phases = rng.uniform(0, 2 * np.pi, n_fourier)
        self.weights = np.zeros(n_fourier + 1)
        self.steps, self.values = np.zeros(1), np.full(1, 0.5)

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        slope = 1 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50)))  # keeps the order within a level step
        return np.clip(0.999 * np.interp(raw, self.steps, self.values) + 0.001 * slope, 0.0, 1.0)


def _stats_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy().reshape(-1, len(STATISTICS))


def folds(stats: np.ndarray) -> np.ndarray:
    """A fold for each row by its statistics, so that equal texts share one."""
    return np.fromiter((zlib.crc32(x.tobytes()) % FOLDS for x in np.ascontiguousarray(stats)), np.int64, len(stats))


def isotonic(places: np.ndarray, counts: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising means over places in ascending order, as (places, means)."""
    blocks: list[list[float]] = []
    for x, n, p in zip(places, counts, positives, strict=True):
        blocks.append([x, x, n, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n2, p2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n2, blocks[-1][3] + p2]
    ends = [(x, p / n) for lo, hi, n, p in blocks for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([x for x, _ in ends]), np.array([m for _, m in ends])


def _solved(normal: np.ndarray) -> np.ndarray:
    """Ridge weights from normal equations, the last column their right side; the constant is hardly shrunk."""
    xtx, xty = normal[:, :-1], normal[:, -1]
    return np.linalg.solve(xtx + RIDGE * xtx[-1, -1] * np.diag([*np.ones(len(xtx) - 1), 1e-9]), xty)


def fit_quality(labelled: DataFrame, n_fourier: int = N_FOURIER) -> QualityModel:
    """Fit on all rows of (stats array<double>, label int); rows with a null in either are left out.
    Without rows the model scores 0.5 throughout; with one class only, that class."""
    spark = labelled.sparkSession
    data = settle(labelled.where(F.col("label").isNotNull() & F.col("stats").isNotNull()).select("stats", F.col("label").cast("double").alias("label")), "quality-labelled")
    k = len(STATISTICS)
    sums = [F.sum(f(F.col("stats")[i])) for i in range(k) for f in (lambda c: c, lambda c: c * c)]
    n, *rest = data.agg(F.count("*"), *sums).first()
    if not n:
        return QualityModel(np.zeros(k), np.ones(k), n_fourier)
    first, second = np.array(rest[::2], float) / n, np.array(rest[1::2], float) / n
    model = QualityModel(first, np.sqrt(np.maximum(second - first**2, 0)) + 1e-6, n_fourier)
    shared = spark.sparkContext.broadcast(model)  # a few hundred kB whatever the input
    size = n_fourier + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            stats, y = _stats_of(batch, 0), batch.column(1).to_numpy()
            x, own = shared.value.fourier(stats), folds(stats)
            both = np.column_stack([x, y])
            for k in range(FOLDS):
                total[k] += x[own == k].T @ both[own == k]
        rows = total.reshape(FOLDS * size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["i", "row"])

    parts = data.mapInArrow(part, "i int, row binary")  # a row of each i from each partition
    normal = np.array([np.frombuffer(r["row"]) for r in sorted(summed(parts, "i", "row", "<f8").collect())]).reshape(FOLDS, size, size + 1)
    whole = normal.sum(axis=0)
    model.weights = _solved(whole)
    without = np.array([_solved(whole - x) if 0 < x[-1, -2] < n else model.weights for x in normal])  # the last feature is 1: its square counts rows
    fitted = spark.sparkContext.broadcast((model, without))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, without = fitted.value
        for batch in batches:
            stats = _stats_of(batch, 0)
            raw = (model.fourier(stats) * without[folds(stats)]).sum(axis=1)
            at = np.clip(np.floor((raw + 0.5) / 2 * GRID), 0, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    grid = data.mapInArrow(bins, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()  # GRID rows at most
    places = (np.array([r["bin"] for r in grid]) + 0.5) / GRID * 2 - 0.5
    model.steps, model.values = isotonic(places, np.array([r["n"] for r in grid], float), np.array([r["p"] for r in grid], float))
    return model


def score_documents(stats: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """doc_id, score (calibrated probability of label 1), predicted (1 if score >= threshold)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.score(_stats_of(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(score, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 0 after division by 5; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Labels are learnt only from ids that aren't held out; a row whose label is null teaches nothing, a
    repeated one counts as often as it stands. Repeated documents are scored each; null and empty texts
    get the score of the all-zero statistics. Very long texts are measured whole, one at a time in a task. Every labelled row is used, there
    is no sample. An empty table gives no rows; other columns are ignored whatever their names.
    """
    stats = settle(document_statistics(docs), "quality-stats")
    taught = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    model = fit_quality(stats.join(taught, "doc_id").select("stats", "label"))
    scores = score_documents(stats, model, threshold)
    return scores.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model doesn't reject, with the columns they came with.

    The model is fitted as in quality_scores. The rows are then judged where they lie, in a second pass
    over the texts: no text is shuffled, and rows that share an id are judged each by its own text. Repeated rows stay or
    go together; null and empty texts are judged by the all-zero statistics; without labels every score is 0.5 and all
    rows stay. An empty table stays empty. Other columns keep their values whatever their names.
    """
    taught = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    taught = settle(taught.where("doc_id is not null and label is not null"), "quality-labels")
    some = docs.where(may_hold(taught.select(F.xxhash64("doc_id").alias("node")))(F.xxhash64(F.col("doc_id").cast("long"))))  # no statistics of unlabelled texts
    model = fit_quality(document_statistics(some).join(taught, "doc_id").select("stats", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = [statistics(t or "") for t in batch.column(0).flatten()[at].to_pylist()]
            good = shared.value.score(np.array(stats).reshape(-1, len(STATISTICS))) >= threshold
            yield batch.filter(pa.array(good))

    return rows.mapInArrow(keep, rows.schema).select("row.*")
