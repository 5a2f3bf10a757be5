"""Hidden Markov language model: Baum-Welch on all training documents, exact likelihood by scaled forward recursion.

The commonest words have emission rows in the model that is broadcast. Every other word that training holds more than once has a
row of its own too, in a table: its share of the other words' common symbol in each state, over its share of the training tokens
(add-one, one part for all unknown words), which is its gain; of a word that stands once it is 1. Their expected
counts go, by hash of the word, to the buckets that add them up, and come back as gains to the chunks of documents that hold
the words, in the first, every second from there and the last round. Chunks are written in buckets by their number, so that only gains move to them, never texts. The counts of the model
that is broadcast are summed in each partition and added up by Spark; the driver gets sums of fixed size.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import FAN_IN, discard, filter_bits, in_filter, settle, settle_by, summed

STATES = 6
OWN_ROWS = 60_000
LOCAL_COUNTS = 200_000
ROUNDS = 4
SEGMENT = 128
SEGMENTS = 512
STEP_TOKENS = 1 << 16
PARTS = 16
FLUSH = 250_000
CHUNK_TOKENS = 600_000
SLICE = 512
GATHER = 2
BUCKETS = 256
BUCKET_ROWS = 2_000_000
SEED = 3


def words_of(text: str | None) -> list[bytes]:
    """Runs without blanks, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def left_out() -> F.Column:
    """Whether crc32 of the id as text leaves 2 after division by 7; a null id counts as not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, so that few are held as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all rows of (text); the end of each document counts as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        found: Counter = Counter()
        for batch in slices(batches):
            found[b""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
                if len(found) > FLUSH:
                    yield out(found)
                    found = Counter()
        yield out(found)

    return train.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals, and the counts of the commonest words: a bounded part, whatever the corpus."""

    total: int
    distinct: int
    own: dict[bytes, int]
    counts: dict[bytes, int]
    other_total: int
    other_distinct: int

    @property
    def end(self) -> int:
        return len(self.own) + 1

    @property
    def other(self) -> int:
        return len(self.own)

    def places(self) -> tuple[dict[bytes, int], np.ndarray]:
        """(the place of each word whose count is held, its symbol first where it has one of its own; the counts by place, behind them -1)."""
        every = [*self.own, *(w for w in self.counts if w and w not in self.own)]
        return {w: i for i, w in enumerate(every)}, np.array([*(self.counts[w] for w in every), -1], np.int64)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))

    def within(self, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of the common symbol."""
        return np.log10((c + 1) / (self.other_total + self.other_distinct + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the commonest words by steps of their count, as many whole steps as LOCAL_COUNTS words fill; of the next step those whose
    # hash is below a bound, which tells words of equal counts apart
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # at most 16 for each bit
    chosen, room = F.lit(False), LOCAL_COUNTS
    for r in sizes:
        if r["n"] > room:
            chosen = chosen | ((step == r["step"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(0.9 * room / r["n"] * (1 << 20))))
            break
        chosen, room = step >= r["step"], room - r["n"]
    top = counts.where(chosen).collect()  # about LOCAL_COUNTS rows at most
    held = {r["word"].encode(): r["c"] for r in sorted(top, key=lambda r: (-r["c"], r["word"]))}
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    own = [w for w in held if w][:OWN_ROWS]
    used = sum(held[w] for w in own) + ends
    return Vocabulary(total, distinct, {w: i for i, w in enumerate(own)}, held | {b"": ends}, total - used, distinct - len(own) - (ends > 0))


DOCS = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, within double, words array<string>, times array<int>"
CHUNKS = f"chunk long, docs array<struct<{DOCS.replace(' ', ':').replace(',:', ',')}>>, symbols binary, tail binary, hashes binary"


def encode(docs: DataFrame, words: Vocabulary, often: np.ndarray) -> DataFrame:
    """Chunks of CHUNK_TOKENS tokens or a little more: chunk (the first row's number), docs (doc_id, held_out, row, n_tokens, sums over
    the words whose counts are known here, and the words whose counts are not, with how often they occur), symbols (16-bit, each
    document's end last), hashes (64-bit, rising: of the words that share a symbol and that training may hold more than once) and tail
    (32-bit: which of these, at each place of that symbol; -1: none). ``often`` is the filter of the words that stand more than once."""
    numbers = Vocabulary(words.total, words.distinct, {}, {}, words.other_total, words.other_distinct)
    shared = docs.sparkSession.sparkContext.broadcast((numbers, words.places(), words.other, words.counts[b""], often))  # LOCAL_COUNTS words, a filter of fixed size
    doc = pa.struct(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64())]
        + [("base", pa.float64()), ("within", pa.float64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))]
    )
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(doc)), ("symbols", pa.binary()), ("tail", pa.binary()), ("hashes", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (known, counts), other, end, bits = shared.value
        place, unknown = known.get, len(known)
        rows, parts, tail, size, places = [], [], [], 0, {}

        def out() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in places), np.uint64, len(places))
            several = in_filter(bits, hashes)
            rising = np.unique(hashes[several])
            where = np.where(several, np.searchsorted(rising, hashes), -1).astype("<i4")
            at = where[np.array(tail, np.int64)] if tail else np.zeros(0, "<i4")
            return pa.RecordBatch.from_pylist([{"chunk": rows[0]["row"], "docs": rows, "symbols": b"".join(parts), "tail": at.tobytes(), "hashes": rising.tobytes()}], schema=schema)

        for batch in slices(batches):
            for doc_id, held, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                at = np.fromiter(map(place, found, repeat(unknown)), np.int64, len(found))
                c = counts[at]
                here = np.append(c[c >= 0], end)
                far = Counter([found[i] for i in np.flatnonzero(at == unknown).tolist()])
                within = v.within(c[(c >= 0) & (at >= other)]).sum()
                tail += [places.setdefault(found[i], len(places)) for i in np.flatnonzero(at >= other).tolist()]
                parts += [np.minimum(at, other).astype("<u2").tobytes(), np.array([other + 1], "<u2").tobytes()]
                numbers = {"n_tokens": len(found) + 1, "known": int((here > 0).sum()), "base": float(v.base(here).sum()), "within": float(within)}
                rows.append({"doc_id": doc_id, "held_out": held, "row": row, **numbers, "words": [w.decode() for w in far], "times": list(far.values())})
                size += len(found) + 1
                if size >= CHUNK_TOKENS:
                    yield out()
                    rows, parts, tail, size, places = [], [], [], 0, {}
        if rows:
            yield out()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), left_out().alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(read, CHUNKS)


class Model:
    """Start, transitions, emissions (a row for each symbol) of the hidden states."""

    def __init__(self, counts: np.ndarray, states: int = STATES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.prior = (counts + 0.5) / (counts + 0.5).sum()
        self.start = np.full(states, 1 / states)
        self.middle = self.start.copy()
        self.move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        emit = self.prior[:, None] * np.exp(rng.normal(0, 0.5, (len(counts), states)))
        self.emit = emit / emit.sum(axis=0)
        self.common = np.zeros(states)

    def expect(self, segments: np.ndarray, real: np.ndarray, begins: np.ndarray, tail: np.ndarray | None = None, gains: np.ndarray | None = None, found: np.ndarray | None = None) -> np.ndarray:
        """Expected counts of equal-length segments (rows; ``real`` tells tokens from padding): one row for each
        symbol, then those of the starts, the starts of later segments, and the moves, by state. ``tail`` tells which word
        with a gain stands at a place (-1: none); such words' own expected counts are added to ``found``."""
        n, length = segments.shape
        k = len(self.start)
        e = np.where(real.T[:, :, None], self.emit[segments.T], 1.0)
        has = tail.T >= 0 if tail is not None else None
        if gains is not None:
            e[has] *= gains[tail.T[has]]
        alpha, scale, ones, back = np.empty((length, n, k)), np.empty((length, n, 1)), np.ones((k, 1)), np.ascontiguousarray(self.move.T)
        alpha[0] = np.where(begins[:, None], self.start, self.middle)
        for t in range(length):
            if t:
                np.matmul(alpha[t - 1], self.move, out=alpha[t])
            alpha[t] *= e[t]
            np.matmul(alpha[t], ones, out=scale[t])
            alpha[t] /= scale[t]
        beta, gamma = np.ones((n, k)), np.empty_like(alpha)
        gamma[-1] = alpha[-1]
        for t in range(length - 2, -1, -1):
            ahead = e[t + 1]  # from here on what follows the move to this place
            ahead *= beta
            ahead /= scale[t + 1]
            np.matmul(ahead, back, out=beta)
            np.multiply(alpha[t], beta, out=gamma[t])
        e[1:] *= real.T[1:, :, None]
        moves = self.move * (alpha[:-1].reshape(-1, k).T @ e[1:].reshape(-1, k))
        gamma *= real.T[:, :, None]
        if found is not None:
            which, part = tail.T[has], gamma[has]
            found += np.stack([np.bincount(which, part[:, s], len(found)) for s in range(k)], axis=1)
        symbols = segments.T.ravel()
        words = np.stack([np.bincount(symbols, gamma[:, :, s].ravel(), len(self.emit)) for s in range(k)], axis=1)
        return np.vstack([words, gamma[0][begins].sum(axis=0), gamma[0][~begins].sum(axis=0), moves])

    def update(self, sums: np.ndarray) -> None:
        k = len(self.start)
        words, start, middle, move = sums[: len(self.emit)], sums[-k - 2], sums[-k - 1], sums[-k:]
        emit = words + 20.0 * len(words) ** 0.5 * self.prior[:, None]
        self.emit = emit / emit.sum(axis=0)
        self.start, self.middle = ((x + 0.1) / (x + 0.1).sum() for x in (start, middle))
        self.move = (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)

    def likelihood(self, sequences: list[np.ndarray], tails: list[np.ndarray] | None = None, gains: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of whole sequences, each of one symbol at least; ``tails`` as for expect."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        sizes = np.array([len(sequences[i]) for i in order])
        # tokens by place in their sequence, longest sequences first: a step takes one slice of them
        step, rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
        edges = np.concatenate([[0], np.cumsum(np.bincount(step))])
        to = edges[step] + rank

        def by_step(values: list[np.ndarray]) -> np.ndarray:
            out = np.empty(len(to), values[0].dtype)
            out[to] = np.concatenate([values[i] for i in order])
            return out

        flat, which = by_step(sequences), by_step(tails) if gains is not None else None
        scale, now, ones, first = np.empty(len(to)), None, np.ones(len(self.start)), 0
        while first < sizes[0]:
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + STEP_TOKENS, "right")) - 1)
            begin = edges[first]
            e = self.emit[flat[begin : edges[last]]]
            if which is not None:
                w = which[begin : edges[last]]
                e[w >= 0] *= gains[w[w >= 0]]
            cuts = edges[first : last + 1].tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                now = np.tile(self.start, (j - i, 1)) if now is None else now[: j - i] @ self.move
                now *= e[i - begin : j - begin]
                np.matmul(now, ones, out=scale[i:j])
                now /= scale[i:j, None]
            first = last
        total = np.bincount(rank, np.log10(scale)[to], len(sizes))
        out = np.empty(len(sizes))
        out[order] = total
        return out


def places_of(flat: np.ndarray, tail: bytes, other: int) -> np.ndarray:
    """Which word with a gain stands at each place; -1 where the symbol isn't the common one."""
    out = np.full(len(flat), -1, np.int32)
    out[flat == other] = np.frombuffer(tail, "<i4")
    return out


def segments_of(flat: np.ndarray, tail: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segments, real, begins, tail) of some documents; the last of each is padded."""
    n = -(-sizes // SEGMENT)
    first = np.cumsum(n) - n
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * SEGMENT, sizes)
    segments, real, begins = np.zeros(n.sum() * SEGMENT, np.int64), np.zeros(n.sum() * SEGMENT, bool), np.zeros(n.sum(), bool)
    places = np.full(n.sum() * SEGMENT, -1, np.int32)
    segments[place], real[place], begins[first], places[place] = flat, True, True, tail
    return segments.reshape(-1, SEGMENT), real.reshape(-1, SEGMENT), begins, places.reshape(-1, SEGMENT)


def gains_of(counts: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Gains of words (rows) by their expected counts: the share (E + r) / (sum of E + r (distinct + 1)) in a state that holds a part
    r of all their tokens, over the share (c + 1) / (total + distinct + 1) in any. One for words that training hasn't seen."""
    part = np.maximum(states / max(states.sum(), 1e-300), 1e-300)
    return (counts / part + 1) / (counts.sum(axis=1, keepdims=True) + 1)


def first_gains(hashes: np.ndarray, states: int) -> np.ndarray:
    """What tells the states apart before the first round, by hash of the word: as uneven as the first emissions of Model."""
    odd = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, states, dtype=np.uint64) | np.uint64(1)
    return np.exp((((hashes[:, None] * odd) >> np.uint64(56)).astype(float) - 127.5) / 73.9 * 0.5)


def packed(counts: np.ndarray) -> bytes:
    """Expected counts on their way between tasks: roots in 16 bits, which holds counts up to 4e9 to a relative error of 0.0005."""
    return np.sqrt(counts).astype("<f2").tobytes()


def unpacked(counts: bytes, states: int) -> np.ndarray:
    return np.square(np.frombuffer(counts, "<f2").astype(float)).reshape(-1, states)


def by_chunk(told: DataFrame) -> DataFrame:
    """chunk, counts: of its words in the order of their hashes, joined from the buckets."""
    parts = told.where("part >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("g"))
    return parts.select("chunk", F.unhex(F.array_join(F.transform("g", lambda x: F.hex(x["counts"])), "")).alias("counts"))


def fit(chunks: DataFrame, symbols: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, DataFrame | None]:
    """Baum-Welch over the documents of chunks (see encode) that aren't held out, in segments of SEGMENT tokens; and the expected
    counts of each chunk's words, where there are any. ``symbols`` are the training counts of each symbol. Without rows the model stays
    as it began."""
    model, other, spark = Model(symbols, states), len(symbols) - 2, chunks.sparkSession
    pairs = chunks.agg(F.coalesce(F.sum(F.octet_length("hashes") / 8), F.lit(0.0))).first()[0]
    bits = (max(BUCKETS, int(pairs // BUCKET_ROWS) + 1) - 1).bit_length()
    held, told = chunks.select(F.col("docs.n_tokens").alias("sizes"), F.col("docs.held_out").alias("held"), "chunk", "symbols", "tail", "hashes"), None
    for n in range(rounds):
        gather = n % GATHER == 0 or n == rounds - 1
        shared = spark.sparkContext.broadcast(model)  # OWN_ROWS rows

        def expect(batches: Iterator[pa.RecordBatch], shared=shared, gather=gather) -> Iterator[pa.RecordBatch]:
            names = ["part", "fan", "chunk", "hashes", "sums"]
            sums, fan = 0, TaskContext.get().partitionId() // FAN_IN
            for row in slices(batches, 1):
                (r,) = row.to_pylist()
                sizes, train = np.array(r["sizes"]), ~np.array(r["held"], bool)
                flat = np.frombuffer(r["symbols"], "<u2").astype(np.int64)
                hashes, tail, pick = np.frombuffer(r["hashes"], "<u8"), places_of(flat, r["tail"], other), np.repeat(train, sizes)
                gains = gains_of(unpacked(r["counts"], states), shared.value.common) if r.get("counts") else first_gains(hashes, states)
                found = np.zeros((len(hashes), states)) if gather else None
                if train.any():
                    segments, real, begins, places = segments_of(flat[pick], tail[pick], sizes[train])
                    for i in range(0, len(begins), SEGMENTS):
                        sums = sums + shared.value.expect(*(x[i : i + SEGMENTS] for x in (segments, real, begins, places)), gains, found)
                if gather:
                    # every bucket with a word of this chunk, seen in training or not: its gains come back by the same way
                    edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(edges))
                    cut = lambda x, as_bytes, some=some, edges=edges: pa.array([as_bytes(x[edges[b] : edges[b + 1]]) for b in some], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([0] * len(some), pa.int32()), pa.array([r["chunk"]] * len(some), pa.int64()), cut(hashes, np.ndarray.tobytes), cut(found, packed)], names=names)
            if not isinstance(sums, int):
                parts = [x.tobytes() for x in np.array_split(sums, PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(-PARTS, 0), pa.int32()), pa.array([fan] * PARTS, pa.int32()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.array(parts, pa.binary())], names=names)

        def add(key: tuple, parts: pa.Table) -> pa.Table:
            """Sums of the model's part over FAN_IN partitions, or of a bucket's words: these for each chunk that holds the word."""
            given, sums = parts.column("hashes").to_pylist(), parts.column("sums").to_pylist()
            if key[0].as_py() < 0:
                total = sum(np.frombuffer(x) for x in sums)
                return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.nulls(1, pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})
            counts = unpacked(b"".join(sums), states)
            word, at = np.unique(np.frombuffer(b"".join(given), "<u8"), return_inverse=True)
            total = np.stack([np.bincount(at, counts[:, s], len(word)) for s in range(states)], axis=1)
            total = np.where(total.sum(axis=1, keepdims=True) < 1.5, 0, total)[at]  # a word that stands once
            ends = np.cumsum([len(x) // 8 for x in given])
            cut = [packed(total[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            return pa.table({"part": parts.column("part"), "chunk": parts.column("chunk"), "counts": pa.array(cut, pa.binary())})

        gc.collect()  # shuffle files go with the frames that nothing holds any more
        spark.sparkContext._jvm.System.gc()
        source = held if told is None else held.join(by_chunk(told), "chunk", "left")
        sums = source.mapInArrow(expect, "part int, fan int, chunk long, hashes binary, sums binary")
        if gather:
            new = settle(sums.groupBy("part", "fan").applyInArrow(add, "part int, chunk long, counts binary"), "expected")
            totals = new.where("part < 0").select("part", F.col("counts").alias("sums"))
            if told is not None:
                discard(told)
            told = new
        else:
            totals = sums.select("part", "sums")
        got = summed(totals, "part", "sums", "<f8").collect()  # of fixed size
        del source, sums, totals
        if not got:
            return model, None
        sums = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(got)]).reshape(-1, states)
        model.update(sums)
        model.common = sums[other]
    return model, None if told is None else by_chunk(told)


def score_texts(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from the rows whose id isn't held out. A token is a word or the end of the document; a null text has
    the end alone. Unknown words count as one. Repeated rows are learnt and scored each. With nothing to learn
    from, every word is unknown and the base score is 0. A very long text is one sequence, whose likelihood is worked out token by token
    in one task. Other columns are ignored whatever their names; an
    empty table gives no rows.
    """
    counts = settle(count_words(docs.where(~left_out()).select(F.col("text").cast("string").alias("text"))), "word-counts")
    words = vocabulary(counts)
    often = filter_bits(counts.where("c > 1").select(F.xxhash64("word").alias("node")), sparse=None)
    chunks = settle_by(encode(docs, words, often), "chunk", "encoded")
    symbols = np.array([*(words.counts[w] for w in words.own), words.other_total, words.counts[b""]], float)
    model, found = fit(chunks, symbols, rounds, states)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "held_out", "row", "n_tokens", "known", "base"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            for r in row.to_pylist():
                edges = np.cumsum([d["n_tokens"] for d in r["docs"]])[:-1]
                flat = np.frombuffer(r["symbols"], "<u2")
                gains = gains_of(unpacked(r["counts"], states), shared.value.common) if r.get("counts") else None
                tails = np.split(places_of(flat, r["tail"], len(shared.value.emit) - 2), edges)
                got = shared.value.likelihood(np.split(flat, edges), tails, gains) + np.array([d["within"] for d in r["docs"]])
                yield pa.RecordBatch.from_arrays([*(pa.array([d[c] for d in r["docs"]], pa.bool_() if c == "held_out" else pa.float64() if c == "base" else pa.int64()) for c in columns), pa.array(got)], names=[*columns, "score"])

    # of each word whose count is far away: how often in which row; then what it adds to that row
    far = chunks.select(F.explode("docs").alias("d")).select("d.row", F.inline(F.arrays_zip("d.words", "d.times"))).toDF("row", "word", "times")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 1) / F.lit(float(words.total + words.distinct + 1)))
    within = F.log10((c + 1) / F.lit(float(words.other_total + words.other_distinct + 1)))
    added = far.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * base).alias("base2"), F.sum(F.col("times") * within).alias("within2")
    )
    told = F.transform("docs", lambda d: F.struct(*(d[c].alias(c) for c in [*columns, "within"]))).alias("docs")
    scored = chunks.select("chunk", told, "symbols", "tail")
    scored = scored if found is None else scored.join(found, "chunk", "left")
    forward = scored.mapInArrow(score, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, score double")
    joined = forward.join(added, "row", "left")
    zero = F.lit(0.0)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("within2", zero)).alias("score"),
    )
