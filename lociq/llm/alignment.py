"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids meet in a corpus.

Texts are cut where both tokenizers always part (before blanks that follow something else), so what one such segment gives holds
wherever it stands. In a segment the owner of each byte, by ``np.repeat`` of token numbers over token sizes, is laid out for A and for
B: consecutive distinct pairs of owners are the overlaps, and places where both change at once are the cuts between groups.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.pieces import MARK, piece_codec
from lociq.llm.storage import settle

SEGMENT_STARTS = re.compile(rf"(?<=[^\s{MARK}])(?= )")
CACHED_SEGMENTS = 300_000
SHORT_SEGMENT = 14
SLICE = 64
#: How many pairs of ids, the most frequent ones, are broadcast with their counts; the others are joined.
HEAD = 1 << 20

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of each overlap, in order, and of each byte whether tokens of both begin there. The sizes add up to the same."""
    a = np.repeat(np.arange(len(a_sizes), dtype=np.int32), a_sizes)
    b = np.repeat(np.arange(len(b_sizes), dtype=np.int32), b_sizes)
    new_a, new_b = (np.diff(x, prepend=-1) != 0 for x in (a, b))
    at = new_a | new_b
    return a[at], b[at], new_a & new_b


class Aligner:
    """Both tokenizers and what short segments gave, by segment: (A tokens, B tokens, groups, pairs as bytes, groups as text), or None
    where the pieces of B don't give back its bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        added = {x["id"]: x["content"] for x in json.loads(self.a.to_str())["added_tokens"]}
        of = byte_level()
        self.a_bytes = [added[i].encode() if i in added else bytes(of[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        codec = piece_codec(b_path)
        self.b, whole = codec.plain, codec.whole
        piece = lambda i: bytes([int(whole.id_to_piece(i)[3:5], 16)]) if whole.is_byte(i) else whole.id_to_piece(i).replace(MARK, " ").encode()
        self.b_bytes = [piece(i) for i in range(whole.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        ids = [*range(len(self.a_bytes))], [*range(self.width)]
        self.told = [f"{i}{end}" for side, last in zip(ids, "|;", strict=True) for i in side for end in (",", last)]
        self.told_sizes = np.fromiter(map(len, self.told), np.int64)
        self.cache: dict[str, tuple | None] = {}

    def align(self, segments: list[str]) -> list[tuple | None]:
        """What each segment gives; all are laid out in one row of bytes."""
        a_ids = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b_ids = self.b.encode([s.replace(" ", MARK) for s in segments], num_threads=1)
        raw = [s.encode() for s in segments]
        a_at, b_at, raw_at = (np.cumsum([0, *map(len, x)]) for x in (a_ids, b_ids, raw))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n[-1]) for x, n in ((a_ids, a_at), (b_ids, b_at)))
        a_starts, b_starts = (np.concatenate([[0], np.cumsum(s)]) for s in (self.a_sizes[a], self.b_sizes[b]))
        whole = b"".join(raw)
        joined = (b"".join(map(table.__getitem__, x.tolist())) for table, x in ((self.a_bytes, a), (self.b_bytes, b)))
        if not all(x == whole for x in joined) or (a_starts[a_at] != raw_at).any() or (b_starts[b_at] != raw_at).any():
            same = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for r, x, y in zip(raw, a_ids, b_ids, strict=True)]
            good = iter(self.align([s for s, x in zip(segments, same, strict=True) if x]))
            return [next(good) if x else None for x in same]
        left, right, opened = overlaps(self.a_sizes[a], self.b_sizes[b])
        a_opens, b_opens = opened[a_starts[:-1]], opened[b_starts[:-1]]
        pairs = (a[left] * self.width + b[right]).tobytes()
        links = (np.searchsorted(left, a_at) * 8).tolist()
        a_groups, b_groups = np.cumsum(a_opens) - 1, np.cumsum(b_opens) - 1
        groups = np.concatenate([[0], np.cumsum(a_opens)])[a_at].tolist()
        # A's tokens of a group, then B's, each with the sign that follows it.
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(b_groups, a_groups)] = 2 * a + np.append(a_opens[1:], True)
        codes[np.arange(len(b)) + np.searchsorted(a_groups, b_groups, "right")] = 2 * (len(self.a_bytes) + b) + np.append(b_opens[1:], True)
        text = "".join(map(self.told.__getitem__, codes.tolist()))
        places = np.concatenate([[0], np.cumsum(self.told_sizes[codes])])[a_at + b_at].tolist()
        counts = zip(np.diff(a_at).tolist(), np.diff(b_at).tolist(), strict=True)
        return [
            (n_a, n_b, groups[i + 1] - groups[i], pairs[links[i] : links[i + 1]], text[places[i] : places[i + 1] - 1])
            for i, (n_a, n_b) in enumerate(counts)
        ]

    def __call__(self, texts: list[str | None]) -> list[list[tuple | None]]:
        """What the segments of each text give, in order; none for a null or empty text."""
        split = [SEGMENT_STARTS.split(" " + t) if t and MARK not in t else [] for t in texts]
        if len(self.cache) > CACHED_SEGMENTS:
            self.cache = {}
        known = self.cache
        new = list({s for x in split for s in x}.difference(known))
        known.update(zip(new, self.align(new) if new else [], strict=True))
        out = [list(map(known.__getitem__, x)) for x in split]
        for s in new:
            if len(s) > SHORT_SEGMENT:
                del known[s]
        return out


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, texts: bool = True) -> DataFrame:
    """row (unique in what is written of it), doc_id, n_a, n_b, n_groups, n_links, groups (their ids as text, or its sha256 in hex, empty for no
    tokens), and the distinct linked pairs (a * size of B's vocabulary + b) of each document with how often each stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                numbers, told, offsets, pairs, times = [], [], [0], [], []
                for found in both(piece.column(1).to_pylist()):
                    found = [] if None in found else found
                    n_a, n_b, n, links, groups = zip(*found) if found else ((), (), (), (), ())
                    codes, counts = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                    numbers.append((sum(n_a), sum(n_b), sum(n), int(counts.sum())))
                    told.append(";".join(groups) if texts else digest(";".join(groups)))
                    pairs.append(codes)
                    times.append(counts.astype(np.int32))
                    offsets.append(offsets[-1] + len(codes))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x))) for x in (pairs, times)]
                out = [pa.array(range(row, row + len(piece)), pa.int64()), piece.column(0), *(pa.array(x, pa.int64()) for x in zip(*numbers)), pa.array(told, pa.string()), *lists]
                row += len(piece)
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its A id stands in more), written."""
    counts = settle(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.expr(f"pair div {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most a row for each id of A
    told = counts.withColumn("a", a).join(F.broadcast(most), "a")
    return settle(told.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def head_bound(counts: DataFrame, most: int) -> int:
    """The least power of two such that no more than ``most`` pairs have a count from it on."""
    sizes = {r["size"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("pairs")).collect()}  # 64 rows at most
    total, size = 0, max(sizes, default=0) + 1
    while size > 0 and total + sizes.get(size - 1, 0) <= most:
        size -= 1
        total += sizes.get(size, 0)
    return 1 << size


def align_corpus(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, texts: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum for every row of docs.

    groups tells the ids of each group as ``a1,a2|b1;a3|b2``, or with texts=False the sha256 of that. A null or empty text, and one whose
    pieces don't give back its bytes, has no tokens: zeros and an empty text. Every row is a document of its own in the counts, repeated ones
    and those without an id too; a pair counts once for each. Very long texts are aligned segment by segment; a segment (a text
    without blanks is one) is held with a number for each of its bytes. An empty table gives no rows. Other columns are ignored whatever their names.

    The ``head`` most frequent pairs (fewer where counts are tied) are broadcast. Links to any other pair, each of which holds at most
    2 / head of all links by document, are added up by a join, by row; where all pairs are in the head there are none."""
    spark = docs.sparkSession
    rows = settle(aligned(docs, a_path, b_path, texts), "aligned")
    counts = pair_counts(rows, piece_codec(b_path).whole.get_piece_size())
    bound = head_bound(counts, head)
    table = counts.where(F.col("n") >= bound).toArrow().sort_by("pair")  # head rows at most
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    numbers = [c for c in rows.columns if c not in ("pairs", "times")]
    kinds = dict(rows.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        keys, n, best = np.append(keys, np.iinfo(np.int64).max), np.append(n, 0), np.append(best, False)
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            offsets = batch.column("pairs").offsets.to_numpy()
            offsets = offsets - offsets[0]
            at = np.searchsorted(keys, pairs)
            known = keys[at] == pairs
            by_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
            sums = [pa.array(by_row(np.where(known, x[at], 0) * times)) for x in (best, n)]
            rest = np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~known])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in numbers), *sums, *lists], names=[*numbers, "n_best", "count_sum", "pairs", "times"])

    summed = rows.mapInArrow(add, ", ".join([*(f"{c} {kinds[c]}" for c in numbers), "n_best long, count_sum long, pairs array<long>, times array<int>"]))
    if bound == 1:
        return summed.drop("row", "pairs", "times")
    summed = settle(summed, "pair-sums")
    links = summed.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rest = links.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts.where(F.col("n") < bound), "pair")
    more = rest.groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    both = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return summed.join(more, "row", "left").select(*numbers[1:], both("n_best", "more_best"), both("count_sum", "more_sum"))


def digest(groups: str) -> str:
    """sha256 of a text of groups in hex; the empty text stays empty."""
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""
