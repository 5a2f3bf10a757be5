"""Repeated passages by a sparse suffix array over the words of all documents.

Of all suffixes only those at content-selected places are kept: where the hash of SEED words is least in some
window of places. Any passage of MIN_WORDS words holds such a place, the same one wherever the
passage stands, with at least ANCHOR words of it to the right. The kept suffixes are brought in order of
their first ANCHOR words (as a hash), where equal ones are neighbours; those without an equal neighbour
are dropped. The rest are extended to the left and right: the runs of MIN_WORDS words around them are
sorted, neighbours compared, and equal runs that follow one another join to the full length of a repeat.
The result is exact: the same as if all suffixes had been kept.

Texts stay where they lie: which of them hold candidates, or passages to cut, is told by a filter of fixed size,
and only what passes it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lociq.llm.hashing import runs_of, wide_hashes, word_hashes
from lociq.llm.storage import discard, matching, may_hold, named, node_of, numbered, repeated_nodes, settle

MIN_WORDS = 50
SEED = 8
ANCHOR = 15
SLICE = 256
HOT = 4096
SALTS = 64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def selected(hashes: np.ndarray, min_words: int, seed: int, anchor: int) -> np.ndarray:
    """Places of the minimisers: least seed hash of a window of min_words - anchor + 1 places (equal hashes
    are all taken), with the anchor words still within the text."""
    window = min_words - anchor + 1  # as many as a passage of min_words words holds
    seeds = runs_of(hashes, seed)[: max(0, len(hashes) - anchor + 1)]
    if len(seeds) < window:
        return np.zeros(0, np.int64)
    least = _sliding(seeds, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(seeds == _sliding(np.concatenate([pad, least, pad]), window, np.maximum))


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over each n values in a row, by doubling."""
    size = 1
    while 2 * size <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def first_least(x: np.ndarray, n: int) -> np.ndarray:
    """For each n values in a row the place of the least, the first of equal ones."""
    at, size = np.arange(len(x)), 1
    pick = lambda a, b: np.where(x[a] <= x[b], a, b)
    while 2 * size <= n:
        at = pick(at[:-size], at[size:])
        size *= 2
    return pick(at[: len(at) - (n - size)], at[n - size :]) if n > size else at


def copies(suffixes: DataFrame) -> DataFrame:
    """node, of (has an id, doc, node): rows whose text another holds too, and which holds it first (itself for the first)."""
    ends = suffixes.groupBy("a", "b").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("a", "b")
    held = settle(suffixes.select("node", "doc", "a", "b").join(settle(ends, "repeated-texts"), ["a", "b"]), "copies")
    first = settle(held.groupBy("a", "b").agg(F.min(F.struct(F.col("doc").isNotNull().alias("has"), "doc", "node")).alias("of")), "first-copies")
    return held.join(first, ["a", "b"]).select("node", "of").distinct()


def _lists(values: list[np.ndarray], kind: str) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, kind), *values]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _nested(values: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Lists of lists: of each document the values and where its inner lists begin and end."""
    counts = [len(edges) - 1 for _, edges in values]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(edges) for _, edges in values)])
    flat = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in values)]).astype("i4")
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), inner)


def kept_suffixes(base: DataFrame, min_words: int, seed: int, anchor: int) -> DataFrame:
    """For each row its kept suffixes: node, one, two, doc (see numbered), a, b (128-bit hash of the text), n_words, prefixes (different
    hashes of the first anchor words), places (of each prefix: a text that repeats itself has many)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                hashes = [word_hashes(t.encode().split()) for t in piece.column(6).to_pylist()]  # bytes.split parts at the same characters
                places = [selected(h, min_words, seed, anchor) for h in hashes]
                prefixes = []
                for i, h in enumerate(hashes):
                    prefix = runs_of(h, anchor)[places[i]].view(np.int64)
                    order = np.argsort(prefix, kind="stable")
                    different, first = np.unique(prefix[order], return_index=True)
                    prefixes.append(different)
                    places[i] = (places[i][order], np.append(first, len(order)))
                n_words = pa.array([len(h) for h in hashes], pa.int64())
                yield pa.RecordBatch.from_arrays([*piece.columns[:6], n_words, _lists(prefixes, "i8"), _nested(places)], names=["node", "one", "two", "doc", "a", "b", "n_words", "prefixes", "places"])

    given = base.select("node", "one", "two", "doc", F.xxhash64(F.lit(-3), "text").alias("a"), F.xxhash64(F.lit(-4), "text").alias("b"), "text")
    return given.mapInArrow(keep, "node long, one long, two long, doc long, a long, b long, n_words long, prefixes array<long>, places array<array<int>>")


def with_neighbour(suffixes: DataFrame) -> DataFrame:
    """node, places of the suffixes whose prefix another shares: in order of the prefix they are neighbours.
    A place is told as -1 - place if more than HOT suffixes share the prefix. Each task counts its own
    suffixes first, so a prefix that a third of all share arrives as one row from each."""
    one = suffixes.select("node", F.inline(F.arrays_zip("prefixes", "places"))).toDF("node", "prefix", "places")
    shared = one.groupBy("prefix").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("prefix", (F.col("n") > HOT).alias("hot"))
    places = F.when(F.col("hot"), F.transform("places", lambda p: -1 - p)).otherwise(F.col("places"))
    told = matching(one, settle(shared, "shared-prefixes"), ["prefix"]).select("node", places.alias("places"))
    return told.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))  # no longer than the text


def extended(base: DataFrame, candidates: DataFrame, min_words: int, seed: int, anchor: int) -> DataFrame:
    """node, doc, run, two (128 bits of min_words words), salt, start: all runs around the candidates. Runs whose own
    minimiser has a prefix in more than HOT places get a salt above 0 by document, others 0. Which it is
    follows from the words of the run, so equal runs agree."""
    reach = min_words - anchor

    def around(places: np.ndarray, last: int) -> np.ndarray:
        near = np.zeros(last + 2, np.int64)  # 1 where a reach begins, -1 behind its end
        np.add.at(near, np.clip(places - reach, 0, last + 1), 1)
        np.add.at(near, np.clip(places + 1, 0, last + 1), -1)
        return np.cumsum(near)[: last + 1] > 0

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                starts, salts, hashed = [], [], []
                for text, told, node in zip(*(piece.column(i).to_pylist() for i in (2, 3, 0)), strict=True):
                    words = text.encode().split()  # bytes.split parts at the same characters
                    hashes, wide = word_hashes(words), wide_hashes(words)
                    told, last = np.array(told), len(hashes) - min_words
                    hot = np.zeros(len(hashes), bool)
                    hot[-1 - told[told < 0]] = True
                    own = first_least(runs_of(hashes, seed)[: len(hashes) - anchor + 1], reach + 1)
                    starts.append(np.flatnonzero(around(np.where(told < 0, -1 - told, told), last)))
                    salts.append(np.where(hot[own[starts[-1]]], 1 + node % SALTS, 0))
                    hashed.append([runs_of(h, min_words)[starts[-1]].view(np.int64) for h in wide])
                which = pa.array(np.repeat(np.arange(len(starts)), [len(x) for x in starts]))
                rest = [pa.array(np.concatenate(x).astype(kind)) for x, kind in (*((x, "i8") for x in zip(*hashed)), (salts, "i4"), (starts, "i4"))]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(which), piece.column(1).take(which), *rest], names=["node", "doc", "run", "two", "salt", "start"])

    texts = matching(base.select("node", "doc", "text"), candidates, ["node"])
    return texts.select("node", "doc", "text", "places").mapInArrow(runs, "node long, doc long, run long, two long, salt int, start int")


TOLD = "node long, doc long, start int, later boolean, of long, run long, two long, more boolean"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of rows (node, doc, run, two, salt, start) sorted by (run, two, salt, doc, node, start): node, doc, start of each
    occurrence that has another, and later, whether it isn't the first. Without a salt ``of`` tells the document of the first. With one, which
    occurrence of the run is the first is told elsewhere, and run and two come along; the first of a salted group comes out in any
    case, with ``more`` telling if it is followed."""
    schema = pa.schema([("node", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("later", pa.bool_()), ("of", pa.int64()), ("run", pa.int64()), ("two", pa.int64()), ("more", pa.bool_())])
    group, head, open_head = None, None, False  # of the rows so far: key, first occurrence, whether it is still to come out

    def heads_out(rows: list[tuple]) -> pa.RecordBatch:
        """Of (occurrence, key, more)."""
        columns = zip(*((node, doc, start, False, None, *((run, two) if salt else (None, None)), more) for (node, doc, start), (run, two, salt), more in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        node, run, two, salt, start = (batch.column(c).to_numpy() for c in (0, 2, 3, 4, 5))
        docs = batch.column(1)
        key = lambda i, run=run, two=two, salt=salt: (int(run[i]), int(two[i]), int(salt[i]))
        place = lambda i, node=node, docs=docs, start=start: (int(node[i]), docs[i].as_py(), int(start[i]))
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (two[1:] != two[:-1]) | (salt[1:] != salt[:-1])
        new[0] = group != key(0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(run)), -1))  # the head's row, -1: in an earlier batch
        first = [np.where(at >= 0, x[at], h) for x, h in zip((node, start), (head[0], head[2]) if head else (0, 0), strict=True)]
        again = ~new & ((node != first[0]) | (start != first[1]))
        rows = []
        if open_head and (again[at < 0]).any():
            rows.append((head, group, True))
            open_head = False
        elif open_head and new.any() and group[2]:
            rows.append((head, group, False))
        heads = np.flatnonzero(new)
        followed = np.zeros(len(run) + 1, bool)
        followed[at[again & (at >= 0)]] = True
        closed = heads[:-1] if len(heads) else heads
        emit = [h for h in heads.tolist() if followed[h]] + [h for h in closed.tolist() if not followed[h] and salt[h]]
        rows += [(place(h), key(h), bool(followed[h])) for h in emit]
        which = np.flatnonzero(again)
        salted = salt[which] != 0
        earlier = pa.array([head[1] if head else None], pa.int64())
        of = pa.concat_arrays([docs, earlier]).take(pa.array(np.where(at[which] >= 0, at[which], len(docs)), mask=salted))
        told = [pa.array(x[which], mask=~salted) for x in (run, two)]
        yes = pa.array(np.ones(len(which), bool))
        yield pa.RecordBatch.from_arrays([pa.array(node[which]), docs.take(pa.array(which)), pa.array(start[which]), yes, of, *told, yes], schema=schema)
        if len(heads):
            h = int(heads[-1])
            group, head, open_head = key(h), place(h), not followed[h]
        if rows:
            yield heads_out(rows)
    if open_head and group[2]:
        yield heads_out([(head, group, False)])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, anchor: int = ANCHOR) -> tuple[DataFrame, int]:
    """node, doc, n_words, whole, copy, starts, later, source for documents with repeats, and the seed that numbers the rows: whether
    the whole text stands elsewhere too, and earlier; where runs of min_words words begin that stand elsewhere too (if not
    the whole text), which of these stand earlier too (in order of doc, node and place); the least id of a document where one
    of them stands first, as (has an id, doc). Runs are told apart by 128 bits. Those of a prefix in more than HOT places are compared in
    SALTS parts, and the firsts of these with each other; the result is the same for any HOT."""
    for number in count():
        base = numbered(docs, number)
        suffixes = settle(kept_suffixes(base, min_words, seed, anchor), "suffixes")
        if repeated_nodes(suffixes) is not None:
            break
    same = settle(copies(suffixes), "copies-told")
    others = same.where("node != of.node").select("node")
    may = may_hold(others)(F.col("node"))
    own = suffixes.where(~may).unionByName(suffixes.where(may).join(others, "node", "left_anti"))
    candidates = settle(with_neighbour(own), "suffix-neighbours")
    found = extended(base, candidates, min_words, seed, anchor)
    told = found.repartition("run", "salt").sortWithinPartitions("run", "two", "salt", "doc", "node", "start")
    told = told.mapInArrow(compared, TOLD)
    salted = F.col("run").isNotNull()
    later = F.when(F.col("later"), F.col("start"))
    source = F.when(F.col("later") & ~salted, F.struct(F.col("of").isNotNull().alias("has"), F.col("of").alias("doc")))
    heads = F.when(salted & ~F.col("later"), F.struct("run", "two", "start", "more"))
    behind = F.when(salted & F.col("later"), F.struct("run", "two"))
    sure = F.when(~salted | F.col("more"), F.col("start"))
    of_doc = told.groupBy("node", "doc").agg(
        F.collect_set(sure).alias("starts"), F.collect_set(later).alias("later"), F.min(source).alias("source"), F.collect_set(heads).alias("heads"), F.collect_set(behind).alias("behind")
    )
    of_doc = settle(of_doc, "runs-told")
    discard(candidates)

    firsts = of_doc.select("node", "doc", F.inline("heads"))
    place = F.struct(F.col("doc").isNotNull().alias("has"), "doc", "node", "start")
    ends = firsts.groupBy("run", "two").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("more").alias("more"))
    ends = settle(ends.where("first != last or more"), "salted-runs")
    again = (place != F.col("first")).alias("again")
    others = firsts.join(ends.where("first != last").drop("more"), ["run", "two"]).select("node", "start", again, F.struct("first.has", "first.doc").alias("of"))
    after = of_doc.select("node", F.inline("behind")).join(ends, ["run", "two"]).select("node", F.lit(None).cast("int").alias("start"), F.lit(True).alias("again"), F.struct("first.has", "first.doc").alias("of"))
    more = others.unionByName(after).groupBy("node").agg(
        F.collect_set("start").alias("starts2"), F.collect_set(F.when(F.col("again"), F.col("start"))).alias("later2"), F.min(F.when(F.col("again"), F.col("of"))).alias("source2")
    )
    none = F.array().cast("array<int>")
    both = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)).alias(a)
    joined = of_doc.join(more, "node", "left").select("node", both("starts", "starts2"), both("later", "later2"), F.least("source", "source2").alias("source"))
    joined = settle(joined, "runs-joined")

    words = suffixes.where(F.col("n_words") >= min_words).select("node", "doc", "n_words").distinct()
    full = words.join(joined, "node", "left").join(same, "node", "left")
    copy = F.coalesce(F.col("of.node") != F.col("node"), F.lit(False))
    return full.select(
        "node",
        "doc",
        "n_words",
        F.col("of").isNotNull().alias("whole"),
        copy.alias("copy"),
        F.coalesce("starts", none).alias("starts"),
        F.coalesce("later", none).alias("later"),
        F.when(copy, F.struct("of.has", "of.doc")).otherwise(F.col("source")).alias("source"),
    ).where(F.col("whole") | (F.size("starts") > 0)), number


def cover(starts: list[int], size: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``size`` words from one of the starts."""
    marks = np.zeros(n + 1, np.int32)
    at = np.array(starts, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return np.cumsum(marks)[:n] > 0


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_repeated, n_later, first_doc_id, spans for each document with a repeated passage.

    A word is repeated if it lies in a passage of at least min_words words that stands elsewhere too, in another
    document or in the same; later, if one such passage also stands earlier (in order of doc_id, then of a hash
    of the text). first_doc_id is the least id of a document that holds one of the later passages earlier, or all of the
    text if there is one (null if none is later); spans are the repeated stretches as [begin, end) of words. Words are runs without blanks
    (space and U+0009 to U+000D). Documents without repeats are left out: null, empty and short texts always
    are. Very long texts are hashed whole, word by word, in one task, with some 60 bytes for each word. A null id comes first. Rows with equal ids and texts are one document. Other columns are ignored
    whatever their names.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, longs = [], []
            for n, whole, copy, starts, later in zip(*(c.to_pylist() for c in batch.columns[1:6]), strict=True):
                marked = [(0, n)] if whole else stretches(cover(starts, min_words, n))
                spans.append([{"begin": a, "end": b} for a, b in marked])
                longs.append((n, sum(b - a for a, b in marked), n if copy else int(cover(later, min_words, n).sum())))
            columns = [pa.array(c, pa.int64()) for c in (zip(*longs, strict=True) if longs else ((), (), ()))]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(6), pa.array(spans, kind)], names=["doc_id", "n_words", "n_repeated", "n_later", "first_doc_id", "spans"])

    found, _ = repeats(docs, min_words)
    found = found.select("doc", "n_words", "whole", "copy", "starts", "later", F.col("source.doc").alias("first"))
    return found.mapInArrow(measure, "doc_id long, n_words long, n_repeated long, n_later long, first_doc_id long, spans array<struct<begin:int,end:int>>")


def stretches(marked: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later words of their texts (see passages); ``n_chars``, if there, counts anew.

    All rows stay, and all columns, whatever their names; null, empty and short texts stay as they are. A null id
    comes first. Rows with equal ids and texts are one document, and are cut alike. An empty table stays empty.
    """
    found, seed = repeats(docs, min_words)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            cuts = [[0, n] if copy else [x for ab in stretches(cover(later, min_words, n)) for x in ab] for n, copy, later in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.int32()))], names=["node", "cuts"])

    later = found.where(F.col("copy") | (F.size("later") > 0)).select("node", "n_words", "copy", "later")
    cuts = settle(later.mapInArrow(stretch, "node long, cuts array<int>"), "cuts")
    text = F.col("text").cast("string")
    inner = docs.select(node_of(seed).alias("node"), text.alias("text"), F.struct(*named(docs.columns)).alias("row"))
    may = may_hold(cuts)(F.col("node"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                piece = batch.slice(i, SLICE)
                pairs = zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([without(text, cuts) for text, cuts in pairs], pa.string())], names=["row", "text"])

    row = inner.schema["row"].dataType
    changed = inner.where(may).join(cuts, "node", "left").select("row", "text", "cuts")
    changed = changed.mapInArrow(cut, StructType([StructField("row", row), StructField("text", StringType())]))
    both = inner.where(~may).select("row", "text").unionByName(changed)
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    kept = [F.col("row")[f.name] if f.name not in new else new[f.name].cast(f.dataType) for f in docs.schema]
    return both.select(*(c.alias(f.name) for c, f in zip(kept, docs.schema, strict=True)))


def without(text: str | None, cuts: list[int] | None) -> str | None:
    """The text without the words of some stretches, given as begin, end, begin, end ..."""
    if not cuts:
        return text
    words = list(WORD.finditer(text or ""))
    parts, last = [], 0
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        parts.append(text[last : words[a].start()])
        last = words[b].start() if b < len(words) else len(text)
    return "".join([*parts, text[last:]])
