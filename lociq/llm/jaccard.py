"""Jaccard self-join of word-shingle sets: a size-aware heavy-light join, and its connected components.

Sets are ordered by a global order of shingles, rare ones first (by a count sketch of fixed size over all
documents; the order decides the cost, never the result). Two sets at or above the threshold share at least c
of the first ``size - need + c`` shingles of each. Light sets, up to a boundary size, meet in subsets
of c = 2 of these; heavy ones scan the inverted lists of single shingles (c = 1), in which sets large enough to
be a heavy set's partner stand too. The boundary is where the subsets of a set begin to cost more than its lists.

Documents with equal sets are one class from the start. Within a list or subset every class is first compared
with one alone, that which has the fewest rare shingles of its own; what these links leave in different components is compared
with further members, round by round. So every link counts, and copies are never paired among themselves.

Texts and sets stay where they lie: what a step needs is told by a filter of fixed size, and only what passes it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.components import components
from lociq.llm.hashing import mixed, runs_of, word_hashes
from lociq.llm.storage import discard, matching, may_hold, named, node_of, numbered, once, repeated_nodes, settle, summed, without

SKETCH_BITS = 18
CHUNKS = 64
SLICE = 256
LARGEST_LIGHT = 200
ALL_HEADS = 64


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes, ascending, of k words in a row; of all words if there are fewer; none of none."""
    return np.unique(runs_of(words, min(k, len(words)))) if len(words) else words


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Words are runs without blanks, A-Z lower-cased: bytes.lower and bytes.split do just that."""
    return [shingles(word_hashes(t.encode().lower().split()), k) for t in texts]


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def need(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of a set of n with any partner at the threshold."""
    return -(-n * percent // 100)


def describe(base: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(node, one, two, doc, n, a, b) of each row (see numbered): the size of its set and a 128-bit hash of it; and the count sketch."""
    columns = "node long, one long, two long, doc long, n int, a long, b long, chunk int, counts binary"
    schema = pa.schema([*((c, pa.int64()) for c in ("node", "one", "two", "doc")), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                sets = shingle_sets(piece.column(4).to_pylist(), k)
                sketch += np.bincount(bucket(np.concatenate(sets)), minlength=len(sketch))
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]).reshape(-1, 2)
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns[:4], sizes, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=schema)
        if sketch.any():
            parts = [p.tobytes() for p in np.split(sketch, CHUNKS)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(CHUNKS, f.type) for f in list(schema)[:7]), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    both = settle(base.mapInArrow(measure, columns), "sets")
    total = summed(both.where("chunk is not null"), "chunk", "counts", "<i8").collect()  # of fixed size
    sketch = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(total)] or [np.zeros(1 << SKETCH_BITS, np.int64)])
    return both.where("chunk is null").drop("chunk", "counts"), sketch


def parities(s: np.ndarray) -> bytes:
    """A bit for each of m remainders of the hashes of a set, m a power of two from its size on: whether an odd number of them leaves it.
    Each shingle that one of two sets alone has turns one bit, so sets differ by as many shingles as bits at least."""
    m = 1 << max(7, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """The least number of shingles that only one of two sets has, by their parities."""
    a, b = (np.frombuffer(z, np.uint8) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefixes(base: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """node, n, first, load, parity: the first size - need + 2 shingles of each set in the global order, how many sets
    the sketch expects to meet in the lists of all but the last, and the parities of the set."""
    usual = sketch.mean()
    shared = base.sparkSession.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS counts

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                sets = shingle_sets(piece.column(1).to_pylist(), k)
                rows, loads = [], []
                for s in sets:
                    counts = shared.value[bucket(s)]
                    order = np.lexsort((s, counts))[: len(s) - need(len(s), percent) + 2]
                    rows.append(s[order].view(np.int64))
                    loads.append(float(np.maximum(counts[order[:-1]] - usual, 1).sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))
                columns = [piece.column(0), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array(loads), pa.array(map(parities, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "first", "load", "parity"])

    return base.select("node", "text").mapInArrow(first, "node long, n int, first array<long>, load double, parity binary").where("n > 0")


def boundary(first: DataFrame, percent: int) -> int:
    """The largest size whose subsets cost no more than scanning its lists, at the mean expected length of a list."""
    length = first.agg(F.sum("load") / F.sum(F.greatest(F.size("first") - 1, F.lit(1)))).first()[0] or 1.0
    size = 0
    for n in range(1, LARGEST_LIGHT + 1):
        p = n - need(n, percent) + 1
        if comb(p + 1, 2) <= p * length:
            size = n
    return size


def postings(first: DataFrame, light: int, percent: int) -> DataFrame:
    """node, n, key, left: subsets of two of light sets; single shingles of heavy sets, of those that may be a heavy
    set's partner, and of sets too small for subsets with all that may be theirs. left is the largest overlap with a set
    that shares nothing before the key in the global order."""
    tiny = max([n for n in range(1, LARGEST_LIGHT) if need(n, percent) < 2], default=0)
    reach = tiny * 100 // percent

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for n, shingle in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                s, mine, rest = shingle.values.to_numpy().view(np.uint64), [], []
                if n * 100 > light * percent or n <= reach:
                    mine.append(mixed(s[: n - need(n, percent) + 1]))
                    rest.append(n - np.arange(len(mine[-1])))
                if n <= light and need(n, percent) >= 2:
                    i, j = np.triu_indices(len(s), 1)
                    with np.errstate(over="ignore"):
                        mine.append(mixed(mixed(np.minimum(s[i], s[j])) + np.uint64(3) * np.maximum(s[i], s[j])))
                    rest.append(n - j + 1)
                found.append(np.concatenate([np.zeros(0, np.uint64), *mine]).view(np.int64))
                left.append(np.concatenate([np.zeros(0, np.int64), *rest]))
            which = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(kind)) for x, kind in ((found, "i8"), (left, "i4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *columns], names=["node", "n", "key", "left"])

    return first.mapInArrow(keys, "node long, n int, key long, left int")


def possible(n: str, m: str, left_n: str, left_m: str, percent: int) -> F.Column:
    """Whether two sets that meet first at a key can reach the threshold: near enough in size, and enough left of both."""
    overlap = F.ceil((F.col(n) + F.col(m)).cast("long") * percent / F.lit(100.0 + percent) - 1e-9)
    sizes = F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent
    return sizes & (F.least(left_n, left_m) >= overlap)


def within_bounds(pairs: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose parities don't rule them out: too many shingles that only one of the two has leave too small an overlap.
    So few but links are left to be compared whole, and a fraction of a set's size in bytes travels for the others."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            apart = np.fromiter(map(least_apart, batch.column("x").to_pylist(), batch.column("y").to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["u", "v"]).filter(pa.array(apart <= n + m - 2 * -(-(n + m) * percent // (100 + percent))))

    lists = first.where(may_hold(pairs.select(F.explode(F.array("u", "v")).alias("node")))(F.col("node")))
    side = lambda end, n, f: lists.select(F.col("node").alias(end), F.col("n").alias(n), F.col("parity").alias(f))
    both = pairs.join(side("u", "n", "x"), "u").join(side("v", "m", "y"), "v").select("u", "v", "n", "m", "x", "y")
    return both.mapInArrow(bound, "u long, v long")


def verified(base: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of a written table whose sets reach the threshold, by exact comparison of whole sets."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                sets = shingle_sets(piece.column(1).to_pylist(), k)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["node", "set"])

    # texts become sets where they lie: a text that the filter lets pass wrongly meets no pair
    compared = base.select("node", "text").where(may_hold(pairs.select(F.explode(F.array("u", "v")).alias("node")))(F.col("node")))
    sets = settle(compared.mapInArrow(tokens, "node long, set array<long>"), "sets-to-compare")
    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("t")), "v")
    with_u = with_v.join(sets.select(F.col("node").alias("u"), F.col("set").alias("s")), "u")
    common = F.size(F.array_intersect("s", "t"))
    links = settle(with_u.where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("u", "v"), "links-found")
    discard(sets)
    return links


def linked(shared: DataFrame, first: DataFrame, base: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component of all classes that links reach, from the written postings of keys that several hold.

    In each round some members of a list, its heads, are compared with all others that are in other components by then. In the first
    round it is one. Then any two members of different components include one outside the list's largest component: in each
    round that follows the heads are all of these, where they are up to ALL_HEADS, else 16, and 16 times as many each time.
    Heads then leave the list, and so do lists whose members are all in one component. A large group of near copies costs about one
    comparison each, and no pair that may link two components is left out.
    """
    parts = shared.select("*", F.col("node").alias("component"), F.lit(None).cast("long").alias("main"), F.lit(0).cast("long").alias("small"))
    links, compared, heads = None, None, 1
    while True:
        some = F.pmod(F.xxhash64(F.lit(heads), "node"), F.lit(heads))
        slot = some if heads == 1 else F.when(F.col("small") <= ALL_HEADS, F.col("node")).otherwise(some)
        before = F.struct((F.col("n") - F.col("left")).alias("before"), "node", "n", "left", "component")
        outside = parts.where(~F.equal_null("component", "main"))
        head = outside.groupBy("key", slot.alias("slot")).agg(F.min(before).alias("head"), F.count("*").alias("held"))
        head = settle(head.select("key", "head", "held"), "heads")
        far = (F.col("component") != F.col("head.component")) & possible("n", "head.n", "left", "head.left", percent)
        ends = [f("node", "head.node").alias(c) for f, c in ((F.least, "u"), (F.greatest, "v"))]
        pairs = parts.join(head, "key").where(far).select(*ends).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["u", "v"], "left_anti")
        pairs = settle(pairs, "pairs")
        near = settle(within_bounds(pairs, first, percent), "pairs-in-bounds")
        new = None if links is not None and near.isEmpty() else verified(base, near, k, percent)
        compared = pairs if compared is None else compared.union(pairs)
        more = new is not None and not new.isEmpty()
        if more or links is None:
            links = new if links is None else links.union(new)
            found = components(links)
        member = ["key", "node", "n", "left"]
        if heads == 1:  # each list has lost its one head; of two members nothing is left to compare
            rest = parts.join(head.where("held > 2"), "key").where(F.col("node") != F.col("head.node")).select(*member, "component")
        else:
            rest = parts.where(F.col("small") > ALL_HEADS).select(*member, "component").join(head.select("key", F.col("head.node").alias("node")), ["key", "node"], "left_anti")
        if more:  # a class meets its component once, however many lists it is in
            nested = rest.groupBy("node", "n").agg(F.collect_list(F.struct("key", "left")).alias("lists")).join(found, "node", "left")
            rest = nested.select("node", "n", F.coalesce("component", "node").alias("component"), F.inline("lists")).select(*member, "component")
        now = settle(rest, "members")  # without new links members stay in the components that they have
        sizes = now.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("size"))
        apart = sizes.where("size > top.c").select("key", F.col("top.component").alias("main"), (F.col("size") - F.col("top.c")).alias("small"))
        parts = settle(now.join(settle(apart, "lists-apart"), "key"), "members-apart")
        if parts.isEmpty():
            return found
        heads *= 16


def classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, int]:
    """node, n, doc, whole for every row of docs, and the seed that numbers the rows: whole is the first
    (has an id, doc, node) of all that links reach."""
    for seed in count():
        base = numbered(docs, seed)
        sets, sketch = describe(base, k)
        if (repeated := repeated_nodes(sets)) is not None:
            break
    own = F.struct(F.col("doc").isNotNull().alias("has"), "doc", "node")
    equal = settle(sets.where("n > 0").groupBy("a", "b", "n").agg(F.count("*").alias("rows"), F.min(own).alias("least")).where("rows > 1").drop("rows"), "classes")
    of_class = sets.join(equal, ["a", "b", "n"], "left").select("node", "doc", "n", F.coalesce("least", own).alias("least"))
    of_class = settle(of_class, "classes-of-rows")
    told = of_class.select("node", (F.col("node") != F.col("least.node")).alias("out"))
    base = once(base, repeated)
    first = settle(prefixes(without(base, told), sketch, k, percent), "prefixes")
    posted = settle(postings(first, boundary(first, percent), percent), "postings")
    several = settle(posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    shared = settle(matching(posted, several, ["key"]).select("key", "node", "n", "left"), "shared-postings")
    discard(posted)
    found = linked(shared, first, base, k, percent)

    heads = of_class.where(F.col("node") == F.col("least.node")).select("node", "least")
    least = heads.join(found, "node")
    wholes = settle(least.groupBy("component").agg(F.min("least").alias("whole")), "wholes")
    of_node = settle(least.join(wholes, "component").select(F.col("node").alias("class"), "whole").distinct(), "wholes-of-classes")
    rows = of_class.withColumn("class", F.col("least.node"))
    return rows.join(of_node, "class", "left").select("node", "n", "doc", F.coalesce("whole", "least").alias("whole")), seed


def similar_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """node, n, component for every row of docs: its key (doc, tie), the size of its shingle set, and the
    least key that links reach.

    Two documents link if 100 * intersection >= percent * union of their sets. A text of fewer than k words has all
    of them as its one shingle; null and empty texts have none and link with nothing. Rows with equal ids and
    texts are one document. Very long texts are hashed whole in one task, with a number for each shingle. A null id comes before all
    others. Other columns are ignored whatever their names. Empty tables give no rows.
    """
    told, _ = classes(docs, k, percent)
    return told.select(F.struct("doc", F.col("node").alias("tie")).alias("node"), "n", F.struct("whole.doc", F.col("whole.node").alias("tie")).alias("component"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with the row of the least id of each component, as similar_components tells them; columns stay as they are.

    Rows without a word (null, empty or blank texts) all stay, repeated ones too; of other rows with equal ids and texts one
    stays. A null id is the least. An empty table stays empty. Columns keep their values whatever their names.
    """
    told, seed = classes(docs, k, percent)
    told = settle(told, "told")
    inner = docs.select(node_of(seed).alias("node"), F.struct(*named(docs.columns)).alias("doc"))
    rows = without(inner, told.select("node", (F.col("node") != F.col("whole.node")).alias("out")))
    several = settle(told.where("n > 0").groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated-to-drop")
    return once(rows, several).select("doc.*")
