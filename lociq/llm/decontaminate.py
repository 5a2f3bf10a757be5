"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

The index is a written table of postings (term, document, place) of all terms of the benchmark. Its counts order the terms of each
window of consecutive benchmark words from the rarest on. The lists of the two rarest, dealt by document and place, are intersected first,
once for all windows that share them; where they meet as far apart as in the window, the lists of its other terms, shifted by their
offsets, are intersected with what is left. All terms at their offsets are a phrase match; all of them near the rarest, in any order, a
proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import named, node_of, numbered, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCKS = 512
KEY = ["node", "one"]
#: Tables of benchmark terms or windows of up to so many rows are broadcast, larger ones joined by shuffles.
SMALL = 1 << 20
#: The posting behind the last word of each document: no word holds this character.
END, END_ID = "\x00", -1


def lowered(word: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def split_words(rows: DataFrame, text: Column, *kept: str) -> DataFrame:
    """kept columns and w: runs of digits, letters and characters beyond ASCII, as they are written; null and empty texts have none."""
    found = rows.select(*kept, F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN).alias("w"))
    blank = lambda i: (F.element_at("w", i) == "").cast("int")
    inner = F.slice("w", 1 + blank(1), F.greatest(F.size("w") - blank(1) - blank(-1), F.lit(0)))
    return found.select(*kept, inner.alias("w"))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, win: each run of n words of an item; all its words if it has fewer, but some."""
    items = split_words(benchmark, F.col("text"), "item_id").where(F.size("w") > 0)
    items = items.select("item_id", F.transform("w", lowered).alias("w"))
    last = F.greatest(F.size("w") - n, F.lit(0))
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, n))).alias("win")).distinct()


def few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has no more than SMALL rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def filter_of(keys: DataFrame) -> DataFrame:
    """One row with a Bloom filter of the 64-bit hashes in the one column of keys: BLOCKS * BLOCKS words of 64 bits, in blocks."""
    spark, (column,) = keys.sparkSession, keys.columns
    word, bit = _place(F.col(column))
    marks = keys.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("bits"))
    cells = spark.range(BLOCKS * BLOCKS).join(marks, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    in_order = lambda of: F.transform(F.array_sort(F.collect_list(F.struct("id", of))), lambda x: x[of]).alias(of)
    blocks = cells.groupBy(F.floor(F.col("id") / BLOCKS).alias("block")).agg(in_order("bits"))
    return settle(blocks.withColumnRenamed("block", "id").agg(in_order("bits")), "filter")


def _place(key: Column) -> tuple[Column, Column]:
    """Word and bit of a hash."""
    shift = 65 - (BLOCKS * BLOCKS).bit_length()
    at = F.shiftrightunsigned(key, shift - 6).bitwiseAND(63).cast("int")
    return F.shiftrightunsigned(key, shift).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at)


def may_be_in(bits: Column, key: Column) -> Column:
    word, bit = _place(key)
    return F.get(F.get(bits, F.floor(word / BLOCKS).cast("int")), word % BLOCKS).bitwiseAND(bit) != 0


def terms_of(windows: DataFrame) -> DataFrame:
    """term, id of all words of the windows, numbered. A written table."""
    return settle(windows.select(F.explode("win").alias("term")).distinct().withColumn("id", F.monotonically_increasing_id()), "benchmark-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index: node and one (128 bits that stand for a row's id and text), doc, id of a term, at: a posting for each place of
    each term. A posting with END_ID tells how many words the document has. A written table."""
    base = split_words(numbered(docs), F.col("text"), *KEY, "doc")
    spread = base.select(*KEY, "doc", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("at", "word"))
    spread = spread.select(*KEY, "doc", "at", lowered(F.col("word")).alias("term"))
    known = few(settle(terms.unionByName(docs.sparkSession.createDataFrame([(END, END_ID)], "term string, id long")), "index-terms"))
    return settle(spread.join(known, "term").select(*KEY, "doc", "id", "at"), "postings")


def lookups(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """phrase, size, by_count: each distinct window with the (df, offset, id) of its terms, from the rarest on by the counts of the index, and
    first, second: the rarest and the rarest other term (null if there is none). A window with a term that no document holds cannot occur and
    is left out. A written table."""
    counts = index.groupBy("id").agg(F.count("*").alias("df"))
    wins = windows.select("win").distinct().withColumn("phrase", F.array_join("win", " "))
    placed = wins.select("phrase", F.size("win").alias("size"), F.posexplode("win").alias("offset", "term")).join(few(terms), "term").join(counts, "id")
    of_phrase = placed.groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "id"))).alias("by_count")).where(F.size("by_count") == F.col("size"))
    first = F.col("by_count")[0]
    others = F.filter("by_count", lambda t: t["id"] != first["id"])
    return settle(of_phrase.select("phrase", "size", "by_count", first.alias("first"), F.get(others, 0).alias("second")), "benchmark-lookups")


def near_pairs(index: DataFrame, looked_up: DataFrame, n: int = WINDOW) -> DataFrame:
    """node, one, id1, id2, at1, at2: where the lists of a window's two rarest terms meet less than n places apart. Lists are dealt by document
    and by cells of n places, so neither a frequent term nor a long text gathers in a task. Of windows with one term only, id2 is null and
    at2 is at1. A written table."""
    pairs = settle(looked_up.select(F.col("first.id").alias("id1"), F.col("second.id").alias("id2")).distinct(), "term-pairs")
    cell = lambda at: F.floor(F.col(at) / n).cast("int")
    rare = index.withColumnsRenamed({"id": "id1", "at": "at1"}).drop("doc").join(few(pairs), "id1").distinct()  # of repeated rows, one
    alone = rare.where("id2 is null").select(*KEY, "id1", "id2", "at1", F.col("at1").alias("at2"))
    left = rare.where("id2 is not null").select("*", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: o + cell("at1"))).alias("cell"))
    second = few(settle(pairs.where("id2 is not null").select("id2").distinct(), "second-terms"))
    right = index.withColumnsRenamed({"id": "id2", "at": "at2"}).drop("doc").join(second, "id2").withColumn("cell", cell("at2"))
    met = left.join(right, [*KEY, "id2", "cell"]).where(F.abs(F.col("at1") - F.col("at2")) < n)
    return settle(met.select(*KEY, "id1", "id2", "at1", "at2").distinct().unionByName(alone), "term-pairs-met")


def candidates(pairs: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Where the two rarest terms of a window meet, with the window."""
    windows = few(looked_up.withColumns({"id1": F.col("first.id"), "id2": F.col("second.id")}))
    same = F.col("p.id1").eqNullSafe(F.col("w.id1")) & F.col("p.id2").eqNullSafe(F.col("w.id2"))
    return pairs.alias("p").join(windows.alias("w"), same).select(*(f"p.{c}" for c in (*KEY, "at1", "at2")), *(f"w.{c}" for c in ("phrase", "size", "by_count", "first", "second")))


def postings_near(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The postings of documents where pairs are met, and few others."""
    held = filter_of(pairs.select("node"))
    return index.where(may_be_in(held.scalar(), F.col("node"))).drop("doc")


def phrase_matches(index: DataFrame, pairs: DataFrame, looked_up: DataFrame) -> DataFrame:
    """node, one, start, size, phrase of each occurrence of a window: the lists of its terms, each shifted by its offset, are intersected from
    the two rarest on."""
    start = F.col("at1") - F.col("first.offset")
    apart = F.col("second").isNull() | (F.col("at2") - F.col("second.offset") == start)
    found = candidates(pairs, looked_up).where((start >= 0) & apart)
    rest = F.filter("by_count", lambda t: (t["offset"] != F.col("first.offset")) & ~F.coalesce(t["offset"] == F.col("second.offset"), F.lit(False)))
    found = found.select(*KEY, start.alias("start"), "size", "phrase", rest.alias("rest"))
    whole = found.where(F.size("rest") == 0).drop("rest")
    asked = found.where(F.size("rest") > 0).select(*KEY, "start", "size", "phrase", F.size("rest").alias("asked"), F.explode("rest").alias("t"))
    asked = asked.select(*KEY, "start", "size", "phrase", "asked", F.col("t.id").alias("id"), (F.col("start") + F.col("t.offset")).alias("at"))
    shifted = asked.join(postings_near(index, pairs).distinct(), [*KEY, "id", "at"]).groupBy(*KEY, "start", "size", "phrase", "asked").agg(F.countDistinct("at").alias("met"))
    return shifted.where("met = asked").drop("met", "asked").unionByName(whole).distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, looked_up: DataFrame, n: int = WINDOW) -> DataFrame:
    """node, one, phrase: all terms of a window lie within n - 1 places of its rarest, in any order."""
    others = F.array_except(F.array_distinct(F.col("by_count")["id"]), F.array("first.id", F.coalesce("second.id", "first.id")))
    found = candidates(pairs, looked_up).select(*KEY, F.col("at1").alias("middle"), "phrase", others.alias("others")).distinct()
    whole = found.where(F.size("others") == 0).select(*KEY, "phrase")
    cell = lambda at: F.floor(F.col(at) / n).cast("int")
    asked = found.where(F.size("others") > 0).select(*KEY, "middle", "phrase", F.size("others").alias("asked"), F.explode("others").alias("id"))
    asked = asked.select("*", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: o + cell("middle"))).alias("cell"))
    near = asked.join(postings_near(index, pairs).withColumn("cell", cell("at")), [*KEY, "id", "cell"]).where(F.abs(F.col("at") - F.col("middle")) < n)
    told = near.groupBy(*KEY, "middle", "phrase", "asked").agg(F.countDistinct("id").alias("met")).where("met = asked")
    return told.select(*KEY, "phrase").unionByName(whole).distinct()


def matched(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(windows, index, lookups, where their two rarest terms meet)."""
    windows = settle(benchmark_windows(benchmark, n), "benchmark-windows")
    terms = terms_of(windows)
    index = build_index(docs, terms)
    looked_up = lookups(windows, terms, index)
    return windows, index, looked_up, near_pairs(index, looked_up, n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match) for every row of docs.

    A null text has no words. Very long texts are split whole, in one task; their postings are rows like any other. Repeated rows and rows that share an id are judged each by their own text; a
    null id is an id. Items of equal text count one by one; a null item text has no windows. Empty tables
    give no rows, or rows without hits. Other columns are ignored whatever their names.
    """
    windows, index, looked_up, pairs = matched(docs, benchmark, n)
    found = settle(phrase_matches(index, pairs, looked_up), "phrase-matches")
    places = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("place")).distinct()
    n_hit = places.groupBy(KEY).agg(F.count("*").alias("n_hit"))
    phrases = windows.select(F.array_join("win", " ").alias("phrase"), F.col("item_id").cast("string").alias("item"))
    items = lambda of: of.select(*KEY, "phrase").distinct().join(phrases, "phrase").select(*KEY, "item").distinct()
    listed = items(found).groupBy(KEY).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    near = items(proximity_matches(index, pairs, looked_up, n)).groupBy(KEY).agg(F.count("*").alias("n_near"))
    hit = settle(near.join(listed, KEY, "left").join(n_hit, KEY, "left"), "hits")  # a phrase match is a proximity match
    every = index.where(F.col("id") == END_ID).select(*KEY, "doc", F.col("at").cast("long").alias("n_words"))
    joined = every.join(hit, KEY, "left")
    return joined.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs without any window of the benchmark, with the columns they came with, whatever their names. Rows are told
    apart by id and text; null ids and null or empty texts stay unless they hold a window; repeated rows stay or go together. An empty
    benchmark drops nothing. Only rows that a filter of fixed size takes for contaminated ones are shuffled."""
    _, index, looked_up, pairs = matched(docs, benchmark, n)
    bad = settle(phrase_matches(index, pairs, looked_up).select(*KEY).distinct(), "contaminated")
    held = filter_of(bad.select("node"))
    rows = docs.select(node_of(0).alias("node"), node_of(-1).alias("one"), F.struct(*named(docs.columns)).alias("row"))
    may = may_be_in(held.scalar(), F.col("node"))
    clean = rows.where(may).join(bad, KEY, "left_anti")
    return rows.where(~may).unionByName(clean).select("row.*")
