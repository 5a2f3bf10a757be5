"""Quality rules by host: how often a host's documents break each rule, shrunk towards all hosts, decides about all of them.

DataFrame functions throughout. Each document is measured where it lies; what is kept of it is a row of numbers. Failures are added
up by host, the rates of each rule are shrunk by a beta prior whose mean and strength come from the rates of all hosts, and a host
whose shrunk rate exceeds a rule's limit is rejected with all that it holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import settle

BLANK = r"\x20\x09-\x0D"
#: Lines with a word, from their start.
LINE = rf"(?<![^\n])[\x20\x09\x0B-\x0D]*+[^{BLANK}][^\n]*"
SYMBOLS = r"[#*$%&|<>]"

#: How large a share of a host's documents may break a rule.
LIMITS = {"short": 0.5, "repetitive": 0.5, "symbols": 0.5, "same_lines": 0.5, "odd_words": 0.5}
#: Bounds of the share of the variance of rates that lies between hosts.
LEAST, MOST = 1e-6, 1 - 1e-6
#: A host with more than one in so many rows counts as hot; there are fewer of these than that.
HOT_SHARE = 1000


def host_of(source: Column) -> Column:
    """The host of a URL, or else the text itself, A-Z in lower case; null counts as the empty host."""
    text = F.coalesce(source.cast("string"), F.lit(""))
    url = F.contains(text, F.lit("://"))
    return F.translate(F.when(url, F.regexp_extract(text, r"^(?s).*?://([^/?#]*)", 1)).otherwise(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows_hashed(seed: int) -> Column:
    """A 64-bit hash of each three of ``words`` in a row."""
    size = F.greatest(F.size("words") - 2, F.lit(0))
    rows = F.arrays_zip(*(F.slice("words", i + 1, size).alias(x) for i, x in enumerate("abc")))
    return F.transform(rows, lambda x: F.xxhash64(F.lit(seed), x["a"], x["b"], x["c"]))


def repeated_words(placed: Column) -> Column:
    """How many words lie in windows of three that stand twice or more, from the sorted (hash, more of it, place) of all windows of a text:
    those that equal a neighbour tell their places, and windows that overlap share words."""
    same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    both = F.filter(placed, lambda x, k: same(x, F.get(placed, k + 1)) | same(x, F.get(placed, k - 1)))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda x, i: F.struct(i.alias("last"), (x["n"] + F.least(F.lit(3), i - x["last"])).alias("n"))
    return F.coalesce(F.aggregate(F.sort_array(both["i"]), zero, step, lambda x: x["n"]), F.lit(0).cast("long"))


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host and the numbers that the rules look at, of whole texts; a null text has no words.

    Each step is a projection of its own, since an expression that is named twice would be worked out twice. Windows are told apart by
    128 bits; only texts in which two share the first 64 have them sorted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{BLANK}]+"))
    lines = F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    ids = F.col("doc_id").cast("long").alias("doc_id"), host_of(host).alias("host")
    rows = docs.select(*ids, F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), words.alias("words"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        windows_hashed(0).alias("hashes"),
    )
    several = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.arrays_zip(F.col("hashes").alias("h"), windows_hashed(1).alias("g"), F.sequence(F.lit(1), F.size("hashes")).alias("i"))
    rows = rows.select(*(c for c in rows.columns if c not in ("words", "hashes")), F.when(several, F.sort_array(placed)).alias("placed"))
    return rows.select("*", repeated_words(F.col("placed")).alias("n_repeat_words")).drop("placed")


def failures() -> dict[str, Column]:
    """rule -> whether a measured document breaks it."""
    return {
        "short": F.expr("n_words < 50"),
        "repetitive": F.expr("100 * n_repeat_words > 50 * n_words"),
        "symbols": F.expr("10 * n_symbols > n_words"),
        "same_lines": F.expr("10 * n_dup_lines > 3 * n_lines"),
        "odd_words": F.expr("word_chars < 3 * n_words or word_chars > 10 * n_words"),
    }


def host_rates(rows: DataFrame, limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """host, n (its rows), rate_<rule> (shrunk) and rejected, from rows of host and fail_<rule>.

    The prior of a rule has the mean m of all rows, and the strength that the method of moments gives: of the weighted variance of the
    hosts' rates, what sampling alone would not bring about lies between hosts, as a share r of m (1 - m); the prior then counts for
    1 / r - 1 documents. Where rates differ no more than by chance r is at its least, and all hosts have the mean."""
    sums = [F.count("*").alias("n"), *(F.sum(F.col(f"fail_{k}").cast("long")).alias(f"f_{k}") for k in limits)]
    hosts = settle(rows.groupBy("host").agg(*sums), "hosts")
    overall = [F.count("*").alias("hosts"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n") / F.lit(1.0)).alias("squares")]
    overall += [x for k in limits for x in (F.sum(f"f_{k}").alias(f"all_{k}"), F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / F.col("n")).alias(f"squares_{k}"))]
    got = hosts.agg(*overall).first()
    rates = {}
    for k in limits:
        mean, strength = prior(got["hosts"], got["all"], got["squares"], got[f"all_{k}"], got[f"squares_{k}"])
        rates[k] = (F.col(f"f_{k}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    rejected = F.lit(False)
    for k, limit in limits.items():
        rejected = rejected | (rates[k] > limit)
    return hosts.select("host", "n", *(rates[k].alias(f"rate_{k}") for k in limits), rejected.alias("rejected"))


def prior(hosts: int, rows: int | None, squares: float | None, failed: int | None, failed_squares: float | None) -> tuple[float, float]:
    """(mean, strength) of the beta prior of a rule's rates, from sums over hosts of 1, n, n^2, f and f^2 / n."""
    if not rows:
        return 0.0, 1.0
    mean = failed / rows
    spread, apart = failed_squares - mean * mean * rows, rows - squares / rows - (hosts - 1)
    share = (spread / (mean * (1 - mean)) - (hosts - 1)) / apart if 0 < mean < 1 and apart > 0 else 0.0
    share = min(max(share, LEAST), MOST)
    return mean, 1 / share - 1


def judge_by_host(docs: DataFrame, host: str = "source", limits: Mapping[str, float] = LIMITS) -> DataFrame:
    """Measures, fail_<rule> of each rule, base_failed, host_rejected and kept for every row of docs.

    A row is kept unless it is too short or repeats itself (base_failed), or its host is rejected. Every row counts for its host, repeated
    ones and those with null or empty texts (no words: too short) too; a null host is a host of its own. Very long texts are measured whole,
    in memory in proportion to the text. A table without rows gives none. Other columns are ignored whatever their names.

    Hosts with more than a thousandth of the rows, fewer than a thousand, meet their rows by broadcast; the others are joined on the
    host, so no task gets the rows of a hot one."""
    rows = measured(docs, F.col("`" + host.replace("`", "``") + "`"))
    rows = settle(rows.select("*", *(f.alias(f"fail_{k}") for k, f in failures().items())), "host-measures")
    rates = settle(host_rates(rows, limits), "host-rates")
    n = rates.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > n / HOT_SHARE
    few = F.broadcast(rates.where(hot).select("host", F.col("rejected").alias("hot_rejected")))
    some = rates.where(~hot & F.col("rejected")).select("host", F.col("rejected").alias("rare_rejected"))
    told = rows.join(few, "host", "left")
    met, rest = told.where("hot_rejected is not null"), told.where("hot_rejected is null")
    joined = met.withColumn("rare_rejected", F.lit(False)).unionByName(rest.join(some, "host", "left"))
    base = F.col("fail_short") | F.col("fail_repetitive")
    rejected = F.coalesce("hot_rejected", "rare_rejected", F.lit(False))
    return joined.select(*rows.columns, base.alias("base_failed"), rejected.alias("host_rejected"), (~base & ~rejected).alias("kept"))
