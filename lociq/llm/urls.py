"""URL filter: rules on host and path first, then gradient-boosted trees on lexical features.

DataFrame functions throughout: host and path by regular expressions, the features by string and array
functions, suffix statistics by a grouped aggregate, and the trees by Spark's own GBTClassifier. The
labelled URLs are those that a rule judges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"^(?s)(.*?)://([^/?#]*)([^?#]*)"
PRIOR_WEIGHT = 10.0

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share", "entropy", "parameters",
    "query_length", "hyphens", "fragment", "secure", "longest_label", "suffix_blocked", "suffix_rows",
)


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host (A-Z lower-cased), path; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 2), UPPER, LOWER)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(url, PARTS, 3).alias("path"))


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(text of the longest rule that fits host and path, its verdict); null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, F.lit(host + path)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def share(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text)
    some = F.array_distinct(F.split(text, ""))
    bits = F.transform(some, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(bits, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of a URL alone and its suffix, the last label of the host."""
    query = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "url_length": F.log1p(F.length("url").cast("double")),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "digit_share": share(F.col("url"), "[0-9]"),
            "host_digit_share": share(F.col("host"), "[0-9]"),
            "entropy": entropy(F.col("url")),
            "parameters": (F.regexp_count(query, F.lit("&")) + F.when(query != "", 1).otherwise(0)).cast("double"),
            "query_length": F.length(query).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "fragment": F.contains("url", F.lit("#")).cast("double"),
            "secure": F.startswith("url", F.lit("https")).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        }
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, trees: int = 12, depth: int = 4, seed: int = 11) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block for every row of pages.

    Rules win; the trees judge the rest: block where they find it likelier than not. A suffix's share of
    blocked URLs is smoothed towards the overall share and leaves out the row's own label. Null and
    malformed URLs have empty parts and are judged by their features like any other; repeated rows get equal
    verdicts. If no rule judges any row, or all that are judged agree, there is nothing to learn: the rest
    get that one verdict, or allow. Other columns are ignored whatever their names.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    text, verdict = rule_of(rules)
    judged = parts(pages).select("*", text.alias("rule"), verdict.alias("by_rule"))
    rows = settle(lexical(judged), "urls")
    label = (F.col("by_rule") == "block").cast("double")
    n, blocked = rows.agg(F.count("by_rule"), F.sum(label)).first()
    if not n or blocked in (0, n):
        rest = F.lit("block" if n and blocked == n else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", rest).alias("verdict"), F.lit(None).cast("double").alias("p_block"))

    prior = blocked / n
    of_suffix = rows.where("by_rule is not null").groupBy("suffix").agg(F.count("*").cast("double").alias("n_suffix"), F.sum(label).alias("n_blocked"))
    own = F.when(F.col("by_rule").isNull(), 0.0).otherwise(1.0)
    others = F.coalesce("n_suffix", F.lit(0.0)) - own
    full = rows.join(of_suffix, "suffix", "left").withColumns(
        {
            "suffix_blocked": (F.coalesce("n_blocked", F.lit(0.0)) - F.coalesce(label, F.lit(0.0)) + PRIOR_WEIGHT * prior) / (others + PRIOR_WEIGHT),
            "suffix_rows": F.log1p(others),
            "label": label,
        }
    )
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    vectors = vectors.select("page_id", "host", "path", "rule", "by_rule", "label", "features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(vectors.where("label is not null").select("label", "features"))
    p_block = vector_to_array(F.col("probability"))[1]
    scored = model.transform(vectors)
    verdict = F.coalesce("by_rule", F.when(p_block > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), p_block.alias("p_block"))
