"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lociq.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.sharding import cut_shards, shuffle_records

    text = F.coalesce("text", F.lit(""))
    shuffled = shuffle_records(table(spark, sf_dir, "documents"))
    digest = shuffled.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *shuffled.columns[-2:]
    )
    return cut_shards(digest, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.suffixes import passages

    return passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated", "n_later", "first_doc_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.jaccard import similar_components

    found = similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select(F.col("node.doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component.doc").alias("component_id"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lociq.llm.pieces import encode_pieces

    got = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("spanned_bytes"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.fill_middle import fill_in_middle, restored

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    got = fill_in_middle(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lociq.llm.alignment import align_corpus

    found = align_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), texts=False)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociq.llm.host_rules import judge_by_host

    found = judge_by_host(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_shards": op4_shards,
    "op5_passages": op5_passages,
    "op6_ann": op6_ann,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard": op8_jaccard,
    "op9_hmm": op9_hmm,
    "op10_pieces": op10_pieces,
    "op11_fill_middle": op11_fill_middle,
    "op12_alignment": op12_alignment,
    "op13_host_rules": op13_host_rules,
}

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
 FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
gram AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
 FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)),
hit AS (SELECT DISTINCT g.doc_id, g.i, g.k, w.item_id FROM gram g JOIN win w ON g.phrase = w.phrase AND g.k = w.k),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
terms AS (SELECT phrase, k, unnest(string_split(phrase, ' ')) AS term, unnest(generate_series(0, k - 1)) AS o FROM (SELECT DISTINCT phrase, k FROM win)),
rarest AS (SELECT phrase, term FROM (SELECT phrase, k, term, count(*) OVER (PARTITION BY phrase) AS held, row_number() OVER (PARTITION BY phrase ORDER BY df, o, term) AS r FROM terms JOIN df USING (term)) WHERE r = 1 AND held = k),
met AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, phrase, w[greatest(i - 9, 1):i + 9] AS near FROM (SELECT doc_id, w, unnest(w) AS term, unnest(generate_series(1, len(w))) AS i FROM d) JOIN rarest USING (term)) WHERE list_has_all(near, string_split(phrase, ' '))),
nearby AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item_id::VARCHAR FROM met JOIN win USING (phrase)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
 coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""

PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
run AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS r FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
told AS (SELECT *, count(*) OVER (PARTITION BY r) AS n, first_value(doc_id) OVER (PARTITION BY r ORDER BY doc_id, i) AS f, row_number() OVER (PARTITION BY r ORDER BY doc_id, i) AS k FROM run),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeated FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS p FROM told WHERE n > 1) GROUP BY doc_id),
lat AS (SELECT doc_id, count(DISTINCT p) AS n_later, min(f) AS f FROM (SELECT doc_id, f, unnest(generate_series(i, i + 49)) AS p FROM told WHERE k > 1) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, n_repeated::BIGINT AS n_repeated, coalesce(n_later, 0)::BIGINT AS n_later, CASE WHEN whole < doc_id THEN whole ELSE f END AS first_doc_id
FROM d JOIN rep USING (doc_id) LEFT JOIN lat USING (doc_id) JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS whole FROM documents) USING (doc_id)
"""


JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

HOST_RULES = r"""
WITH d AS (SELECT doc_id, CASE WHEN source LIKE '%://%' THEN regexp_extract(source, '^(?s).*?://([^/?#]*)', 1) ELSE coalesce(source, '') END AS h, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM p))),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS x(o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS same_lines,
 word_chars < 3 * n_words OR word_chars > 10 * n_words AS odd_words FROM m),
by_rule AS (SELECT host, count(*)::DOUBLE AS n, rule, sum(broken::INT)::DOUBLE AS f
 FROM (SELECT host, unnest(['short', 'repetitive', 'symbols', 'same_lines', 'odd_words']) AS rule, unnest([short, repetitive, symbols, same_lines, odd_words]) AS broken FROM f) GROUP BY host, rule),
overall AS (SELECT rule, count(*) AS hosts, sum(n) AS n, sum(n * n) AS squares, sum(f) / sum(n) AS mean, sum(f * f / n) AS failed_squares FROM by_rule GROUP BY rule),
share AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND n - squares / n - (hosts - 1) > 0
 THEN ((failed_squares - mean * mean * n) / (mean * (1 - mean)) - (hosts - 1)) / (n - squares / n - (hosts - 1)) ELSE 0 END AS x FROM overall),
prior AS (SELECT rule, mean, 1 / least(greatest(x, 1e-6), 1 - 1e-6) - 1 AS strength FROM share),
verdict AS (SELECT host, bool_or((f + mean * strength) / (n + strength) > 0.5) AS rejected FROM by_rule JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive OR rejected) AS kept FROM f JOIN verdict USING (host)
"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS s FROM documents),
h AS (SELECT *, len(w)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, t, array_to_string(w[1:x], '') AS a, array_to_string(w[x + 1:y], '') AS b, array_to_string(w[y + 1:], '') AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

SQL: dict[str, str] = {"op11_fill_middle": FILL_MIDDLE, "op13_host_rules": HOST_RULES, "op8_jaccard": JACCARD, "op5_passages": PASSAGES, "op7_decontaminate": DECONTAMINATE}
