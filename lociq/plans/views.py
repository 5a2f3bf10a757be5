"""Genetic tables made from the star-schema tables: the same SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = """
SELECT p_partkey AS pk, concat('rs', p_partkey) AS SNP, CAST(1 + p_partkey % 22 AS INT) AS CHR, p_partkey * 1000 + 1 AS BP,
 CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' WHEN 4 THEN 'A' ELSE 'C' END AS A1,
 CASE p_partkey % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'A' WHEN 3 THEN 'C' WHEN 4 THEN 'T' ELSE 'G' END AS A2,
 CAST(p_size % 50 + 1 AS DOUBLE) / 100 AS MAF, CAST(1 + (p_partkey * 7) % 97 AS DOUBLE) AS L2, CAST(1 + (p_partkey * 5) % 53 AS DOUBLE) AS wLD,
 CAST(p_size % 2 AS DOUBLE) AS annot1, CASE WHEN p_partkey % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS annot2
FROM {part}
"""


def trait_sql(t: int, of: int = 3) -> str:
    return f"""
SELECT concat('rs', l_partkey) AS SNP,
 CASE WHEN l_partkey % 5 = 0 THEN v.A2 WHEN l_partkey % 11 = 0 THEN lower(v.A1) WHEN l_partkey % 17 = 0 THEN 'I' ELSE v.A1 END AS A1,
 CASE WHEN l_partkey % 5 = 0 THEN v.A1 WHEN l_partkey % 11 = 0 THEN lower(v.A2) WHEN l_partkey % 17 = 0 THEN 'D' ELSE v.A2 END AS A2,
 round(avg(l_discount) - CAST(0.0501 AS DOUBLE), 8) AS EFFECT, round(CAST(0.005 AS DOUBLE) + avg(l_tax) / 10, 8) AS SE,
 CAST(1 + (l_partkey * 31 + {t} * 17) % 996 AS DOUBLE) / 997 AS P, CAST(10000 + 100 * count(*) AS DOUBLE) AS N,
 CAST(50 + l_partkey % 50 AS DOUBLE) / 100 AS INFO,
 CASE l_partkey % 4 WHEN 0 THEN '++-' WHEN 1 THEN '+?-' WHEN 2 THEN '???' ELSE '?+?' END AS DIRECTION,
 round((sum(l_quantity) / count(*) - CAST(25.5 AS DOUBLE)) / CAST(14.43 AS DOUBLE) * sqrt(CAST(count(*) AS DOUBLE)), 8) AS Z
FROM {{lineitem}} JOIN ({VARIANTS}) v ON v.pk = l_partkey WHERE l_suppkey % {of} = {t} GROUP BY l_partkey, v.A1, v.A2
"""


def twas_sql(t: int) -> str:
    return f"""
SELECT concat('/panels//', replace(p_brand, '#', '_'), '/', p_type) AS FILE, concat('gene', p_partkey) AS ID,
 CAST((p_partkey * 13 + {t} * 7) % 801 - 400 AS DOUBLE) / 100 AS `TWAS.Z`, CAST(p_size + 1 AS DOUBLE) / 100 AS HSQ,
 CAST((p_partkey + {t}) % 101 AS DOUBLE) / 100 AS `PERM.PV`, CAST(100 + p_partkey % 7 * 50 AS DOUBLE) AS `PERM.N`
FROM {{part}} WHERE p_partkey % 4 <> {t}
"""


SOURCES = ("part", "lineitem")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel grows with the tables, so joins shuffle it: a broadcast would go whole through the driver for each of them."""
    return frame(spark, sf_dir, VARIANTS).hint("merge")


def by_part(t: int, of: int = 3) -> str:
    """trait_sql() with lines summed by part before variants are joined: so neither lines nor a copy of all variants for each executor
    have to travel. A part that stands d times counts each of its lines d times, as in a plain join."""
    head, tail = trait_sql(t, of).split("FROM {lineitem}")
    for plain, summed in (("avg(l_discount)", "discount"), ("avg(l_tax)", "tax"), ("sum(l_quantity) / count(*)", "quantity / lines"), ("count(*)", "(lines * v.d)")):
        head = head.replace(plain, summed)
    lines = f"SELECT l_partkey, avg(l_discount) AS discount, avg(l_tax) AS tax, sum(l_quantity) AS quantity, count(*) AS lines FROM {{lineitem}} WHERE l_suppkey % {of} = {t} GROUP BY l_partkey"
    parts = f"SELECT pk, A1, A2, count(*) AS d FROM ({VARIANTS}) GROUP BY pk, A1, A2"
    return head.replace("SELECT", "SELECT /*+ MERGE(v) */", 1) + f"FROM ({lines}) l JOIN ({parts}) v ON v.pk = l_partkey"


def trait(spark: SparkSession, sf_dir: str, t: int) -> DataFrame:
    return frame(spark, sf_dir, by_part(t))


def planted(spark: SparkSession, sf_dir: str, t: int, of: int = 5) -> DataFrame:
    """SNP, A1, N, Z of one of ``of`` traits with heritability: to the trait's own Z comes an effect that all of them share and one of its
    own, both in proportion to the root of the LD score and drawn by a hash of the variant."""
    draw = lambda seed: (F.pmod(F.xxhash64("pk", F.lit(seed)), F.lit(2003)) / 2003 - 0.5) * 12**0.5
    rows = frame(spark, sf_dir, by_part(t, of)).join(variants(spark, sf_dir).select("SNP", "pk", "L2", F.col("A1").alias("a1_ref")), "SNP")
    effect = F.sqrt("L2") * (0.14 * draw(-1) + 0.11 * draw(t))
    return rows.select("SNP", F.col("a1_ref").alias("A1"), "N", (F.col("Z") + effect).alias("Z"))


def twas(spark: SparkSession, sf_dir: str, t: int) -> DataFrame:
    return frame(spark, sf_dir, twas_sql(t))


def duck(sql: str) -> str:
    """The text for DuckDB: plain table names, names in double quotes."""
    for t in SOURCES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("`", '"')


def with_views(query: str) -> str:
    """A DuckDB query over the views variants, trait0 to trait2, twas0, twas1."""
    named = {"variants": VARIANTS, **{f"trait{t}": trait_sql(t) for t in range(3)}, **{f"twas{t}": twas_sql(t) for t in range(2)}}
    used = {n: s for n, s in named.items() if n in query}
    if not used:
        return query
    ctes = ", ".join(f"{n} AS ({duck(s)})" for n, s in used.items())
    return f"WITH RECURSIVE {ctes}, {query.lstrip()[5:]}" if query.lstrip().upper().startswith("WITH ") else f"WITH {ctes} {query}"
