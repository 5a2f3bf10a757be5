"""Reference panels in folders: annotated LD scores, annotation and frequency files, LD pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.qc import by_prefix
from lociq.operators.hdl import PIECE
from lociq.sources.tables import read_counts, read_table, typed_scores

SCORES = re.compile(r"l2\.ldscor")


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder whose names hold a pattern, sorted; found by Spark's own file listing, so any store will do."""
    glob = spark.read.format("binaryFile").load(folder).select("path").where(F.regexp_extract("path", r"([^/]+)$", 1).rlike(pattern))
    return sorted(r["path"] for r in glob.collect())  # one row for each file of a panel


def chromosome_of(path: str) -> int | None:
    """The number that a file name begins with or holds between dots."""
    found = re.search(r"(?:^|[./_])(?:chr)?(\d{1,2})(?=\.)", "/" + path.rsplit("/", 1)[-1])
    return int(found[1]) if found else None


def base_first(folders: Sequence[str]) -> list[str]:
    """The baseline folder (its path says so) before the others."""
    return sorted(folders, key=lambda f: "baseline" not in f.lower())


def read_annotated_scores(spark: SparkSession, folders: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(CHR, SNP, BP and the annotations of all folders, for SNPs in all of them; names of the annotations)."""
    frames, names = [], []
    for folder in base_first(folders):
        parts = [typed_scores(read_table(spark, p)) for p in listed(spark, folder, SCORES.pattern)]
        df = reduce(DataFrame.unionByName, parts).drop("CM", "MAF")
        own = [c for c in df.columns if c not in ("CHR", "SNP", "BP")]
        names += own
        frames.append(df if not frames else df.select("SNP", *(f"`{c}`" for c in own)))
    return reduce(lambda a, b: a.join(b, "SNP"), frames), names


def read_annotated_counts(spark: SparkSession, folders: Sequence[str]) -> list[float]:
    """SNPs by annotation, in the order of read_annotated_scores."""
    out: list[float] = []
    for folder in base_first(folders):
        counts = read_counts(spark, listed(spark, folder, r"M_5_50$")).orderBy("pos").collect()  # one row for each annotation
        out += [r["m"] for r in counts]
    return out


def read_annotations(spark: SparkSession, folders: Sequence[str], frequencies: str | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Annotations of common SNPs. Annotation and frequency files are paired by chromosome, not by their place in a list."""
    frq = {chromosome_of(p): p for p in listed(spark, frequencies, r"\.frq")} if frequencies else {}
    frames: DataFrame | None = None
    for folder in base_first(folders):
        parts = []
        for path in listed(spark, folder, r"\.annot"):
            df = read_table(spark, path)
            keys = ("CHR", "BP", "SNP", "CM")
            df = df.select("SNP", *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in df.columns if c not in keys))
            if frequencies:
                maf = read_table(spark, frq[chromosome_of(path)]).select("SNP", F.expr("try_cast(MAF as double)").alias("MAF"))
                df = df.join(maf.where((F.col("MAF") > low) & (F.col("MAF") < high)).select("SNP").distinct(), "SNP", "left_semi")
            parts.append(df)
        own = reduce(DataFrame.unionByName, parts)
        frames = own if frames is None else frames.join(own, "SNP")
    return frames


def score_name(annotation: str, scores: Sequence[str]) -> str | None:
    """The LD-score column of an annotation: of the same name, or with L2 behind it."""
    return next((s for s in scores if s in (annotation, f"{annotation}L2")), None)


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each LD piece (columns as operators.hdl.PIECE): ``<stem>.bim`` (id in column 2, A2 in column 6), ``.ldsc``, ``.lam``
    and ``.v``, white-space numbers. A panel of R data files can't be read: convert it first."""
    names = listed(spark, folder, r"\.(bim|ldsc|lam|v|rda)$")
    if any(n.endswith(".rda") for n in names):
        raise NotImplementedError("convert the panel's .rda files to text pieces (.bim, .ldsc, .lam, .v) first")
    lines = spark.read.text(names, wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)
    files = lines.select(stem.alias("piece"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), "value")
    wide = files.groupBy("piece").pivot("kind", ["bim", "ldsc", "lam", "v"]).agg(F.first("value"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                bim = [x.split() for x in r.bim.splitlines() if x.strip()]
                numbers = [[float(x) for x in line.split()] for line in r.v.splitlines() if line.strip()]
                rows.append((r.piece, [b[1] for b in bim], [b[5] for b in bim], [float(x) for x in r.ldsc.split()], [float(x) for x in r.lam.split()], numbers))
            yield pd.DataFrame(rows, columns=["piece", "snps", "a2", "ldsc", "lam", "v"])

    return wide.mapInPandas(parse, PIECE)


def trait_names(df: DataFrame) -> list[str]:
    """The traits of a merged table, by its beta. columns."""
    return [c.removeprefix("beta.") for c in by_prefix(df.columns, "beta.")]


