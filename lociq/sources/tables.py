"""Readers and writers of delimited tables, LD scores, annotation and matrix files."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.sources.headers import HALVES, resolve

MISSING = ("", "NA", "NaN", ".")
NUMBERS = ("EFFECT", "SE", "P", "N", "MAF", "INFO", "Z")


def delimiter(line: str) -> str:
    """Tab if the line holds one, else comma, else any white space (given as a blank)."""
    return "\t" if "\t" in line else "," if "," in line else " "


def split_quoted(line: str) -> list[str]:
    """Fields between white space; double quotes hold fields together, a backslash takes the next quote literally."""
    fields, field_, quoted, begun, i = [], [], False, False, 0
    while i < len(line):
        c = line[i]
        if c == "\\" and line[i + 1 : i + 2] == '"':
            field_.append('"')
            begun, i = True, i + 1
        elif c == '"':
            quoted, begun = not quoted, True
        elif c.isspace() and not quoted:
            if begun:
                fields.append("".join(field_))
            field_, begun = [], False
        else:
            field_.append(c)
            begun = True
        i += 1
    return fields + ["".join(field_)] * begun


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file (plain, gz or bz2), every column a string, missing tokens null.

    The first line tells the delimiter. White-space files may hold quotes and ragged rows: short rows are
    filled with nulls, blank lines skipped.
    """
    first = spark.read.text(path).head()
    sep = delimiter(first[0]) if first else ","
    if sep != " ":
        df = spark.read.csv(path, sep=sep, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        return df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))
    names = split_quoted(first[0])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f for line in batch["value"] if (f := split_quoted(line)) and f != names]
            rows = [[None if x.upper() in ("NA", "NAN", ".", "") else x for x in f[: len(names)]] + [None] * (len(names) - len(f)) for f in rows]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.text(path).mapInPandas(parse, ", ".join(f"`{c}` string" for c in names))


def canonical(df: DataFrame, required: Sequence[str] = (), overrides: dict[str, str] | None = None) -> DataFrame:
    """Canonical names for resolved columns, numbers cast (null where they are none, NaN as null), others as they were."""
    for half in HALVES:
        if half in df.columns:
            df = df.withColumn("NEFF", 2 * F.expr(f"try_cast(`{half}` as double)")).drop(half)
    found = resolve(df.columns, required, overrides)
    picked = []
    for name, header in found.items():
        column = F.col(f"`{header}`")
        if name in NUMBERS:
            number = F.expr(f"try_cast(`{header}` as double)")
            column = F.when(~F.isnan(number), number)
        picked.append(column.alias(name))
    used = set(found.values())
    return df.select(*picked, *(F.col(f"`{c}`") for c in df.columns if c not in used and c.upper() not in found))


def chromosomes(select: str | Sequence[int], last: int = 22) -> list[int]:
    """ALL, ODD, EVEN or a list, up to the last."""
    if isinstance(select, str):
        first, step = {"ALL": (1, 1), "ODD": (1, 2), "EVEN": (2, 2)}[select.upper()]
        return list(range(first, last + 1, step))
    return [c for c in select if c <= last]


def read_ld_scores(spark: SparkSession, folder: str, select: str | Sequence[int] = "ALL", last: int = 22) -> DataFrame:
    """All chromosomes' ``<chr>.l2.ldscore.gz`` in one scan of several paths, without CM and MAF."""
    paths = [f"{folder}/{c}.l2.ldscore.gz" for c in chromosomes(select, last)]
    first = spark.read.text(paths[0]).head()[0]
    sep = delimiter(first)
    names = split_quoted(first)
    if sep == " ":
        parts = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(paths).where(~F.equal_null(parts, F.lit(names)))  # every file begins with the names
        df = lines.select(*(parts[i].alias(c) for i, c in enumerate(names)))
    else:
        df = spark.read.csv(paths, sep=sep, header=True)
    return typed_scores(df).drop("CM", "MAF")


def typed_scores(df: DataFrame) -> DataFrame:
    kinds = {"CHR": "int", "BP": "bigint", "SNP": "string"}
    return df.select(*(F.expr(f"try_cast(`{c}` as {kinds.get(c, 'double')})").alias(c) for c in df.columns))


def as_weights(scores: DataFrame) -> DataFrame:
    """SNP and wLD: the last column of a table of LD scores."""
    return scores.select("SNP", F.col(f"`{scores.columns[-1]}`").alias("wLD"))


def read_counts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """pos, m: sums over files of the numbers at each position, parted by white space or commas; what is no
    number is skipped. Files of different lengths are an error."""
    lines = spark.read.text(list(paths), wholetext=True).withColumn("file", F.input_file_name())
    numbers = lines.select("file", F.posexplode(F.filter(F.split("value", r"[\s,]+"), lambda x: x != "")).alias("pos", "x")).withColumn("m", F.expr("try_cast(x as double)")).where("m is not null")
    lengths = numbers.groupBy("file").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n")).first()
    if lengths[0] != lengths[1]:
        raise ValueError("files of different numbers of columns")
    return numbers.groupBy("pos").agg(F.sum("m").alias("m"))


def total_count(spark: SparkSession, paths: Sequence[str]) -> float:
    return read_counts(spark, paths).agg(F.sum("m")).first()[0]


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """A headered numeric table; null as NaN. Matrices are small by nature: their side is the number of statistics."""
    df = read_table(spark, path)
    return df.select(*(F.expr(f"try_cast(`{c}` as double)").alias(f"c{i}") for i, c in enumerate(df.columns))).toPandas().to_numpy(float)


def read_vector(spark: SparkSession, path: str) -> np.ndarray:
    return read_matrix(spark, path)[:, 0]


def matrix_frame(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """i, j, value of a matrix; NaN as null."""
    rows = [(i, j, None if math.isnan(x) else float(x)) for (i, j), x in np.ndenumerate(np.atleast_2d(m))]
    return spark.createDataFrame(rows, "i int, j int, value double")


def write_munged(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Tab-separated, gzip; an existing table stays unless it is to be overwritten."""
    df.select("SNP", "N", "Z", "A1", "A2").write.mode("overwrite" if overwrite else "ignore").csv(path, sep="\t", header=True, compression="gzip")


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "error").csv(path, sep="\t", header=True)


def trait_file_name(traits: Sequence[str], suffix: str = "_sumstats.tsv", longest: int = 200, cut: int = 100) -> str:
    """The traits' names in a row; too long a name is cut."""
    name = "_".join(re.sub(r"\.(gz|bz2|txt|tsv|csv|sumstats)$", "", t.rsplit("/", 1)[-1]) for t in traits)
    return (name[:cut] if len(name) > longest else name) + suffix


def part_name(path: str, i: int) -> str:
    """<stem>_sub<i>.<ext>"""
    stem, dot, ext = path.rpartition(".")
    return f"{stem}_sub{i}.{ext}" if dot and "/" not in ext else f"{path}_sub{i}"


@dataclass(frozen=True)
class Covariance:
    """Genetic covariance S with sampling covariance V (of vech(S), column by column), intercepts I, sample sizes N and m."""

    names: list[str]
    S: np.ndarray
    V: np.ndarray
    I: np.ndarray  # noqa: E741
    N: np.ndarray
    m: float
    S_stand: np.ndarray | None = None
    V_stand: np.ndarray | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [("S", i, j, float(x)) for (i, j), x in np.ndenumerate(self.S)] + [("V", i, j, float(x)) for (i, j), x in np.ndenumerate(self.V)]
        return spark.createDataFrame(rows, "matrix string, i int, j int, value double")


@dataclass(frozen=True)
class StratifiedCovariance:
    """A covariance for each annotation, in total and by the annotation's own share (tau)."""

    names: list[str]
    annotations: list[str]
    S: list[np.ndarray]
    V: list[np.ndarray]
    S_tau: list[np.ndarray]
    V_tau: list[np.ndarray]
    I: np.ndarray  # noqa: E741
    N: np.ndarray
    m: list[float]
    prop: list[float]
    select: list[float] = field(default_factory=list)


def _plain(x):
    if isinstance(x, np.ndarray):
        return _plain(x.tolist())
    if isinstance(x, list):
        return [_plain(y) for y in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def _array(x):
    return None if x is None else np.array([[math.nan if z is None else z for z in y] if isinstance(y, list) else (math.nan if y is None else y) for y in x], float)


def covariance_to_json(c: Covariance) -> str:
    d = asdict(c)
    d["trait_names"] = d.pop("names")
    return json.dumps({k: _plain(v) for k, v in d.items() if v is not None})


def covariance_from_json(text: str) -> Covariance:
    d = json.loads(text)
    return Covariance(d["trait_names"], *(_array(d[k]) for k in ("S", "V", "I", "N")), d["m"], _array(d.get("S_stand")), _array(d.get("V_stand")))


def stratified_to_json(c: StratifiedCovariance) -> str:
    d = asdict(c)
    names = {"names": "trait_names", "annotations": "annotation_names", "S_tau": "S_Tau", "V_tau": "V_Tau", "prop": "Prop", "select": "Select"}
    return json.dumps({names.get(k, k): _plain(v) for k, v in d.items()})


def stratified_from_json(text: str) -> StratifiedCovariance:
    d = json.loads(text)
    lists = [[_array(m) for m in d[k]] for k in ("S", "V", "S_Tau", "V_Tau")]
    select = [0.0 if x is None else x for x in d["Select"]]
    return StratifiedCovariance(d["trait_names"], d["annotation_names"], *lists, _array(d["I"]), _array(d["N"]), d["m"], d["Prop"], select)
