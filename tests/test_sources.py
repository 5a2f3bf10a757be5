import bz2
import gzip

import numpy as np
import pytest

from lociq.sources import tables as T
from lociq.sources.headers import AmbiguousColumn, MissingColumn, effect_is_beta, resolve


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        path = tmp_path / name
        kind = {"gz": gzip.open, "bz2": bz2.open}.get(name.rsplit(".", 1)[-1], open)
        with kind(path, "wt") as f:
            f.write(text)
        return str(path)

    return put


def test_headers():
    assert resolve([" rsid ", "Allele1", "ALLELE2", "beta", "Pval", "ZSCORE"]) == {"SNP": " rsid ", "A1": "Allele1", "A2": "ALLELE2", "EFFECT": "beta", "P": "Pval", "Z": "ZSCORE"}
    assert resolve(["SNP", "ZSTAT"])["EFFECT"] == "ZSTAT"
    assert resolve(["SNP", "MAF2"], overrides={"MAF": "maf2"})["MAF"] == "MAF2"
    with pytest.raises(MissingColumn):
        resolve(["SNP"], required=["P"])
    with pytest.raises(AmbiguousColumn):
        resolve(["RSID", "MARKERNAME"])
    assert effect_is_beta(["snp", "Beta"]) and not effect_is_beta(["OR"])


@pytest.mark.parametrize(("name", "sep"), [("a.tsv", "\t"), ("a.csv", ","), ("a.txt", " "), ("a.tsv.gz", "\t"), ("b.csv.bz2", ","), ("c.txt.gz", "  ")])
def test_delimited(spark, write, name, sep):
    lines = [["SNP", "P", "N"], ["rs1", "0.5", "10"], ["rs2", "NA", "."], ["rs3", "1e-3", "x"]]
    path = write(name, "\n".join(sep.join(r) for r in lines) + "\n")
    df = T.canonical(T.read_table(spark, path), required=["SNP", "P"])
    assert {r.SNP: (r.P, r.N) for r in df.collect()} == {"rs1": (0.5, 10.0), "rs2": (None, None), "rs3": (0.001, None)}


def test_quoted_and_ragged(spark, write):
    path = write("q.txt", 'SNP NAME P\nrs1 "two words" .5\n\nrs2 a\\"b\nrs3 c .1 extra\n')
    got = {r.SNP: (r.NAME, r.P) for r in T.read_table(spark, path).collect()}
    assert got == {"rs1": ("two words", ".5"), "rs2": ('a"b', None), "rs3": ("c", ".1")}
    assert T.split_quoted('a "" b') == ["a", "", "b"] and T.delimiter("a,b\tc") == "\t"


def test_half_of_n(spark):
    df = spark.createDataFrame([("rs1", "5")], "SNP string, NEFFDIV2 string")
    assert T.canonical(df).first().N == 10.0


def test_ld_scores(spark, write, tmp_path):
    for c in (1, 2, 3):
        write(f"{c}.l2.ldscore.gz", f"CHR\tSNP\tBP\tCM\tMAF\tL2\n{c}\trs{c}\t{c}00\t0.1\t0.2\t1.{c}\n")
        write(f"{c}.l2.M_5_50", f"{c} {10 * c}\n")
    df = T.read_ld_scores(spark, str(tmp_path), "ODD", last=3)
    assert df.columns == ["CHR", "SNP", "BP", "L2"] and {(r.CHR, r.L2) for r in df.collect()} == {(1, 1.1), (3, 1.3)}
    assert T.as_weights(df).columns == ["SNP", "wLD"]
    paths = [f"{tmp_path}/{c}.l2.M_5_50" for c in (1, 2, 3)]
    assert {r.pos: r.m for r in T.read_counts(spark, paths).collect()} == {0: 6.0, 1: 60.0} and T.total_count(spark, paths) == 66.0
    with pytest.raises(ValueError, match="different"):
        T.read_counts(spark, [*paths, write("x.l2.M_5_50", "1\n")])
    write("4.l2.ldscore.gz", "SNP CHR BP L2\nSNP7 4 7 1.5\nrs8 4 8 2.5\n")  # an id that begins like the header
    assert {r.SNP for r in T.read_ld_scores(spark, str(tmp_path), [4]).collect()} == {"SNP7", "rs8"}
    assert T.chromosomes("EVEN", 6) == [2, 4, 6] and T.chromosomes([1, 30]) == [1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("rs1", 1.0, 2.0, "A", "G")], "SNP string, N double, Z double, A1 string, A2 string")
    T.write_munged(df, str(tmp_path / "m"))
    T.write_munged(df.union(df), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).count() == 1
    T.write_munged(df.union(df), str(tmp_path / "m"), overwrite=True)
    assert spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).count() == 2
    assert T.trait_file_name(["x/a.sumstats.gz", "b.txt"]) == "a.sumstats_b_sumstats.tsv"
    assert len(T.trait_file_name(["n" * 300])) == 100 + len("_sumstats.tsv") and T.part_name("o/r.tsv", 2) == "o/r_sub2.tsv"


def test_json_and_matrices(spark, write):
    c = T.Covariance(["a", "b"], np.array([[1, np.nan], [np.nan, 2.0]]), np.eye(3), np.eye(2), np.ones(3), 5.0)
    back = T.covariance_from_json(T.covariance_to_json(c))
    assert back.names == c.names and np.allclose(back.S, c.S, equal_nan=True) and back.S_stand is None
    s = T.StratifiedCovariance(["a"], ["x", "y"], [np.eye(1)] * 2, [np.eye(1)] * 2, [np.eye(1)] * 2, [np.eye(1)] * 2, np.eye(1), np.ones(1), [1.0, 2.0], [1.0, 0.5], [1.0, float("nan")])
    again = T.stratified_from_json(T.stratified_to_json(s))
    assert again.select == [1.0, 0.0] and np.allclose(again.V_tau[1], np.eye(1))
    m = T.read_matrix(spark, write("m.csv", "a,b\n1,NA\n3,4\n"))
    assert np.allclose(m, [[1, np.nan], [3, 4]], equal_nan=True)
    assert T.matrix_frame(spark, m).where("value is null").count() == 1 and c.frame(spark).count() == 13
