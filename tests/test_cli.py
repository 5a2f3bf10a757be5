import gzip

import numpy as np
import pytest

from lociq.cli import COMMANDS, main, parser
from lociq.sources import panels
from lociq.sources import tables as T


def test_commands():
    assert len(COMMANDS) == 20 and parser().prog


def test_munge_then_regression(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 300
    (tmp_path / "ref.tsv").write_text("SNP\tA1\tA2\tMAF\n" + "".join(f"rs{i}\tA\tG\t0.3\n" for i in range(n)))
    for t in "ab":
        (tmp_path / f"{t}.txt").write_text("rsid A1 A2 beta se pval N\n" + "".join(f"rs{i} {'A G' if i % 2 else 'G A'} {rng.normal():.4f} 1 {rng.uniform(0.001, 1):.4f} 1000\n" for i in range(n)))
    ld = tmp_path / "ld"
    ld.mkdir()
    for c in (1, 2):
        with gzip.open(ld / f"{c}.l2.ldscore.gz", "wt") as f:
            f.write("CHR\tSNP\tBP\tL2\n" + "".join(f"{c}\trs{i}\t{i}\t{rng.gamma(2, 10):.3f}\n" for i in range(n) if i % 2 == c - 1))
        (ld / f"{c}.l2.M_5_50").write_text(f"{n // 2}\n")
    main(["munge", "--files", f"{tmp_path}/a.txt,{tmp_path}/b.txt", "--trait-names", "a,b", "--ref", f"{tmp_path}/ref.tsv", "--out", str(tmp_path / "m")], spark)
    main(["ldsc", "--files", f"{tmp_path}/m/a.sumstats,{tmp_path}/m/b.sumstats", "--trait-names", "a,b", "--ld", str(ld), "--chr", "2", "--n-blocks", "20", "--out", str(tmp_path / "cov")], spark)
    c = T.covariance_from_json(spark.read.text(str(tmp_path / "cov"), wholetext=True).where("value <> ''").first()[0])
    assert c.names == ["a", "b"] and np.isfinite(c.S).all() and c.V.shape == (3, 3) and c.m == n
    main(["index-s", "--covstruc", str(tmp_path / "cov"), "--out", str(tmp_path / "ix")], spark)
    assert spark.read.csv(str(tmp_path / "ix"), sep="\t", header=True).count() == 3
    main(["sumstats", "--files", f"{tmp_path}/a.txt,{tmp_path}/b.txt", "--trait-names", "a,b", "--kinds", "ols,se_logit", "--ref", f"{tmp_path}/ref.tsv", "--out", str(tmp_path / "s")], spark)
    assert spark.read.csv(str(tmp_path / "s"), sep="\t", header=True).count() > 0
    both = ["sumstats", "--files", f"{tmp_path}/a.txt,{tmp_path}/b.txt", "--kinds", "ols,se_logit", "--ref", f"{tmp_path}/ref.tsv"]
    main([*both, "--trait-names", "a,b", "--out", f"{tmp_path}/named/"], spark)
    assert spark.read.csv(str(tmp_path / "named/a_b_sumstats.tsv"), sep="\t", header=True).count() > 0
    with pytest.raises(ValueError, match="2 files, but 1 values of --trait-names"):
        main([*both, "--trait-names", "a", "--out", f"{tmp_path}/x"], spark)
    with pytest.raises(ValueError, match="maf"):
        main([*both, "--trait-names", "a,b", "--maf", "0.7", "--out", f"{tmp_path}/x"], spark)
    main(["commonfactor", "--covstruc", str(tmp_path / "cov"), "--no-cfi-calc", "--toler", "1e-12", "--out", str(tmp_path / "cf")], spark)
    assert spark.read.csv(str(tmp_path / "cf"), sep="\t", header=True).count() == 5


def test_parallel_analysis_writes_its_variants(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a b c\n1 .4 .3\n.4 1 .2\n.3 .2 1\n")
    (tmp_path / "v.txt").write_text("a b c d e f\n" + "\n".join(" ".join("0.01" if i == j else "0.001" for j in range(6)) for i in range(6)) + "\n")
    main(["pa-ldsc", "--s", f"{tmp_path}/s.txt", "--v", f"{tmp_path}/v.txt", "--r", "20", "--diag", "--fa", "--out", f"{tmp_path}/pa.tsv"], spark)
    for name in ("pa", "pa_diag", "pa_fa", "pa_fa_diag"):
        got = spark.read.csv(f"{tmp_path}/{name}.tsv", sep="\t", header=True)
        assert got.count() == 3 and {"Observed", "Parallel"} <= set(got.columns)


def test_panels(spark, tmp_path):
    base, extra, frq = (tmp_path / x for x in ("baseline", "extra", "frq"))
    for d in (base, extra, frq):
        d.mkdir()
    for c in (1, 2, 10):
        (base / f"b.{c}.l2.ldscore").write_text(f"CHR\tSNP\tBP\tbaseL2\tcodingL2\n{c}\trs{c}\t1\t2\t3\n")
        (base / f"b.{c}.l2.M_5_50").write_text("5 6\n")
        (base / f"b.{c}.annot").write_text(f"CHR\tBP\tSNP\tCM\tbase\tcoding\n{c}\t1\trs{c}\t0\t1\t{c % 2}\n")
        (extra / f"x.{c}.l2.ldscore").write_text(f"CHR\tSNP\tBP\tmoreL2\n{c}\trs{c}\t1\t4\n")
        (extra / f"x.{c}.l2.M_5_50").write_text("7\n")
        (frq / f"f.{c}.frq").write_text(f"SNP\tMAF\nrs{c}\t{0.01 if c == 2 else 0.2}\n")
    scores, names = panels.read_annotated_scores(spark, [str(extra), str(base)])
    assert names == ["baseL2", "codingL2", "moreL2"] and scores.count() == 3
    assert panels.read_annotated_counts(spark, [str(extra), str(base)]) == [15.0, 18.0, 21.0]
    annot = panels.read_annotations(spark, [str(base)], str(frq))
    assert {r.SNP for r in annot.collect()} == {"rs1", "rs10"}
    assert panels.score_name("coding", names) == "codingL2" and panels.chromosome_of("a/b.10.annot.gz") == 10


def test_pieces(spark, tmp_path):
    for p in ("p1", "p2"):
        (tmp_path / f"{p}.bim").write_text(f"1 {p}a 0 1 A G\n1 {p}b 0 2 C T\n")
        (tmp_path / f"{p}.ldsc").write_text("1.5\n2.5\n")
        (tmp_path / f"{p}.lam").write_text("2 1\n")
        (tmp_path / f"{p}.v").write_text("1 0\n0 1\n")
    got = {r.piece: r for r in panels.read_pieces(spark, str(tmp_path)).collect()}
    assert set(got) == {"p1", "p2"} and got["p1"].snps == ["p1a", "p1b"] and got["p2"].a2 == ["G", "T"] and got["p1"].v == [[1, 0], [0, 1]] and got["p1"].ldsc == [1.5, 2.5]
    (tmp_path / "x.rda").write_text("R")
    with pytest.raises(NotImplementedError):
        panels.read_pieces(spark, str(tmp_path))
