"""Commands over files: each reads its tables, calls one operator and writes what it returns."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lociq.functions import qc
from lociq.operators import clean, gwas, hdl, ldsc, posthoc, simulate, stratified, twas
from lociq.operators.enrich import base_results, enrich
from lociq.operators.qtrait import Limits, qtrait
from lociq.operators.sem import models
from lociq.sources import panels
from lociq.sources import tables as T

Command = Callable[[SparkSession, argparse.Namespace], None]
COMMANDS: dict[str, tuple[Command, Sequence[tuple[str, dict]]]] = {}


def command(name: str, *arguments: tuple[str, dict]) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = (f, arguments)
        return f

    return add


def many(kind: type = str) -> Callable[[str], list]:
    """A comma-separated list; NA is None."""
    return lambda text: [None if x.strip() in ("NA", "") else kind(x) for x in text.split(",")]


def arg(name: str, kind=str, default=None, required: bool = False) -> tuple[str, dict]:
    if kind is bool:
        return f"--{name}", {"action": argparse.BooleanOptionalAction, "default": default}
    return f"--{name}", {"type": kind, "default": default, "required": required}


FILES, NAMES, OUT = arg("files", many(), required=True), arg("trait-names", many(), required=True), arg("out", required=True)
COV = arg("covstruc", required=True)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()[0]


def _put(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _table(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    return T.canonical(T.read_table(spark, path), required)


def _numbers(df: DataFrame, *columns: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns if c in df.columns})


def _covariance(spark: SparkSession, path: str) -> T.Covariance:
    return T.covariance_from_json(_text(spark, path))


def _together(a: argparse.Namespace, *options: str) -> Iterator[tuple]:
    """The values of several options side by side; those not given are None throughout. Unequal numbers of values are an error."""
    n = len(a.files)
    for option in options:
        given = getattr(a, option)
        if given and len(given) != n:
            raise ValueError(f"{n} files, but {len(given)} values of --{option.replace('_', '-')}")
    return zip(a.files, *(getattr(a, option) or [None] * n for option in options), strict=True)


def _within(option: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"--{option} lies between {low} and {high}, not at {value}")


def _prevalences(a: argparse.Namespace) -> list[ldsc.Prevalence]:
    sample, population = a.sample_prev or [], a.population_prev or []
    pad = lambda x: [*x, *[None] * (len(a.trait_names) - len(x))]
    return [ldsc.Prevalence(s, p) for s, p in zip(pad(sample), pad(population), strict=True)]


PREVALENCE = (arg("sample-prev", many(float)), arg("population-prev", many(float)))


@command("munge", FILES, NAMES, OUT, arg("ref", required=True), arg("n", many(float)), arg("info", float, 0.9), arg("maf", float, 0.01), arg("overwrite", bool, False), arg("report", bool, False))
def _munge(spark, a):
    ref = _table(spark, a.ref, ["SNP", "A1", "A2"])
    _within("info", a.info, 0, 2)
    _within("maf", a.maf, 0, 0.5)
    for path, name, n in _together(a, "trait_names", "n"):
        steps = clean.munge_steps(_table(spark, path, ["SNP", "A1", "A2", "EFFECT", "P"]), ref, n, a.info, a.maf)
        T.write_munged(steps[-1][1], f"{a.out}/{name}.sumstats", a.overwrite)
        if a.report:
            bad = spark.createDataFrame([("p_outside_0_1", qc.implausible_p(steps[0][1]), 0)], "step string, rows long, removed long")
            T.write_table(clean.removal_report(steps).union(bad), f"{a.out}/{name}.report")


@command("sumstats", FILES, NAMES, OUT, arg("ref", required=True), arg("kinds", many(), required=True), arg("n", many(float)), arg("info", float, 0.6), arg("maf", float, 0.01), arg("keep-indel", bool, False), arg("ambig", bool, True), arg("direct-filter", bool, False), arg("report", bool, False))
def _sumstats(spark, a):
    from lociq.sources.headers import effect_is_beta

    _within("info", a.info, 0, 2)
    _within("maf", a.maf, 0, 0.5)
    panel = _table(spark, a.ref, ["SNP", "A1", "A2", "MAF"])
    traits = []
    for path, name, kind, n in _together(a, "trait_names", "kinds", "n"):
        raw = T.read_table(spark, path)
        traits.append(clean.Trait(name, T.canonical(raw, ["SNP", "A1", "A2", "EFFECT", "P"]), kind, n, effect_is_beta(raw.columns)))
    merged = clean.merge_traits(traits, panel, a.maf, a.info, a.keep_indel, a.ambig, a.direct_filter)
    out = a.out + T.trait_file_name(a.trait_names) if a.out.endswith("/") else a.out  # a folder: the traits' names tell the file's
    T.write_table(merged, out)
    if a.report:
        T.write_table(clean.effects_report(merged, a.trait_names), f"{out}.report")


@command("ldsc", FILES, NAMES, OUT, arg("ld", required=True), arg("wld"), arg("chr", int, 22), arg("select", str, "ALL"), arg("n-blocks", int, 200), arg("chisq-max", float), arg("stand", bool, False), arg("order", str, "place"), *PREVALENCE)
def _ldsc(spark, a):
    chosen = a.select if a.select.isalpha() else many(int)(a.select)
    scores = T.read_ld_scores(spark, a.ld, chosen, a.chr)
    weights = T.as_weights(T.read_ld_scores(spark, a.wld, chosen, a.chr) if a.wld else scores)
    m = T.total_count(spark, [f"{a.ld}/{c}.l2.M_5_50" for c in T.chromosomes(chosen, a.chr)])
    c, _ = ldsc.ldsc([_table(spark, f, ["SNP", "N", "Z", "A1"]) for f in a.files], scores, weights, m, a.trait_names, _prevalences(a), a.n_blocks, a.chisq_max, stand=a.stand, order=a.order)
    _put(spark, a.out, T.covariance_to_json(c))


@command("s-ldsc", FILES, NAMES, OUT, arg("ld", many(), required=True), arg("wld", required=True), arg("annot", many(), required=True), arg("frq"), arg("n-blocks", int, 200), arg("exclude-cont", bool, True), *PREVALENCE)
def _s_ldsc(spark, a):
    scores, names = panels.read_annotated_scores(spark, a.ld)
    m = dict(zip(names, panels.read_annotated_counts(spark, a.ld), strict=True))
    annot = panels.read_annotations(spark, a.annot, a.frq)
    columns = {s: x for x in annot.columns if x != "SNP" and (s := panels.score_name(x, names))}
    kept = [n for n in names if n in columns]
    if a.exclude_cont:
        dropped = set(stratified.continuous(annot, [columns[n] for n in kept]))
        kept = [n for n in kept if columns[n] not in dropped]
    overlaps = stratified.overlap(annot, [columns[n] for n in kept])
    weights = T.as_weights(T.read_ld_scores(spark, a.wld))
    c = stratified.s_ldsc([_table(spark, f, ["SNP", "N", "Z", "A1"]) for f in a.files], scores, kept, weights, [m[n] for n in kept], overlaps, a.trait_names, _prevalences(a), a.n_blocks)
    _put(spark, a.out, T.stratified_to_json(c))


@command("enrich", COV, OUT, arg("model", required=True), arg("params", many(), required=True), arg("fix", str, "regressions"), arg("fixparam", many(), []), arg("tau", bool, False), arg("std-lv", bool, False), arg("rm-flank", bool, True), arg("base", bool, False))
def _enrich(spark, a):
    c = T.stratified_from_json(_text(spark, a.covstruc))
    T.write_table(enrich(spark, c, _text(spark, a.model), a.params, a.fix, a.fixparam, a.tau, a.std_lv, a.rm_flank), a.out)
    if a.base:
        T.write_table(base_results(spark, c, _text(spark, a.model), a.params, a.fix, a.fixparam, a.tau, a.std_lv), T.part_name(a.out, 0))


def _snps(spark, a):
    df = T.read_table(spark, a.snps)
    return _numbers(df, "MAF", "HSQ", *(x for x in df.columns if x.startswith(("beta.", "se."))))


GWAS = (COV, OUT, arg("snps", required=True), arg("estimation", str, "DWLS"), arg("gc", str, "standard"), arg("snp-se", float, 0.0005), arg("toler", float))


@command("commonfactor-gwas", *GWAS)
def _common_gwas(spark, a):
    options = gwas.Options(a.estimation, a.gc, a.snp_se, sub=("F1~SNP",), q_snp=True, fix_measurement=False, toler=a.toler)
    T.write_table(gwas.common_factor_gwas(_snps(spark, a), _covariance(spark, a.covstruc), options), a.out)


@command("user-gwas", *GWAS, arg("model", required=True), arg("sub", many(), []), arg("std-lv", bool, False), arg("fix-measurement", bool, True), arg("q-snp", bool, False))
def _user_gwas(spark, a):
    options = gwas.Options(a.estimation, a.gc, a.snp_se, a.std_lv, a.fix_measurement, a.q_snp, tuple(x.replace(" ", "") for x in a.sub), toler=a.toler)
    out = gwas.user_gwas(_snps(spark, a), _covariance(spark, a.covstruc), _text(spark, a.model), options)
    if options.sub:
        for i, (_, part) in enumerate(gwas.by_parameter(out, options.sub).items(), 1):
            T.write_table(part, T.part_name(a.out, i))
    else:
        T.write_table(out, a.out)


@command("commonfactor", COV, OUT, arg("estimation", str, "DWLS"), arg("cfi-calc", bool, True), arg("toler", float))
def _common_factor(spark, a):
    got = models.common_factor(_covariance(spark, a.covstruc), a.estimation, a.toler)
    parameters, stats = models.result_frames(spark, got, a.estimation, a.cfi_calc)
    T.write_table(parameters, a.out)
    T.write_table(stats, T.part_name(a.out, 0))


@command("usermodel", COV, OUT, arg("model", required=True), arg("estimation", str, "DWLS"), arg("std-lv", bool, False), arg("cfi-calc", bool, True), arg("toler", float))
def _user_model(spark, a):
    got = models.user_model(_covariance(spark, a.covstruc), _text(spark, a.model), a.estimation, a.std_lv, a.toler)
    parameters, stats = models.result_frames(spark, got, a.estimation, a.cfi_calc)
    T.write_table(parameters, a.out)
    T.write_table(stats, T.part_name(a.out, 0))


@command("rgmodel", COV, OUT, arg("estimation", str, "DWLS"))
def _rgmodel(spark, a):
    R, V = models.genetic_correlations(_covariance(spark, a.covstruc), a.estimation)
    T.write_table(T.matrix_frame(spark, R), a.out)
    T.write_table(T.matrix_frame(spark, V), T.part_name(a.out, 0))


@command("read-fusion", FILES, NAMES, OUT, arg("n", many(float), required=True), arg("binary", many(), required=True), arg("perm", bool, False))
def _fusion(spark, a):
    tables = [_numbers(T.read_table(spark, f), "TWAS.Z", "HSQ", "PERM.PV", "PERM.N") for f in a.files]
    T.write_table(twas.read_fusion(tables, a.trait_names, a.n, [x.lower() == "true" for x in a.binary], a.perm), a.out)


@command("hdl", FILES, NAMES, OUT, arg("ld", required=True), arg("n-ref", float, 335_265.0), arg("method", str, "piecewise"), *PREVALENCE)
def _hdl(spark, a):
    traits = [hdl.load_gwas(_numbers(T.read_table(spark, f), "N", "Z", "b", "se")) for f in a.files]
    _put(spark, a.out, T.covariance_to_json(hdl.hdl(panels.read_pieces(spark, a.ld), traits, a.trait_names, a.n_ref, _prevalences(a), a.method)))


@command("pa-ldsc", OUT, arg("s", required=True), arg("v", required=True), arg("r", int, 500), arg("p", float, 0.95), arg("diag", bool, False), arg("fa", bool, False), arg("nfactors", int, 1), arg("seed", int, 1))
def _pa(spark, a):
    stem, dot, ext = a.out.rpartition(".") if "." in a.out.rsplit("/", 1)[-1] else (a.out, "", "")
    for fa in (False, True)[: 1 + a.fa]:
        for diag in (False, True)[: 1 + a.diag]:
            out, _ = posthoc.parallel_analysis(spark, T.read_matrix(spark, a.s), T.read_matrix(spark, a.v), a.r, a.p, a.seed, diag, fa, a.nfactors)
            told = out.orderBy("rank").coalesce(1).withColumnsRenamed({"observed": "Observed", "parallel": "Parallel"})  # one row for each trait
            T.write_table(told, stem + "_fa" * fa + "_diag" * diag + dot + ext)


@command("index-s", COV, OUT, arg("include-diag", bool, True))
def _index(spark, a):
    T.write_table(posthoc.index_s(spark, _covariance(spark, a.covstruc).names, a.include_diag), a.out)


@command("sub-sv", COV, OUT, arg("places", many(int), required=True), arg("ty", str, "S"))
def _sub(spark, a):
    values, V = posthoc.sub_sv(_covariance(spark, a.covstruc), a.places, a.ty)
    T.write_table(T.matrix_frame(spark, values[:, None]), a.out)
    T.write_table(T.matrix_frame(spark, V), T.part_name(a.out, 0))


@command("summary-gls", OUT, arg("y", required=True), arg("v", required=True), arg("predictors", required=True), arg("intercept", bool, True))
def _gls(spark, a):
    got = posthoc.summary_gls(T.read_vector(spark, a.y), T.read_matrix(spark, a.v), T.read_matrix(spark, a.predictors), a.intercept)
    T.write_table(spark.createDataFrame(got), a.out)


@command("summary-gls-bands", OUT, arg("y", required=True), arg("v", required=True), arg("predictor", required=True), arg("controls"), arg("intervals", int, 20), arg("band-size", float, 1.0), arg("quad", bool, False), arg("xcoords", many(float)))
def _bands(spark, a):
    controls = T.read_matrix(spark, a.controls) if a.controls else None
    got = posthoc.gls_bands(T.read_vector(spark, a.y), T.read_matrix(spark, a.v), T.read_vector(spark, a.predictor), controls, a.intervals, a.band_size, a.quad, tuple(a.xcoords) if a.xcoords else None)
    T.write_table(spark.createDataFrame(got), a.out)


@command("local-srmd", OUT, *(arg(x, required=True) for x in ("unconstrained", "constrained", "sd-left", "sd-right")))
def _srmd(spark, a):
    u, c, left, right = (T.read_vector(spark, x) for x in (a.unconstrained, a.constrained, a.sd_left, a.sd_right))
    pooled = [np.full(len(u), np.sqrt(np.mean(x**2))) for x in (left, right)]
    rows = pd.DataFrame({"unconstrained": u, "constrained": c, "sd_left": pooled[0], "sd_right": pooled[1]})
    T.write_table(posthoc.local_srmd(spark.createDataFrame(rows)), a.out)


@command("sim-ldsc", COV, OUT, arg("ld", required=True), arg("n", many(float), required=True), arg("n-overlap", float, 0.99), arg("r", int, 1), arg("seed", int, 1234))
def _sim(spark, a):
    from lociq.functions.qc import outside_mhc

    c = _covariance(spark, a.covstruc)
    rows = simulate.simulate(outside_mhc(T.read_ld_scores(spark, a.ld)), c.S, np.array(a.n), c.m, a.n_overlap, replicates=a.r, seed=a.seed)
    rows.write.mode("overwrite").partitionBy("iter", "trait").csv(a.out, sep="\t", header=True, compression="gzip")


@command("q-trait", COV, OUT, arg("indicators", many(), required=True), arg("traits", many(), required=True), arg("mresid", float, 0.25), arg("mresid-threshold", float, 0.10), arg("lsrmr", float, 0.25), arg("lsrmr-threshold", float, 0.10))
def _qtrait(spark, a):
    limits = Limits(a.mresid, a.mresid_threshold, a.lsrmr, a.lsrmr_threshold)
    T.write_table(qtrait(spark, _covariance(spark, a.covstruc), a.indicators, a.traits, limits), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m lociq.cli")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        one = sub.add_parser(name)
        for flag, options in arguments:
            one.add_argument(flag, **options)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName(f"lociq {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
