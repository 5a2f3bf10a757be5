"""Header names of summary statistics: synonyms to canonical names, in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Accepted header names, upper case.
SYNONYMS = {
    "SNP": "SNP SNPID RSID RS_NUMBER RS_NUMBERS MARKERNAME ID PREDICTOR SNP_ID VARIANTID VARIANT_ID RSIDS RS_ID",
    "A1": "A1 ALLELE1 EFFECT_ALLELE INC_ALLELE REFERENCE_ALLELE EA REF",
    "A2": "A2 ALLELE2 ALLELE0 OTHER_ALLELE NON_EFFECT_ALLELE DEC_ALLELE OA NEA ALT A0",
    "Z": "Z ZSCORE Z-SCORE ZSTATISTIC ZSTAT Z-STATISTIC",
    "EFFECT": "OR B BETA LOG_ODDS EFFECTS EFFECT SIGNED_SUMSTAT EST BETA1 LOGOR",
    "INFO": "INFO IMPINFO",
    "P": "P PVALUE PVAL P_VALUE P-VALUE P.VALUE P_VAL GC_PVALUE WALD_P",
    "N": "N WEIGHT NCOMPLETESAMPLES TOTALSAMPLESIZE TOTALN TOTAL_N N_COMPLETE_SAMPLES SAMPLESIZE NEFF N_EFF N_EFFECTIVE SUMNEFF",
    "MAF": "MAF CEUAF FREQ1 EAF FREQ1.HAPMAP FREQALLELE1HAPMAPCEU FREQ.ALLELE1.HAPMAPCEU EFFECT_ALLELE_FREQ FREQ.A1 A1FREQ ALLELEFREQ EFFECT_ALLELE_FREQUENCY",
    "SE": "STDERR SE STDERRLOGOR SEBETA STANDARDERROR STANDARD_ERROR",
    "DIRECTION": "DIRECTION DIREC DIRE SIGN",
}
HALVES = ("NEFFDIV2", "NEFF_HALF")
BETAS = ("B", "BETA", "LOG_ODDS", "EFFECTS", "EST", "BETA1", "LOGOR")


class MissingColumn(ValueError):
    pass


class AmbiguousColumn(ValueError):
    pass


def normal_name(name: str) -> str:
    return name.strip().upper()


def resolve(columns: Sequence[str], required: Sequence[str] = (), overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """canonical name -> header, by override, by the canonical name itself, then by synonym.

    Z goes before EFFECT; a Z serves as EFFECT where there is none. Two synonyms of one name in the
    same table are an error, as is a required name that nothing resolves to.
    """
    names = {normal_name(c): c for c in columns}
    found: dict[str, str] = {}
    for canonical, words in SYNONYMS.items():
        if overrides and canonical in overrides:
            found[canonical] = names[normal_name(overrides[canonical])]
        elif canonical in names:
            found[canonical] = names[canonical]
        elif hits := [w for w in words.split() if w in names]:
            if len(hits) > 1:
                raise AmbiguousColumn(f"{canonical} could be any of {', '.join(names[h] for h in hits)}")
            found[canonical] = names[hits[0]]
    if "EFFECT" not in found and "Z" in found:
        found["EFFECT"] = found["Z"]
    if missing := [c for c in required if c not in found]:
        raise MissingColumn(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return found


def effect_is_beta(columns: Sequence[str]) -> bool:
    """Whether the effect column is a regression coefficient rather than an odds ratio or a Z."""
    return any(normal_name(c) in BETAS for c in columns)
