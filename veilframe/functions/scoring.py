"""Confidence, severity and classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_places(c: Column) -> Column:
    """Half away from zero on the binary double."""
    return F.floor(c * 100 + 0.5) / 100


def confidence(specificity: Column, has_context: Column, context_required: Column) -> Column:
    raised = F.least(specificity + 0.20, F.lit(1.0))
    return two_places(F.when(has_context, raised).when(context_required, specificity * 0.3).otherwise(specificity))


def console_severity(category: Column, score: Column) -> Column:
    c = F.lower(category)
    critical = c.contains("credit card") | c.contains("primary account") | c.contains("secret") | c.contains("medical identifier")
    return F.when((critical & (score >= 0.80)) | (score >= 0.90), "red").when(score >= 0.70, "warn").otherwise("safe")


def report_severity(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.40, "medium").otherwise("low")


LEVELS = ["public", "internal", "restricted", "confidential", "secret", "top_secret"]
#: Labels that name a level.
LEVEL_NAMES = {
    0: "public unclassified clear tlp:clear tlp:white white",
    1: "internal tlp:green green",
    2: "restricted fouo cui sbu",
    3: "confidential tlp:amber amber tlp:amber+strict amber+strict",
    4: "secret tlp:red red noforn",
    5: "top-secret topsecret top_secret ts ts//sci",
}


def level_of(label: Column) -> Column:
    """Level 0 to 5 of a sensitivity label in any case, null for unknown labels."""
    s = F.lower(F.trim(label))
    out = F
    for level, names in LEVEL_NAMES.items():
        out = out.when(s.isin(*names.split()), level)
    return out.otherwise(F.lit(None).cast("int"))


def entropy_confidence(entropy: Column) -> Column:
    """4.5 to 6.0 bits become 0.40 to 0.90."""
    return F.least(F.greatest(0.40 + (entropy - 4.5) / 1.5 * 0.5, F.lit(0.40)), F.lit(0.90))


#: Largest usual entropy by file extension.
USUAL_ENTROPY = {".txt .csv .json .xml .html .py .js .log .md .rs .toml .yaml": 5.5, ".pdf": 7.8, ".docx .xlsx .pptx .zip .gz .png .jpg .jpeg": 8.0, ".tar": 7.0}


def entropy_class(entropy: Column, extension: Column) -> Column:
    usual = F
    for names, high in USUAL_ENTROPY.items():
        usual = usual.when(F.lower(extension).isin(*names.split()), high)
    return (
        F.when(entropy >= 7.9, "likely_encrypted").when(entropy >= 7.5, "compressed_or_encrypted").when(entropy > usual.otherwise(F.lit(None).cast("double")), "suspicious_for_format")
        .when(entropy >= 6.0, "moderately_random").otherwise("normal")
    )
