"""Bands, phrases and sentences about scored rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band borders and labels.
PSI_BANDS = ((0.10, "stable"), (0.20, "moderate"))
PSI_TOP_BAND = "high"
RISK_BANDS = ((0.60, "Higher relative risk"), (0.35, "Moderate relative risk"))
RISK_LOWEST_BAND = "Lower relative risk"

# Phrases of the explanation text.
NO_RAISING = "Predicted risk level is mostly driven by overall model feature interactions"
NO_LOWERING = "Limited counterbalancing low-risk signals were detected"
NO_POSITIVE = "No positive contribution factors were available for this row"
NO_NEGATIVE = "No negative contribution factors were available for this row"
CLOSING = (
    "This explanation is generated from model behavior and feature patterns for demo use only. "
    "It is not medical advice and should not replace clinical judgment."
)

# Fixed values: (feature, raises at, text, digits) and (feature, lowers between, text, digits).
# Text with a None digit count is used as it is.
RAISING_RULES = (
    ("recurrency", 1.0, "Repeated encounter burden (recurrency=%s)", 0),
    ("patient_severity", 0.40, "Higher severity index (patient_severity=%s)", 2),
    ("utilization_intensity", 3.0, "Higher utilization intensity (%s)", 0),
    ("medication_change_ratio", 0.20, "More medication changes (medication_change_ratio=%s)", 2),
    ("complex_discharge_flag", 1.0, "Complex discharge disposition signal present", None),
    ("age_bucket_risk", 7.0, "Higher age-risk bucket (age_bucket_risk=%s)", 0),
)
LOWERING_RULES = (
    ("recurrency", None, 1.0, False, "No repeated encounter signal (recurrency near 0)", None),
    ("patient_severity", None, 0.20, True, "Lower severity index (patient_severity=%s)", 2),
    ("utilization_intensity", None, 1.0, True, "Lower utilization intensity (%s)", 0),
    ("medication_change_ratio", None, 0.05, True,
     "Limited medication changes (medication_change_ratio=%s)", 2),
    ("complex_discharge_flag", None, 1.0, False,
     "Home-like discharge disposition signal present", None),
    ("age_bucket_risk", 0.0, 4.0, True, "Lower age-risk bucket (age_bucket_risk=%s)", 0),
)


def psi_band(psi: Column) -> Column:
    band = F.when(psi.isNull(), F.lit("unavailable"))
    for border, name in PSI_BANDS:
        band = band.when(psi < border, F.lit(name))
    return band.otherwise(F.lit(PSI_TOP_BAND))


def risk_band(probability: Column) -> Column:
    (high, high_name), (middle, middle_name) = RISK_BANDS
    return (F.when(probability >= high, F.lit(high_name))
            .when(probability >= middle, F.lit(middle_name)).otherwise(F.lit(RISK_LOWEST_BAND)))


def fixed_digits(value: Column, digits: int, signed: bool = False) -> Column:
    """Fixed-point text, rounded from the exact binary value, ties to even.

    ``format_string`` alone rounds the shortest decimal text half up, so 0.25
    would become "0.3". The scaled value may look like a tie only because the
    product was rounded; the error of the product, computed exactly by splitting
    the value in two halves, tells on which side it lies.
    """
    scale = float(10 ** digits)
    scaled = value * F.lit(scale)
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    error = (high * F.lit(scale) - scaled) + (value - high) * F.lit(scale)
    low = F.floor(scaled).cast("double")
    tie = (scaled - low) == 0.5
    rounded = (F.when(tie & (error > 0), low + 1.0).when(tie & (error < 0), low)
               .otherwise(F.rint(scaled)))
    pattern = f"%+.{digits}f" if signed else f"%.{digits}f"
    return F.when(value.isNotNull(), F.format_string(pattern, rounded / F.lit(scale)))


def percent(share: Column) -> Column:
    return F.concat(fixed_digits(share * F.lit(100.0), 1), F.lit("%"))


def percent_or_zero(share: Column) -> Column:
    return percent(F.coalesce(share, F.lit(0.0)))


def metric_text(value: Column, digits: int = 4) -> Column:
    return F.coalesce(fixed_digits(value, digits), F.lit("n/a"))


def readable_name(name: Column) -> Column:
    return F.initcap(F.trim(F.translate(name, "_-", "  ")))


def ranked_entries(shares: Column) -> Column:
    """Entries of a label -> number map, largest first; ties keep map order."""
    return F.array_sort(F.map_entries(shares), lambda a, b: (
        F.when(a["value"] > b["value"], F.lit(-1))
        .when(a["value"] < b["value"], F.lit(1)).otherwise(F.lit(0))))


def prediction_summary(prediction: Column, probability: Column, label: Column,
                       shares: Column) -> Column:
    listed = F.array_join(F.transform(ranked_entries(shares), lambda e: F.concat(
        e["key"], F.lit(":"), percent(e["value"]))), ", ")
    empty = shares.isNull() | (F.size(shares) == 0)
    return F.concat(
        F.lit("Binary early-readmission prediction="), prediction.cast("string"), F.lit(" ("),
        percent(probability), F.lit(" probability). Multiclass prediction="),
        F.coalesce(label, F.lit("unknown")), F.lit(". Multiclass probabilities: "),
        F.when(empty, F.lit("unavailable")).otherwise(listed), F.lit("."))


def explanation_text(summary: Column, raising: Column, lowering: Column) -> Column:
    def joined(parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(
            F.lit("none identified"))

    return F.concat(summary, F.lit(" Risk-increasing factors: "), joined(raising),
                    F.lit(". Risk-decreasing factors: "), joined(lowering),
                    F.lit(". " + CLOSING))


def _phrase(value: Column, text: str, digits: int | None) -> Column:
    if digits is None:
        return F.lit(text)
    before, after = text.split("%s")
    return F.concat(F.lit(before), fixed_digits(value, digits), F.lit(after))


def _first_or(phrases: list[Column], n: int, default: str) -> Column:
    found = F.slice(F.array_compact(F.array(*phrases)), 1, n)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def rule_factors(features: dict[str, Column], n: int) -> tuple[Column, Column]:
    """Phrases for features that raise or lower the risk, in feature order."""
    raising, lowering = [], []
    for name, start, text, digits in RAISING_RULES:
        if name in features:
            x = features[name]
            raising.append(F.when(x >= start, _phrase(x, text, digits)))
    for name, low, high, closed, text, digits in LOWERING_RULES:
        if name in features:
            x = features[name]
            inside = (x <= high) if closed else (x < high)
            if low is not None:
                inside = inside & (x >= low)
            lowering.append(F.when(inside, _phrase(x, text, digits)))
    nothing = F.lit(None).cast("string")
    return (_first_or(raising or [nothing], n, NO_RAISING),
            _first_or(lowering or [nothing], n, NO_LOWERING))


def contribution_factors(contributions: Column, n: int) -> tuple[Column, Column]:
    """Contribution structs (feature, contribution) as two lists of labels;
    both empty when no contribution has a sign."""
    def labels(keep) -> Column:
        kept = F.filter(contributions, keep)
        return F.slice(F.transform(kept, lambda c: F.concat(
            c["feature"], F.lit(" ("), fixed_digits(c["contribution"], 3, signed=True),
            F.lit(")"))), 1, n)

    return labels(lambda c: c["contribution"] > 0), labels(lambda c: c["contribution"] < 0)
