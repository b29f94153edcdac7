"""The scalar formulas of the framework as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelanes.functions.guards import ratio, zero_if_null
from tradelanes.functions.text import (
    CLASSIFICATION_WEIGHTS,
    RISK_DECISION_WEIGHTS,
    weight_of,
)

# ------------------------------------------------------------------ dependency


def supply_balance(
    production: Column, imports: Column, exports: Column, stock_change: Column | None = None
) -> Column:
    """Apparent supply; NULL when it is not positive."""
    balance = production + imports - exports
    if stock_change is not None:
        balance = balance + stock_change
    return F.when(balance > 0, balance)


def import_dependency_ratio(imports: Column, supply: Column) -> Column:
    return ratio(imports, supply)


def origin_country_share(bilateral: Column, imports: Column) -> Column:
    return ratio(bilateral, imports)


def bilateral_dependency(bilateral: Column, supply: Column) -> Column:
    return ratio(bilateral, supply)


def self_sufficiency(production: Column, domestic: Column, supply: Column) -> Column:
    """Production over domestic supply; a missing or zero one falls back to apparent supply."""
    return ratio(production, F.coalesce(F.nullif(domestic, F.lit(0.0)), supply))


def supply_criticality(idr: Column, ocs: Column, hhi: Column) -> Column:
    return idr * ocs * (1 + hhi)


# ----------------------------------------------------------------- consumption


def per_capita_consumption(supply: Column, population: Column) -> Column:
    return ratio(supply, population)


def rank_score(rank: Column, count: Column) -> Column:
    """1.0 for the first of ``count`` ranks down to 0.0 for the last."""
    return F.when(count <= 1, F.lit(1.0)).otherwise(1.0 - (rank - 1.0) / (count - 1.0))


def demand_variability(spread: Column, mean: Column) -> Column:
    return ratio(spread, mean)


def demand_inelasticity(variability: Column) -> Column:
    return F.when(variability.isNotNull(), 1.0 - F.least(variability, F.lit(1.0)))


# ---------------------------------------------------------------------- hazard


def severity_weight(classification: Column, risk_decision: Column) -> Column:
    return weight_of(classification, CLASSIFICATION_WEIGHTS) * weight_of(
        risk_decision, RISK_DECISION_WEIGHTS
    )


def decayed(severity: Column, alpha: float | Column, months: Column) -> Column:
    base = F.lit(alpha) if isinstance(alpha, float) else alpha
    return severity * F.pow(base, months)


def half_life(alpha: Column) -> Column:
    """Months until a decay of ``alpha`` per month halves a signal."""
    return F.when((alpha > 0) & (alpha < 1), F.lit(-math.log(2.0)) / F.ln(alpha))


def normalised_entropy(counts: list[Column]) -> Column:
    """Shannon entropy of the counts over its maximum; 0 for no or one category."""
    whole = sum(counts[1:], counts[0])
    terms = []
    for count in counts:
        share = count / whole
        terms.append(F.when((count > 0) & (whole > 0), -share * F.ln(share)).otherwise(F.lit(0.0)))
    return sum(terms[1:], terms[0]) / F.lit(math.log(len(counts)))


def detection_gap(bilateral: Column, imports: Column, alerts: Column, all_alerts: Column) -> Column:
    """Share of trade minus share of notifications."""
    return ratio(bilateral, imports) - ratio(alerts, all_alerts)


# ------------------------------------------------------------------ trade flow


def unit_value(value: Column, weight: Column) -> Column:
    return ratio(value, weight)


def zscore(value: Column, mean: Column, spread: Column) -> Column:
    """NULL for a constant series, including one that differs only by rounding noise."""
    varies = spread > F.abs(mean) * 1e-12
    return F.when(varies, (value - mean) / spread)


def mirror_discrepancy(imported: Column, exported: Column) -> Column:
    """Gap between what both sides report, as a share of the larger figure."""
    return ratio(F.abs(imported - exported), F.greatest(imported, exported))


# --------------------------------------------------------------------- network


def hazard_probability(alerts: Column, imports: Column, shipment: Column) -> Column:
    return F.when((imports > 0) & (shipment > 0), alerts / (imports / shipment))


# --------------------------------------------------------------------- scoring


def score_weighted_linear(values: list[Column], weights: list[float]) -> Column:
    terms = [v * F.lit(w) for v, w in zip(values, weights)]
    return sum(terms[1:], terms[0])


def score_geometric_mean(values: list[Column], weights: list[float]) -> Column:
    result = F.lit(1.0)
    for value, weight in zip(values, weights):
        result = result * F.pow(value, F.lit(weight))
    return result


def score_hybrid(
    sci: Column,
    crs: Column,
    his: Column,
    pas: Column | None = None,
    sccs: Column | None = None,
    w_hazard: float = 1.0,
    w_price: float = 1.0,
    w_supply_chain: float = 1.0,
) -> Column:
    """Structural base times a bounded signal amplifier, scaled back to [0, 1]."""
    amplifier = F.lit(1.0) + F.lit(w_hazard) * his
    if pas is not None:
        amplifier = amplifier + F.lit(w_price) * zero_if_null(pas)
    if sccs is not None:
        amplifier = amplifier + F.lit(w_supply_chain) * zero_if_null(sccs)
    return sci * crs * amplifier / F.lit(1.0 + w_hazard + w_price + w_supply_chain)


def equal_weights(count: int) -> list[float]:
    return [1.0 / count] * count if count else []


# ----------------------------------------------------------------------- bands


def risk_band(value: Column, largest: float | Column = 1.0) -> Column:
    share = F.least(value / (F.lit(largest) if isinstance(largest, float) else largest), F.lit(1.0))
    return (
        F.when(share < 0.25, "low").when(share < 0.5, "moderate").when(share < 0.75, "elevated")
        .when(share >= 0.75, "high")
    )


def concentration_band(hhi: Column) -> Column:
    """Band of a 0-10,000 concentration index."""
    return F.when(hhi > 2500, "high").when(hhi > 1500, "moderate").otherwise("low")


def vulnerability_band(cvs: Column) -> Column:
    """Band of a composite score in [0, 1], cut at 20, 40, 60 and 80 percent."""
    return (
        F.when(cvs < 0.2, "low").when(cvs < 0.4, "moderate").when(cvs < 0.6, "elevated")
        .when(cvs < 0.8, "high").when(cvs >= 0.8, "critical")
    )
