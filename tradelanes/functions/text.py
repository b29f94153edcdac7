"""Text cleaning and the enumerations read from alert notifications."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelanes.functions.guards import coerce_double, once

# ---------------------------------------------------------------- fixed values
# Spellings and weights that results depend on; listed in their lookup order.

CLASSIFICATIONS = [
    ("alert notification", "AlertNotification"),
    ("alert", "AlertNotification"),
    ("border rejection", "BorderRejection"),
    ("border rejection notification", "BorderRejection"),
    ("information for follow-up", "InfoFollowUp"),
    ("information notification for follow-up", "InfoFollowUp"),
    ("information for attention", "InfoAttention"),
    ("information notification for attention", "InfoAttention"),
]
CLASSIFICATION_DEFAULT = "InfoAttention"
CLASSIFICATION_WEIGHTS = {
    "AlertNotification": 1.0,
    "BorderRejection": 0.8,
    "InfoFollowUp": 0.7,
    "InfoAttention": 0.5,
}

RISK_DECISIONS = [
    ("serious", "Serious"),
    ("potentially serious", "PotentiallySerious"),
    ("potential risk", "PotentialRisk"),
    ("not serious", "NotSerious"),
    ("undecided", "PotentialRisk"),
]
RISK_DECISION_DEFAULT = "PotentialRisk"
RISK_DECISION_WEIGHTS = {
    "Serious": 1.0,
    "PotentiallySerious": 0.7,
    "PotentialRisk": 0.4,
    "NotSerious": 0.2,
}

HAZARD_TYPES = [
    ("biological", "Biological"),
    ("chem_pesticides", "Chemical - Pesticides"),
    ("chem_heavy_metals", "Chemical - Heavy Metals"),
    ("chem_mycotoxins", "Chemical - Mycotoxins"),
    ("chem_other", "Chemical - Other"),
    ("regulatory", "Regulatory"),
]
HAZARD_DEFAULT = "chem_other"
HAZARD_TOKENS = [
    ("biological", "biological"),
    ("pathogenic micro-organisms", "biological"),
    ("non-pathogenic micro-organisms", "biological"),
    ("parasitic infestation", "biological"),
    ("biocontaminants", "biological"),
    ("pesticide residues", "chem_pesticides"),
    ("industrial contaminants", "chem_pesticides"),
    ("heavy metals", "chem_heavy_metals"),
    ("metals", "chem_heavy_metals"),
    ("mycotoxins", "chem_mycotoxins"),
    ("natural toxins", "chem_mycotoxins"),
    ("natural toxins (other)", "chem_mycotoxins"),
    ("chemical contamination", "chem_other"),
    ("food additives and flavourings", "chem_other"),
    ("migration", "chem_other"),
    ("foreign bodies", "chem_other"),
    ("allergens", "chem_other"),
    ("residues of veterinary medicinal products", "chem_other"),
    ("veterinary medicinal products", "chem_other"),
    ("radiation", "chem_other"),
    ("other hazard", "chem_other"),
    ("process contaminants", "chem_other"),
    ("polycyclic aromatic hydrocarbons", "chem_other"),
    ("composition", "regulatory"),
    ("labelling absent/incomplete/incorrect", "regulatory"),
    ("labelling", "regulatory"),
    ("adulteration/fraud", "regulatory"),
    ("adulteration", "regulatory"),
    ("novel food", "regulatory"),
    ("gmo / novel food", "regulatory"),
    ("gmo", "regulatory"),
    ("tampering", "regulatory"),
    ("poor or insufficient controls", "regulatory"),
]

# Columns of a notification that name destinations, and the role each gives.
ROLE_COLUMNS = [
    ("notifying_country", "notifier"),
    ("distribution", "distribution"),
    ("for_followUp", "followUp"),
    ("for_attention", "attention"),
]
ROLES = [role for _, role in ROLE_COLUMNS]
ACTIVE_ROLES = ["notifier", "distribution", "followUp"]
# ------------------------------------------------------------------------------


#: Up to this many items of a list are worked out in compiled code.
FEW = 4


def _trimmed(item: Column) -> Column:
    return F.trim(item)


def each(items: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of every item of an array that isn't NULL.

    Spark runs lambdas uncompiled, so short lists are written out item by
    item. ``items`` should be a column, as it is named once for each.
    """
    few = F.slice(F.array(*[build(F.get(items, i)) for i in range(FEW)]), 1, F.size(items))
    return F.when(F.size(items) <= FEW, few).otherwise(F.transform(items, build))


def _parts(value: Column) -> Column:
    """Comma text to trimmed parts; a lambda trims only where more than one blank follows a comma or one is before it."""
    close = F.replace(F.trim(value), F.lit(", "), F.lit(","))
    plain = ~F.contains(close, F.lit(", ")) & ~F.contains(close, F.lit(" ,"))
    return F.when(plain, F.split(close, ",")).otherwise(F.transform(F.split(value, ","), _trimmed))


def normalise_hs(value: Column) -> Column:
    """A commodity code as text: numbers lose decimals and leading zeros.

    Use :func:`six_digit_hs` where chapters matter.
    """
    text = value.cast("string")
    whole = coerce_double(text).try_cast("bigint").cast("string")
    return F.coalesce(whole, F.trim(text), F.lit(""))


def hs_int_text(value: Column) -> Column:
    """The commodity-map variant: whole number as text, or NULL."""
    return coerce_double(value).try_cast("bigint").cast("string")


def six_digit_hs(value: Column) -> Column:
    """Code text with the leading zero that number parsing drops put back."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike("^([0-9]{3}|[0-9]{5})$"), F.concat(F.lit("0"), text)).otherwise(text)


def hs_chapter(value: Column) -> Column:
    return F.substring(value, 1, 2)


def split_country_list(value: Column) -> Column:
    """Comma text to an array of trimmed, non-empty names; missing text gives []."""
    names = F.array_remove(_parts(value), "")
    missing = value.isNull() | (F.lower(F.trim(value)) == "nan")
    return F.when(missing, F.array().cast("array<string>")).otherwise(names)


def extract_hazard_categories(value: Column) -> Column:
    """Comma-joined ``{token}`` contents; text without tokens is kept as it is."""
    text = F.trim(value)
    found = F.regexp_extract_all(text, F.lit(r"\{ *([^} ](?:[^}]*[^} ])?) *\}"), F.lit(1))
    # blank tokens count, but need a lambda to be trimmed
    blank = F.transform(F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1)), _trimmed)
    joined = F.when(text.rlike(r"\{ +\}"), F.array_join(blank, ",")).otherwise(F.nullif(F.array_join(found, ","), F.lit("")))
    return F.coalesce(joined, text, F.lit(""))


def _spelled(value: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    """The kind of the spelling equal to the lower-case, trimmed value; looked up in compiled code."""
    kinds = F.create_map(*[F.lit(word) for pair in pairs for word in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.trim(value))), F.lit(default))


def parse_classification(value: Column) -> Column:
    return _spelled(value, CLASSIFICATIONS, CLASSIFICATION_DEFAULT)


def parse_risk_decision(value: Column) -> Column:
    return _spelled(value, RISK_DECISIONS, RISK_DECISION_DEFAULT)


def family_of(key: Column) -> Column:
    """Family of a lower-case, trimmed token: exact spelling first, then containment in list order."""
    exact = F.create_map(*[F.lit(word) for pair in HAZARD_TOKENS for word in pair])
    # written out, the containments of a few tokens are too long a method for the JVM to compile
    return F.coalesce(F.try_element_at(exact, key), once(key, _containing))


def _containing(key: Column) -> Column:
    contained = [F.when(F.contains(key, F.lit(token)), F.lit(kind)) for token, kind in HAZARD_TOKENS]
    return F.coalesce(*contained, F.lit(HAZARD_DEFAULT))


def parse_hazard_type(value: Column) -> Column:
    """One category token to its family."""
    return once(F.lower(F.trim(value)), family_of)


def parse_hazard_types(value: Column) -> Column:
    """A comma list of tokens to an array of families; duplicates are kept."""
    return F.transform(split_tokens(F.lower(value)), family_of)


def split_tokens(value: Column) -> Column:
    tokens = F.array_remove(_parts(value), "")
    return F.coalesce(tokens, F.array().cast("array<string>"))


def weight_of(kind: Column, weights: dict[str, float]) -> Column:
    return once(kind, lambda given: F.coalesce(*[F.when(given == name, F.lit(w)) for name, w in weights.items()]))


def route_label(reporter: Column, partner: Column) -> Column:
    """``reporter → partner``; a missing name shows as ``nan``."""
    return F.concat(
        F.coalesce(reporter, F.lit("nan")), F.lit(" → "), F.coalesce(partner, F.lit("nan"))
    )


def short_label(value: Column, limit: int = 40) -> Column:
    cut = F.concat(F.substring(value, 1, limit - 3), F.lit("..."))
    return F.when(F.length(value) > limit, cut).otherwise(value)


def truncate(value: Column, limit: int = 30) -> Column:
    """Keep ``limit`` characters and mark the cut; missing text is empty."""
    cut = F.concat(F.substring(value, 1, limit), F.lit("..."))
    return F.coalesce(F.when(F.length(value) > limit, cut).otherwise(value), F.lit(""))


def contains_text(columns: list[Column], query: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    needle = query.lower()
    hits = [F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(needle)) for c in columns]
    return reduce(lambda a, b: a | b, hits)
