"""Declared input layouts. No input is read with an inferred schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _layout(text: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "str": T.StringType(), "dbl": T.DoubleType()}
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


TRADE = _layout(
    "period:int reporterCode:int reporterDesc:str partnerCode:int partnerDesc:str "
    "cmdCode:str cmdDesc:str flowCode:str flowDesc:str primaryValue:dbl netWgt:dbl "
    "qty:dbl qtyUnitAbbr:str"
)
TRADE_COLUMNS = TRADE.fieldNames()
#: Columns the trade report needs; the rest may be absent.
TRADE_REQUIRED = [c for c in TRADE_COLUMNS if c not in ("qty", "qtyUnitAbbr")]

NOTIFICATIONS_RAW = _layout(
    "reference:str date:str notification_date:str origin:str notifying_country:str "
    "distribution:str for_followUp:str for_attention:str hs_code:str commodities:str "
    "classification:str risk_decision:str hazards:str"
)
#: Columns of notifications that nothing replaces.
NOTIFICATIONS_REQUIRED = ["reference", "origin", "hs_code", "classification", "risk_decision"]
COMMODITIES = _layout("commodity:str hs_code_comtrade:str faostat_cpc:str")
PRODUCTION = _layout(
    "commodity_hs:str country_m49:int period:int production_kg:dbl "
    "domestic_supply_kg:dbl population:dbl"
)
FOOD_BALANCE = _layout(
    "commodity_hs:str country_m49:int period:int domestic_supply_food_kg:dbl population:dbl"
)
PROGRESS = _layout("from_code:int to_code:int status:str records:int")


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Expected names the frame lacks, sorted. Reads metadata only."""
    return sorted(set(expected) - set(df.columns))


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
