"""Business rules as built-in column expressions (gold layer)."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the business rules.
# Region groups of the original beverage data, keyed by upper-case region.
BEVERAGE_REGION_GROUPS = {
    "NORTHEAST": "US_EAST", "SOUTHEAST": "US_EAST", "GREAT LAKES": "US_EAST",
    "MIDWEST": "US_WEST", "SOUTHWEST": "US_WEST", "WEST": "US_WEST",
    "CANADA": "CANADA",
}
REGION_GROUP_DEFAULT = "OTHER"
# Country rule: these regions map to a country of their own, the rest to the default.
COUNTRY_REGIONS = {"CANADA": "CANADA"}
COUNTRY_DEFAULT = "USA"
# Volume categories: strictly above HIGH -> "HIGH", above MEDIUM -> "MEDIUM", else "LOW".
VOLUME_HIGH, VOLUME_MEDIUM = 1000, 100
ALCOHOLIC_TYPES = ["ALCOHOLIC", "MIX"]
CHANNEL_CATEGORIES = {"GROCERY": "RETAIL", "ENTERTAINMENT": "ON_PREMISE", "SERVICES": "CONVENIENCE"}
CHANNEL_CATEGORY_DEFAULT = "OTHER"
QUARTERS = {"Q1": [1, 2, 3], "Q2": [4, 5, 6], "Q3": [7, 8, 9]}  # anything else -> Q4
CATEGORY_DEFAULT = "Unknown"


def map_lookup(col: Column, mapping: dict, default) -> Column:
    """Literal map lookup: one codegen'd expression, no join."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(m, col), F.lit(default))


# --- parameterised rule engine -------------------------------------------

def category_expr(source: str, conditions: list[dict]) -> Column | None:
    """First matching half-open range ``[low, high)``, either end open; else
    "Unknown". A range without any bound never matches."""
    value, arms = F.col(source), []
    for cond in conditions:
        ends = zip(cond.get("range") or (), (value.__ge__, value.__lt__))
        tests = [test(bound) for bound, test in ends if bound is not None]
        if tests:
            arms.append((reduce(and_, tests), F.lit(cond["value"])))
    if not arms:
        return None
    return reduce(lambda rest, arm: F.when(arm[0], arm[1]).otherwise(rest), reversed(arms), F.lit(CATEGORY_DEFAULT))


CALC = {
    "sum": lambda a, b: a + b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "subtract": lambda a, b: a - b,
}


def apply_business_rules(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rule types ``category``, ``calculation`` (sum/multiply/divide/subtract on
    the first two source columns) and ``derived`` (concat with separator).
    All new columns are added in one projection."""
    out = {}
    for name, cfg in rules.items():
        kind = cfg.get("type")
        if kind == "category":
            e = category_expr(cfg["source_column"], cfg.get("conditions", []))
        elif kind == "calculation":
            cols = cfg.get("source_columns", [])
            fn = CALC.get(cfg.get("calc_type", ""))
            e = fn(F.col(cols[0]), F.col(cols[1])) if fn and len(cols) >= 2 else None
        elif kind == "derived" and cfg.get("operation", "concat") == "concat":
            e = F.concat_ws(cfg.get("separator", "_"), *[F.col(c) for c in cfg.get("source_columns", [])])
        else:
            e = None
        if e is not None:
            out[name] = e
    return df.withColumns(out) if out else df


def add_time_dimensions(df: DataFrame, date_column: str, prefix: str = "") -> DataFrame:
    p = f"{prefix}_" if prefix else ""
    d = F.col(date_column)
    return df.withColumns({f"{p}year": F.year(d), f"{p}month": F.month(d), f"{p}quarter": F.quarter(d)})


# --- fixed gold rules ------------------------------------------------------

def volume_category(col: str = "dollar_volume", high=VOLUME_HIGH, medium=VOLUME_MEDIUM) -> Column:
    v = F.col(col)
    return F.when(v > high, "HIGH").when(v > medium, "MEDIUM").otherwise("LOW")


def negative_sale(col: str = "dollar_volume") -> Column:
    return F.coalesce(F.col(col) < 0, F.lit(False))


def region_group(col: str = "region", groups: dict | None = None) -> Column:
    return map_lookup(F.upper(F.col(col)), groups or BEVERAGE_REGION_GROUPS, REGION_GROUP_DEFAULT)


def sales_quarter(col: str = "month") -> Column:
    m = F.col(col)
    e = None
    for q, months in QUARTERS.items():
        e = F.when(m.isin(months), q) if e is None else e.when(m.isin(months), q)
    return e.otherwise("Q4")


def weekend_flag(col: str = "transaction_date") -> Column:
    return F.coalesce(F.dayofweek(F.col(col)).isin([1, 7]), F.lit(False))


def country(col: str = "region", special: dict | None = None, default: str = COUNTRY_DEFAULT) -> Column:
    return map_lookup(F.upper(F.col(col)), special or COUNTRY_REGIONS, default)


def alcoholic_channel(col: str = "trade_type_desc") -> Column:
    return F.coalesce(F.col(col).isin(ALCOHOLIC_TYPES), F.lit(False))


def channel_category(col: str = "trade_group_desc") -> Column:
    return map_lookup(F.col(col), CHANNEL_CATEGORIES, CHANNEL_CATEGORY_DEFAULT)
