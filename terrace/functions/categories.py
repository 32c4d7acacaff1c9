"""Categories and dimensions as Column expressions: keyword rules, thresholds, exact and contained names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The built-in dimensions, as (category, keywords) in order, and what else is called.
BUSINESS_OBJECT = (("revenue", ("revenue", "rev", "income", "sales")), ("volume", ("volume", "vol", "quantity", "qty", "count")), ("ETP", ("etp", "fte", "employee", "staff", "headcount")))
CLIENT_SEGMENT = (("B2B", ("b2b", "business", "enterprise", "corporate")), ("B2C", ("b2c", "consumer", "retail", "individual")), ("Government", ("gov", "government", "public", "sector")))
FINANCIAL_VIEW = (("Revenue", ("revenue", "income", "sales", "price")), ("Cost", ("cost", "expense", "spend", "outlay")), ("Margin", ("margin", "profit", "net", "gross")))
PATTERN_TYPE = (("aggregated", ("total_", "sum_", "agg_")), ("averaged", ("avg_", "mean_", "median_")), ("ratio", ("pct_", "percent_", "ratio_")))
#: Keywords of the built-in domains.
DOMAIN_KEYWORDS: dict[str, tuple[str, ...]] = {
    "revenue": ("revenue", "ca", "chiffre", "income", "sales", "recette"),
    "volume": ("volume", "vol", "quantity", "qty", "tonnage", "colis"),
    "etp": ("etp", "fte", "employee", "effectif", "staff", "personnel"),
    "cost": ("cost", "cout", "expense", "charge", "depense"),
    "margin": ("margin", "marge", "profit", "benefice"),
    "quality": ("quality", "qualite", "satisfaction", "nps"),
    "delivery": ("delivery", "livraison", "expedition", "shipping"),
    "customer": ("customer", "client", "account", "compte"),
}


def first_keyword(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None, word_boundary: bool = False) -> Column:
    """The first category with a keyword inside the lower-cased text; null text gets the default.

    Keywords also match inside words (``rev`` in ``previous``) unless ``word_boundary`` asks for whole words.
    """
    low, out = F.lower(text), None
    for name, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | (low.rlike(rf"\b\Q{word}\E\b") if word_boundary else low.contains(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def business_object(text: Column) -> Column:
    return first_keyword(text, BUSINESS_OBJECT, "other")


def client_segment(text: Column) -> Column:
    return first_keyword(text, CLIENT_SEGMENT, "Unknown")


def financial_view(text: Column) -> Column:
    return first_keyword(text, FINANCIAL_VIEW, "Unknown")


def pattern_type(text: Column) -> Column:
    """By prefix, or by a year at the end; upper and lower case differ."""
    out = None
    for name, prefixes in PATTERN_TYPE:
        hit = text.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(text.rlike("_[0-9]{4}$"), "temporal").otherwise("raw")


def domain(text: Column, domains: Sequence[str]) -> Column:
    """The first domain with one of its keywords in the text, else null; an unknown domain is its own keyword."""
    return first_keyword(text, [(d, DOMAIN_KEYWORDS.get(d.lower(), (d.lower(),))) for d in domains], None)


def contains_any(text: Column, categories: Sequence[str], default: str | None = "Unmatched") -> Column:
    """The first category that the value contains."""
    return first_keyword(text, [(c, (c.lower(),)) for c in categories], default)


def contains_either(text: Column, categories: Sequence[str], default: str | None = "Unmatched") -> Column:
    """The first category that the value contains or is part of; an empty value matches none."""
    low, out = F.lower(text), None
    for c in categories:
        hit = (low != "") & (low.contains(c.lower()) | F.lit(c.lower()).contains(low))
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def exact(value: Column, categories: Sequence[str], default: str | None = "Unmatched") -> Column:
    text = value.cast("string")
    return F.when(text.isin(*categories), text).otherwise(F.lit(default))


def threshold(value: Column, limit: float, below: str, otherwise: str) -> Column:
    """``below`` under the limit, else ``otherwise``; null is null."""
    return F.when(value < limit, below).when(value >= limit, otherwise)


def score_bucket(score: Column, limits: Sequence[tuple[float, str]] = ((80, "ready"), (60, "fixable")), otherwise: str = "needs_work") -> Column:
    out = None
    for limit, name in limits:
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out.otherwise(F.when(score.isNull(), "unknown").otherwise(otherwise))


def traffic_light(score: Column) -> Column:
    """(light, badge, can_export) of a score: green from 80, yellow from 60, else red, which can't be exported."""
    light = score_bucket(score, ((80, "green"), (60, "yellow")), "red")
    badge = score_bucket(score, ((80, "Excellent"), (60, "Good"), (40, "Fair")), "Poor")
    return F.struct(light.alias("light"), badge.alias("badge"), (F.coalesce(score, F.lit(0)) >= 60).alias("can_export"))


@dataclass(frozen=True)
class Dimension:
    """A named dimension: an expression for the category, its legal values, and what stands for anything else."""

    name: str
    values: tuple[str, ...]
    default: str
    rule: object = field(repr=False)  # Column -> Column
    levels: tuple[int, int] = (1, 2)

    def classify(self, value: Column) -> Column:
        found = self.rule(value)
        return F.coalesce(F.when(found.isin(*self.values), found), F.lit(self.default)) if self.values else F.coalesce(found, F.lit(self.default))


def _named(rules: Sequence[tuple[str, Sequence[str]]], *more: str) -> tuple[str, ...]:
    return (*(name for name, _ in rules), *more)


class Dimensions:
    """A registry of dimensions by name; a name can be taken once."""

    def __init__(self, known: Mapping[str, Dimension] | None = None):
        self._known = dict(known or {})

    @classmethod
    def built_in(cls) -> Dimensions:
        own = cls()
        own.add(Dimension("business_object", _named(BUSINESS_OBJECT, "other"), "other", business_object))
        own.add(Dimension("pattern_type", _named(PATTERN_TYPE, "temporal", "raw"), "raw", pattern_type))
        own.add(Dimension("client_segment", _named(CLIENT_SEGMENT, "Unknown"), "Unknown", client_segment, (2, 3)))
        own.add(Dimension("financial_view", _named(FINANCIAL_VIEW, "Unknown"), "Unknown", financial_view, (2, 3)))
        return own

    def add(self, dimension: Dimension) -> None:
        if dimension.name in self._known:
            raise ValueError(f"dimension {dimension.name!r} exists")
        self._known[dimension.name] = dimension

    def get(self, name: str) -> Dimension:
        if name not in self._known:
            raise KeyError(f"no dimension {name!r}; there are {', '.join(self._known)}")
        return self._known[name]

    def of_levels(self, low: int, high: int) -> list[Dimension]:
        return [d for d in self._known.values() if d.levels == (low, high)]
