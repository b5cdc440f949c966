"""Rules on budget lines and their components, arrays of (code, type, price, total, yield_amount)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.units import unit_normalize

#: Category of a component by the first letters of its code, or else by its type.
CODE_CATEGORIES = {"%": "indirect", "mo": "labor", "mt": "material_fixed", "mq": "machinery", "ci": "indirect"}
TYPE_CATEGORIES = {"LABOR": "labor", "MATERIAL": "material_fixed", "MACHINERY": "machinery", "OTHER": "other"}
#: Categories that each pricing mode charges for.
MODE_CATEGORIES = {
    "COMPLETE": ("labor", "material_fixed", "material_variable", "machinery", "indirect", "other"),
    "LABOR_AND_FIXED": ("labor", "material_fixed", "machinery", "indirect", "other"),
    "LABOR_ONLY": ("labor",),
}


def categorize(code: Column, type_: Column, is_variable: Column) -> Column:
    """By code, else by type, else other; fixed material that varies is variable material."""
    low = F.lower(F.trim(code))
    by_code = F.coalesce(*(F.when(F.startswith(low, F.lit(p)), F.lit(c)) for p, c in CODE_CATEGORIES.items()))
    by_type = F.coalesce(*(F.when(F.upper(F.trim(type_)) == t, F.lit(c)) for t, c in TYPE_CATEGORIES.items()))
    base = F.coalesce(by_code, by_type, F.lit("other"))
    return F.when((base == "material_fixed") & F.coalesce(is_variable, F.lit(False)), "material_variable").otherwise(base)


def total_of(parts: Column) -> Column:
    """Sum of the components' totals, null totals as 0."""
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.coalesce(p["total"], F.lit(0.0)))


def mode_price(parts: Column, mode: str, fallback: Column) -> Column:
    """Sum of the components that a mode charges for; the fallback price where there are none."""
    mine = F.filter(parts, lambda p: categorize(p["code"], p["type"], p["is_variable"]).isin(*MODE_CATEGORIES[mode]))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, fallback).otherwise(F.round(total_of(mine), 2))


def markup_factor(gg: Column, bi: Column) -> Column:
    """1 + (GG + BI) / 100, or 1 where that isn't positive."""
    factor = 1 + (gg + bi) / 100
    return F.when(factor > 0, factor).otherwise(F.lit(1.0))


def bake_markup(unit_price: Column, quantity: Column, parts: Column, factor: Column) -> Column:
    """Struct of the marked-up unit price, total and components; raw values stay beside them."""
    unit = F.round(unit_price * factor, 2)
    baked = F.transform(
        parts,
        lambda p: F.struct(
            p["code"].alias("code"), p["price"].alias("raw_price"), p["total"].alias("raw_total"),
            F.round(p["price"] * factor, 2).alias("price"), F.round(p["total"] * factor, 2).alias("total"),
        ),
    )
    return F.struct(unit_price.alias("unit_price_raw"), unit.alias("unit_price"), F.round(unit * quantity, 2).alias("total_price"), baked.alias("parts"))


def rebake(raw: Column, baked: Column, old: Column, new: Column, least: float = 1e-4) -> Column:
    """A marked-up price under a new factor; as it is where the factor changes by less than ``least`` of the old one."""
    return F.when(F.abs(new / old - 1) >= least, raw * new).otherwise(baked)


def defensive_scale(parts: Column, unit_price: Column, value: Column, result: Column) -> Column:
    """Struct (parts, event): components held against a unit price that a conversion from ``value`` to ``result`` made.

    With a conversion, a sum outside of 0.95 to 1.05 of the price is scaled by it; without (null), one outside of
    0.7 to 1.5 is only reported.
    """
    total = total_of(parts)
    ratio = F.when((total > 0) & (unit_price > 0), total / unit_price)
    converted, factor = result.isNotNull() & value.isNotNull(), result / F.greatest(value, F.lit(1e-6))
    scaled = F.transform(parts, lambda p: p.withField("price", p["price"] * factor).withField("total", p["total"] * factor))
    return F.struct(
        F.when(converted & ~ratio.between(0.95, 1.05), scaled).otherwise(parts).alias("parts"), F.coalesce(~converted & ~ratio.between(0.7, 1.5), F.lit(False)).alias("event")
    )


def force_scale(unit_price: Column, parts: Column, least: float = 1e-4) -> Column:
    """Components scaled so that they sum up to a unit price, each rounded; unchanged where the change is below ``least``."""
    k = F.try_divide(unit_price, total_of(parts))
    scaled = F.transform(parts, lambda p: p.withField("total", F.round(p["total"] * k, 2)).withField("price", F.round(p["price"] * k, 2)))
    return F.when(F.abs(1 - k) >= least, scaled).otherwise(parts)


def reconcile(unit_price: Column, parts: Column, tolerance: float = 0.02) -> Column:
    """Struct (parts, needs_review, divergence_pct, divergence_amount) of components against a unit price.

    Below the tolerance the components are scaled to the price; from there on they stay and are flagged.
    """
    total = total_of(parts)
    gap = F.try_divide(F.abs(unit_price - total), unit_price)
    idle = (F.coalesce(F.size(parts), F.lit(0)) <= 0) | (unit_price <= 0)

    def scaled(p: Column) -> Column:
        k = F.try_divide(unit_price, total)
        new = F.round(F.coalesce(p["total"], F.lit(0.0)) * k, 2)
        price = F.when(p["yield_amount"] > 0, F.round(new / p["yield_amount"], 2)).otherwise(F.round(F.coalesce(p["price"], F.lit(0.0)) * k, 2))
        return p.withField("total", new).withField("price", price)

    scale = ~idle & (total != 0) & (gap < tolerance)
    return F.struct(
        F.when(scale, F.transform(parts, scaled)).otherwise(parts).alias("parts"),
        (~idle & ~scale).alias("needs_review"),
        F.when(idle, 0.0).when(total == 0, 1.0).otherwise(gap).alias("divergence_pct"),
        F.when(idle | scale, 0.0).otherwise(total - unit_price).alias("divergence_amount"),
    )


def normalize_yield(price: Column, total: Column, declared: Column, tolerance: float = 0.01) -> Column:
    """Quantity that price and total imply where the declared one is missing or off; else the declared one."""
    implied = total / F.when(price > 0, price)
    off = (F.coalesce(declared, F.lit(0.0)) <= 0) | (F.abs(implied - declared) / F.greatest(implied, F.lit(1e-9)) > tolerance)
    return F.when((price > 0) & (total > 0) & off, F.round(implied, 4)).otherwise(declared)


def select_tier(score: Column, candidate_unit: Column, unit: Column) -> Column:
    """``flash`` for a confident candidate in the same canonical unit, however either is written, else ``pro``."""
    return F.when((score >= 0.85) & (unit_normalize(candidate_unit) == unit_normalize(unit)), "flash").otherwise("pro")


def needs_pro(tier: Column, match_kind: Column, needs_review: Column) -> Column:
    """Whether a line that was priced the quick way must be priced again: from scratch, or to be reviewed."""
    return (tier == "flash") & F.coalesce((match_kind == "from_scratch") | needs_review, F.lit(False))


def runaway(unit: Column, unit_price: Column, quantity: Column) -> Column:
    """Whether a line in one of the common units, written plainly, costs over 100,000."""
    return F.coalesce(F.lower(unit).isin("m2", "m3", "ml", "ud") & (unit_price * quantity > 100_000.0), F.lit(False))


def is_ancillary(description: Column) -> Column:
    """Whether a line is about ancillary means."""
    low = F.lower(description)
    return F.contains(low, F.lit("medios")) & low.rlike("auxiliares|ejecución|ejecucion")
