"""Units of measure: canonical names, dimensions and conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Synonyms of each canonical unit.
SYNONYMS = {
    "ud": ("ud", "u", "uds", "und", "unidad", "unit"),
    "m2": ("m2", "m²", "m.cuad", "m cuadrados", "metro cuadrado"),
    "m3": ("m3", "m³", "m.cub", "m cubicos", "metro cubico"),
    "ml": ("ml", "m", "m.l.", "metro lineal", "mts", "mtl"),
    "kg": ("kg", "kgs", "kilo", "kilogramo"),
    "t": ("t", "ton", "tonelada", "tn"),
    "h": ("h", "hora", "hr", "hrs"),
    "l": ("l", "litro", "lts", "lt"),
    "%": ("%", "porcentaje", "pct"),
    "pa": ("pa", "p.a.", "partida alzada"),
}
#: Physical dimension of each canonical unit.
DIMENSIONS = {
    "m2": "superficie",
    "m3": "volumen",
    "ml": "lineal",
    "kg": "masa",
    "t": "masa",
    "h": "tiempo",
    "l": "volumen_liquido",
    "ud": "discreto",
    "%": "porcentaje",
    "pa": "importe",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def unit_normalize(unit: Column) -> Column:
    """Canonical name, null for null, blank or unknown units."""
    return _lookup({s: name for name, all_ in SYNONYMS.items() for s in all_}, F.lower(F.trim(unit)))


def unit_dimension(unit: Column) -> Column:
    return _lookup(DIMENSIONS, unit_normalize(unit))


def same_dimension(a: Column, b: Column) -> Column:
    return F.coalesce(unit_dimension(a) == unit_dimension(b), F.lit(False))


def unit_convert(value: Column, source: Column, target: Column, bridge: Column) -> Column:
    """``value`` in the target unit, null if there is no way; ``bridge`` maps a property's name to its value."""
    a, b = unit_normalize(source), unit_normalize(target)
    positive = lambda name: F.when(F.try_element_at(bridge, F.lit(name)) > 0, F.try_element_at(bridge, F.lit(name)))
    thick, dense, piece = positive("thickness_m"), positive("density_kg_m3"), positive("piece_length_m")
    pair = lambda x, y: (a == x) & (b == y)
    return (
        F.when(a == b, value)
        .when(pair("t", "kg"), value * 1000)
        .when(pair("kg", "t"), value / 1000)
        .when(pair("m2", "m3"), value * thick)
        .when(pair("m3", "m2"), value / thick)
        .when(pair("m3", "kg"), value * dense)
        .when(pair("kg", "m3"), value / dense)
        .when(pair("ml", "ud"), value / piece)
        .when(pair("ud", "ml"), value * piece)
    )
