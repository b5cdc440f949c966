"""Rules that turn signals into states and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.addresses import is_disposable

#: Allowed changes of a project's status.
PROJECT_TRANSITIONS = {
    "preparacion": ("ejecucion", "pausada"),
    "ejecucion": ("pausada", "finalizada"),
    "pausada": ("ejecucion", "finalizada"),
    "finalizada": ("cerrada",),
    "cerrada": (),
}


def rolling_hash(text: Column) -> Column:
    """The 31-multiplier hash of a text's characters, as a signed 32-bit number (ASCII texts)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    wrap = lambda h: ((h + F.lit(2147483648)).bitwiseAND(F.lit(4294967295))) - F.lit(2147483648)
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: wrap(h * 31 + F.ascii(c)))


def ab_variant(unit: Column, weights: dict[str, float]) -> Column:
    """Variant of a unit by cumulative weights; what rounding leaves over goes to the last."""
    x = F.abs(rolling_hash(unit)) / 2147483647.0
    whole, upto, names = sum(weights.values()), 0.0, list(weights)
    out = None
    for name in names[:-1]:
        upto += weights[name] / whole
        out = F.when(x <= upto, name) if out is None else out.when(x <= upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def job_status(completed: Column, failed: Column) -> Column:
    """Completion counts more than failure."""
    return F.when(completed, "completed").when(failed, "failed").otherwise("running")


def lead_decision(score: Column) -> Column:
    return F.when(score >= 70, "qualified").when(score >= 40, "review_required").otherwise("rejected")


def transition_allowed(before: Column, after: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    pairs = [F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs]
    return F.array_contains(F.array(*pairs), F.concat(before, F.lit(">"), after))


def price_anomaly(unit: Column, unit_price: Column, quantity: Column) -> Column:
    """A line in a common unit that costs over 100,000."""
    return unit.isin("m2", "m3", "ml", "kg", "ud") & (unit_price * quantity > 100_000)


def price_scale(found: Column, stored: Column) -> Column:
    """How a price read from text relates to the stored one."""
    ratio = stored / F.when(found > 0, found)
    return F.when(ratio.between(90, 110), "times_100").when((ratio < 0.9) | (ratio > 1.1), "suspicious").otherwise("ok")


#: Default shares of overhead, benefit and VAT.
OVERHEAD, BENEFIT, VAT = 0.10, 0.15, 0.10


def merged_assembly(lines: DataFrame, order: str) -> DataFrame:
    """(key, quantity, unit_price, total) of lines (key, order, matched, quantity, price).

    Lines that were matched add up by key, at the price of the first in ``order``, to the cent. Of others the last takes the
    place of those before, without a price.
    """
    any_ = F.bool_or("matched")
    unit_price = F.when(any_, F.min_by("price", order)).otherwise(0.0)
    quantity = F.when(any_, F.sum("quantity")).otherwise(F.max_by("quantity", order))
    merged = lines.groupBy("key").agg(quantity.alias("quantity"), unit_price.alias("unit_price"))
    return merged.withColumn("total", F.round(F.col("unit_price") * F.col("quantity"), 2))


def measurement_totals(lines: DataFrame, overhead: float = OVERHEAD, benefit: float = BENEFIT, vat: float = VAT) -> DataFrame:
    """One row of a priced measurement (price, matched): subtotal, overhead, benefit, VAT on all three, total and matched lines."""
    s = F.coalesce(F.sum("price"), F.lit(0.0))
    row = lines.agg(s.alias("s"), F.sum(F.col("matched").cast("bigint")).alias("matched"))
    parts = {"subtotal": 1.0, "overhead": overhead, "benefit": benefit, "vat": (1 + overhead + benefit) * vat, "total": (1 + overhead + benefit) * (1 + vat)}
    return row.select(*(F.round(F.col("s") * share, 2).alias(name) for name, share in parts.items()), F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"))


#: Postal codes of the area begin so; kinds of work that are taken on, and the least size of each in square metres.
SERVICE_AREA = ("07",)
PROJECT_TYPES = ("bathroom", "kitchen", "integral", "new_build", "pool")
LEAST_SIZE = {"bathroom": 3, "kitchen": 5, "integral": 25, "new_build": 60, "pool": 8, "other": 0}
#: Rules whose failure casts doubt on a lead.
LOW_TRUST = ("email.disposable", "security.injection_attempt")


def qualify_lead(lead: dict[str, Column], fatal: tuple[str, ...] = ()) -> Column:
    """Struct (decision, score, rules, failed, low_trust) of a lead by seven rules, each of which moves the score from 50.

    ``lead`` has columns postal_code, project_type, square_metres, description, email, suspicious, images (a number), budget
    and timeline; any may be null. ``rules`` names the outcome of each rule in order, ``failed`` those that count
    against the lead; a failed rule among ``fatal`` rejects it whatever the score.
    """
    code, kind, size = F.trim(F.coalesce(lead["postal_code"], F.lit(""))), F.coalesce(lead["project_type"], F.lit("")), F.coalesce(lead["square_metres"], F.lit(0))
    words = F.length(F.trim(F.coalesce(lead["description"], F.lit(""))))
    least = F.try_element_at(F.create_map(*(F.lit(x) for kv in LEAST_SIZE.items() for x in kv)), kind)
    inside = F.exists(F.array(*map(F.lit, SERVICE_AREA)), lambda p: F.startswith(code, p))
    has = {"images": F.coalesce(lead["images"] > 0, F.lit(False)), "budget": F.coalesce(lead["budget"] > 0, F.lit(False)), "timeline": F.coalesce(lead["timeline"] != "", F.lit(False))}
    shown = sum((F.when(has[k], n).otherwise(0) for k, n in (("images", 10), ("budget", 5), ("timeline", 5))), F.lit(0))
    rule = lambda name, passed, delta: F.struct(F.lit(name).alias("rule"), F.lit(passed).alias("passed"), F.lit(delta).alias("delta"))
    outcomes = F.array(
        F.when(code == "", rule("geo.postal_code_missing", False, -10)).when(inside, rule("geo.in_service_area", True, 10)).otherwise(rule("geo.out_of_service_area", False, -25)),
        F.when(kind.isin(*PROJECT_TYPES), rule("scope.accepted_project_type", True, 5)).otherwise(rule("scope.rejected_project_type", False, -20)),
        F.when(size == 0, rule("size.unknown", False, -5)).when(size < least, rule("size.below_minimum", False, -15)).otherwise(rule("size.adequate", True, 5)),
        F.when(words < 10, rule("content.description_too_short", False, -20)).when(words < 30, rule("content.description_minimal", False, -5)).otherwise(rule("content.description_ok", True, 5)),
        F.when(is_disposable(lead["email"]), rule("email.disposable", False, -25)).otherwise(rule("email.ok", True, 5)),
        F.when(F.coalesce(lead["suspicious"], F.lit(False)), rule("security.injection_attempt", False, -30)).otherwise(rule("security.clean", True, 0)),
        F.struct(F.lit("evidence.signals").alias("rule"), (shown > 0).alias("passed"), shown.alias("delta")),
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(outcomes, F.lit(50), lambda s, x: s + x["delta"])))
    failed = F.transform(F.filter(outcomes, lambda x: ~x["passed"]), lambda x: x["rule"])
    among = lambda names: F.arrays_overlap(failed, F.array(*map(F.lit, names))) if names else F.lit(False)
    decision = F.when(among(fatal), "rejected").otherwise(lead_decision(score))
    return F.struct(decision.alias("decision"), score.alias("score"), F.transform(outcomes, lambda x: x["rule"]).alias("rules"), failed.alias("failed"), among(LOW_TRUST).alias("low_trust"))


def match_ladder(candidates: Column) -> Column:
    """Struct (price, confidence) from candidates (price, type, verified) in order.

    The first that is verified counts (95 for labour, else 75), else the first of labour (85), else the first of
    material with two fifths more (60), else there is no price (30).
    """
    first = lambda cond: F.get(F.filter(candidates, cond), F.lit(0))
    known, labor, material = first(lambda c: c["verified"]), first(lambda c: c["type"] == "LABOR"), first(lambda c: c["type"] == "MATERIAL")
    rung = lambda price, confidence: F.struct(price.cast("double").alias("price"), confidence.cast("int").alias("confidence"))
    return (
        F.when(known.isNotNull(), rung(known["price"], F.when(known["type"] == "LABOR", 95).otherwise(75)))
        .when(labor.isNotNull(), rung(labor["price"], F.lit(85)))
        .when(material.isNotNull(), rung(material["price"] * 1.4, F.lit(60)))
        .otherwise(rung(F.lit(None), F.lit(30)))
    )
