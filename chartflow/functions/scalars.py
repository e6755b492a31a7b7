"""Scalar functions (U1 to U17) as Column expressions, and the predicates that read null as false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of dose units and what they become, in this order (plurals first).
UNIT_SPELLINGS = [
    ("/h(r|our)?$", "/hr"),
    ("/m(in|inute)?$", "/min"),
    ("u(nits|nit)?", "u"),
    ("milli-?", "m"),
    ("l(iters|itres|itre|iter)?", "l"),
    ("^(u|µ|μ)g", "mcg"),
    ("^g(rams|ram)?", "g"),
]
# Amounts, weights and times that units are made of.
AMOUNTS = ["ml", "l", "mu", "u", "mcg", "mg", "ng", "g"]
WEIGHTS = ["/kg", "/lb", ""]
TIMES = ["/hr", "/min"]
RATE_UNITS = [a + w + t for a in AMOUNTS for w in WEIGHTS for t in TIMES]
LB_PER_KG = 2.20462


def normalize_category(c: Column) -> Column:
    """Lower case, words joined by one underscore; & and / are spelt out."""
    c = F.replace(F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit("_and_")), F.lit("/"), F.lit("_or_"))
    c = F.regexp_replace(F.regexp_replace(c, "[ \\-,()]", "_"), "_+", "_")
    return F.regexp_replace(c, "^_+|_+$", "")


def clean_unit_format(c: Column) -> Column:
    """Without white space, in lower case; nothing is null."""
    return F.nullif(F.lower(F.regexp_replace(c, "\\s+", "")), F.lit(""))


def clean_unit_name(c: Column) -> Column:
    """Spelling variants made one."""
    for pattern, name in UNIT_SPELLINGS:
        c = F.regexp_replace(c, pattern, name)
    return c


def unit_class(c: Column) -> Column:
    return F.when(c.isin(RATE_UNITS), "rate").when(c.isin(AMOUNTS), "amount").otherwise("unrecognized")


def unit_family(c: Column) -> Column:
    """mass, volume or unit by how the name begins (U4)."""
    return F.when(c.rlike("^(mcg|mg|ng|g)"), "mass").when(c.rlike("^(l|ml)"), "volume").when(c.rlike("^(u|mu)"), "unit").otherwise("unrecognized")


def is_weighted(c: Column) -> Column:
    return F.coalesce(c.rlike("/(lb|kg)/"), F.lit(False))


def amount_factor(c: Column) -> Column:
    """To ml, u or mcg."""
    return F.when(c.rlike("^l"), 1000.0).when(c.rlike("^mu"), F.lit(1.0) / 1000).when(c.rlike("^mg"), 1000.0).when(c.rlike("^ng"), F.lit(1.0) / 1000).when(c.rlike("^g"), 1000000.0).otherwise(1.0)


def time_factor(c: Column) -> Column:
    """To minutes."""
    return F.when(c.rlike("/hr$"), F.lit(1.0) / 60).otherwise(1.0)


def weight_factor(c: Column, weight_kg: Column) -> Column:
    """From a dose by weight to that of the body."""
    return F.when(c.rlike("/kg/"), weight_kg).when(c.rlike("/lb/"), weight_kg * LB_PER_KG).otherwise(1.0)


def pao2_from_spo2(spo2: Column) -> Column:
    """Arterial oxygen pressure from saturation in per cent, below 97 alone (U7; Severinghaus 1979)."""
    s = spo2 / 100
    a = F.try_divide(F.lit(11700.0), F.try_divide(F.lit(1.0), s) - 1)
    b = F.sqrt(F.lit(125000.0) + a * a)
    return F.when(spo2 < 97, F.cbrt(b + a) - F.cbrt(b - a))


def clean_code(c: Column) -> Column:
    """A diagnosis code in lower case without dots or white space around it (U8)."""
    return F.lower(F.replace(F.trim(c), F.lit("."), F.lit("")))


def number(c: Column) -> Column:
    """A double, or null."""
    return c.try_cast("double")


def day_difference(later: Column, earlier: Column) -> Column:
    """Calendar days between."""
    return F.datediff(later, earlier)


def site_local(c: Column, zone: str) -> Column:
    """The wall clock of a zone."""
    return F.from_utc_timestamp(c, zone)


def minute_key(c: Column, zone: str = "UTC") -> Column:
    """yyyyMMddHHmm by the wall clock of a zone."""
    return F.date_format(site_local(c, zone), "yyyyMMddHHmm")


def identifier(c: Column) -> Column:
    """A value as part of a column name (U16)."""
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def for_validation(c: Column) -> Column:
    """Trimmed, in lower case."""
    return F.lower(F.trim(c.cast("string")))


def id_string(c: Column, kind: str) -> Column:
    """An id as a string; whole numbers without a fraction."""
    if kind in ("double", "float"):
        return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def true(c: Column) -> Column:
    """Null reads as false."""
    return F.coalesce(c, F.lit(False))


def contains(c: Column, text: str) -> Column:
    return true(c.contains(text))


def any_present(*columns: Column) -> Column:
    """Whether any of the columns has a value."""
    return F.coalesce(*(c.cast("string") for c in columns)).isNotNull()


# What laboratory units are compared by, patterns and what they become, in this order.
LAB_UNIT_REWRITES = [
    (r"[\[\]()]", ""),
    (r"\s*calc\s*$", ""),
    (r"\s+", ""),
    (r"μ|µ", "u"),
    (r"\^", ""),
    (r"\*", ""),
    (r"hours?", "hr"),
    (r"seconds?", "sec"),
    (r"^s$", "sec"),
    (r"minutes?", "min"),
    (r"iu", "u"),
    (r"\bgrams?\b", "g"),
    (r"\bgm\b", "g"),
    (r"k/ul", "103/ul"),
    (r"10e3", "103"),
    (r"x10e3", "103"),
    (r"x103", "103"),
    (r"\bpg/ml\b", "ng/l"),
    (r",", ""),
]


def lab_unit(c: Column) -> Column:
    """A unit in the form in which units are compared; null is empty."""
    c = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for pattern, to in LAB_UNIT_REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return c
