"""Unit conversion of phrases and of typed readings, keyword rules, context labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# fixed values: phrase patterns, tried on the lower-cased text
CELSIUS = r"(-?\d+\.?\d*)\s*°?c"
FAHRENHEIT = r"(-?\d+\.?\d*)\s*°?f"
PRESSURE = r"(\d+\.?\d*)\s*(bar|psi|kpa|mbar)"

# fixed values: rounded pressure factors, (from, to, multiply by, divide by, decimals shown)
PRESSURE_FACTORS = [
    ("bar", "kPa", 100.0, 1.0, 1),
    ("bar", "psi", 14.5, 1.0, 1),
    ("kpa", "bar", 1.0, 100.0, 2),
    ("kpa", "psi", 0.145, 1.0, 2),
    ("psi", "bar", 1.0, 14.5, 2),
    ("psi", "kPa", 6.89, 1.0, 2),
    ("mbar", "kPa", 1.0, 10.0, 1),
]


@dataclass(frozen=True)
class KeywordRule:
    """Holds when every keyword occurs in the lower-cased text."""

    keywords: tuple[str, ...]
    answer: str


# fixed values: context labels for known numbers, in order
CONTEXT_RULES = [
    KeywordRule(("1600", "°c"), "1600°C very high, EAF smelting."),
    KeywordRule(("35", "mw"), "35MW high power, EAFs."),
    KeywordRule(("-10", "mbar"), "-10mbar slight vacuum, furnace extraction."),
    KeywordRule(("10", "mg/nm"), "10mg/Nm³ emission limit particulates."),
]

def first_rule(text: Column, rules: Sequence[KeywordRule], default: Column | None = None) -> Column:
    """Answer of the first rule whose keywords all occur, else the default."""
    low = F.lower(text)
    out: Column | None = None
    for rule in rules:
        holds = F.lit(True)
        for word in rule.keywords:
            holds = holds & low.contains(word)
        out = F.when(holds, rule.answer) if out is None else out.when(holds, rule.answer)
    fallback = F.lit(None).cast("string") if default is None else default
    return fallback if out is None else out.otherwise(fallback)


def general_information(text: Column, rules: Sequence[KeywordRule]) -> Column:
    """The answer of the caller's first rule that fits a question, null without one."""
    return first_rule(text, rules)


def to_fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def to_celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")


def phrase_parts(text: Column) -> dict[str, Column]:
    """What a phrase asks for: the rule that applies, the amount, its unit."""
    low = F.lower(text)
    celsius, fahrenheit, pressure = _number(low, CELSIUS), _number(low, FAHRENHEIT), _number(low, PRESSURE)
    wants_f = low.contains("to f") | low.contains("fahrenheit")
    wants_c = low.contains("to c") | low.contains("celsius")
    by_c, by_f, by_p = celsius.isNotNull() & wants_f, fahrenheit.isNotNull() & wants_c, pressure.isNotNull()
    label = first_rule(low, CONTEXT_RULES)
    return {
        "rule": F.when(by_c, "temperature").when(by_f, "temperature").when(by_p, "pressure")
        .when(label.isNotNull(), "context").otherwise("none"),
        "amount": F.when(by_c, celsius).when(by_f, fahrenheit).when(by_p, pressure),
        "unit": F.when(by_c, "°C").when(by_f, "°F").when(by_p, F.regexp_extract(low, PRESSURE, 2)),
        "label": F.when(~(by_c | by_f | by_p), label),
    }


def phrase_results(amount: Column, unit: Column) -> Column:
    """Array of (unit, value, shown decimals) an amount converts to; empty when nothing applies."""
    cells = [
        F.when(unit == "°C", _cell("°F", to_fahrenheit(amount), 1)),
        F.when(unit == "°F", _cell("°C", to_celsius(amount), 1)),
        *[F.when(unit == a, _cell(b, amount * m / d, n)) for a, b, m, d, n in PRESSURE_FACTORS],
    ]
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def _cell(unit: str, value: Column, decimals: int) -> Column:
    return F.struct(F.lit(unit).alias("unit"), value.alias("value"), F.lit(decimals).alias("decimals"))


def convert(value: Column, unit: Column, target: str) -> Column:
    """Typed conversion of a reading to ``target``; null when the units do not go together."""
    low = F.lower(unit)
    out = F.when(low == target.lower(), value)
    if target == "°F":
        out = out.when(low == "°c", to_fahrenheit(value))
    if target == "°C":
        out = out.when(low == "°f", to_celsius(value))
    for a, b, m, d, _ in PRESSURE_FACTORS:
        if b.lower() == target.lower():
            out = out.when(low == a, value * m / d)
    return out
