"""Parameters, bands, rounding and display values as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the queries' parameters.
REACH_LEVELS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
DEFAULT_REACH_LEVEL = 4.0
RADIUS_MIN_KM, RADIUS_MAX_KM = 50.0, 20_000.0
SLIDER_STEPS = 1000
ALPHA_MIN, ALPHA_MAX, ALPHA_STEP, DEFAULT_ALPHA = 0.1, 1.0, 0.01, 0.5
RATIO_BELOW, RATIO_ABOVE = (0.1, 0.25, 0.5), (2.0, 4.0, 10.0)


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def clamp_alpha(x: Column) -> Column:
    return F.when(x.isNotNull(), round_half_up(F.least(F.lit(ALPHA_MAX), F.greatest(F.lit(ALPHA_MIN), x)) * 100) / 100.0)


def parse_alpha(text: Column) -> Column:
    """Anything that isn't a number gives the default."""
    value = F.when(F.regexp_like(F.trim(text), F.lit(r"^[0-9]*\.?[0-9]+$")), text.try_cast("double"))
    return F.coalesce(clamp_alpha(value), F.lit(DEFAULT_ALPHA))


def round_radius(km: Column) -> Column:
    """Held within the domain, then rounded to 1 below 200 km, 5 below 2000 km and 10 above."""
    r = F.least(F.lit(RADIUS_MAX_KM), F.greatest(F.lit(RADIUS_MIN_KM), km))
    step = F.when(r < 200, 1.0).when(r < 2000, 5.0).otherwise(10.0)
    return F.least(F.lit(RADIUS_MAX_KM), F.greatest(F.lit(RADIUS_MIN_KM), round_half_up(r / step) * step))


def radius_to_slider(km: Column) -> Column:
    """Whole steps from 0 to SLIDER_STEPS, logarithmic."""
    r = F.least(F.lit(RADIUS_MAX_KM), F.greatest(F.lit(RADIUS_MIN_KM), km))
    return round_half_up((F.log(r) - F.log(F.lit(RADIUS_MIN_KM))) / F.log(F.lit(RADIUS_MAX_KM / RADIUS_MIN_KM)) * SLIDER_STEPS)


def slider_to_radius(s: Column) -> Column:
    t = F.least(F.lit(float(SLIDER_STEPS)), F.greatest(F.lit(0.0), s)) / SLIDER_STEPS
    return round_radius(RADIUS_MIN_KM * F.exp(t * F.log(F.lit(RADIUS_MAX_KM / RADIUS_MIN_KM))))


def parse_radius(text: Column) -> Column:
    """One to five digits within the domain; else null."""
    value = F.when(F.regexp_like(text, F.lit(r"^\d{1,5}$")), text.try_cast("double"))
    return F.when(value.between(RADIUS_MIN_KM, RADIUS_MAX_KM), value)


def parse_reach_level(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(value.isin(*REACH_LEVELS), value).otherwise(F.lit(DEFAULT_REACH_LEVEL))


def ratio_band(ratio: Column) -> Column:
    """0 to 6 around 1; bounds belong to the outer band; -1 where the ratio is missing."""
    out = F.when(ratio.isNull() | F.isnan(ratio), -1)
    for k, t in enumerate(RATIO_BELOW):
        out = out.when(ratio <= t, k)
    for k, t in reversed(list(enumerate(RATIO_ABOVE, 4))):
        out = out.when(ratio >= t, k)
    return out.otherwise(3)


def crossing_band(crossings: Column) -> Column:
    """1, 2, 3-4, 5-6, 7-9, 10 and more; null below 1."""
    return F.when(crossings < 1, None).when(crossings <= 2, crossings.cast("int")).when(crossings <= 4, 3).when(crossings <= 6, 4).when(crossings <= 9, 5).otherwise(6)


def density_byte(population: Column, area_km2: Column) -> Column:
    """0 to 254 for the logarithm of density, 255 where there is none."""
    share = F.least(F.lit(1.0), F.log10(1 + population / area_km2) / 4)
    return F.coalesce(round_half_up(share * 254), F.lit(255)).cast("int")


def display_density(population: Column, area_km2: Column) -> Column:
    """0 without people, else at least 1."""
    share = F.least(F.lit(1.0), F.log10(1 + population / area_km2) / 4)
    return F.when(population <= 0, 0).otherwise(F.greatest(F.lit(1), round_half_up(share * 255))).cast("int")


def layer_alpha(alphas: Column) -> Column:
    """What is covered by layers of these opacities, one over the other."""
    return 1 - F.aggregate(alphas, F.lit(1.0), lambda acc, a: acc * (1 - a))


def rgb24(count: Column) -> dict[str, Column]:
    """A count below 2**24 as three bytes, highest first."""
    return {"r": F.shiftright(count, 16).bitwiseAND(F.lit(255)), "g": F.shiftright(count, 8).bitwiseAND(F.lit(255)), "b": count.bitwiseAND(F.lit(255))}


def owner_from_rgb(r: Column, g: Column, b: Column) -> Column:
    """The owner id in the two lower bytes; a third byte that isn't 0 is an error."""
    return F.when(b == 0, r + F.shiftleft(g.cast("int"), 8)).otherwise(F.raise_error(F.lit("owner pixel with a third byte")).cast("int"))


def mask_bit(mask: Column, bit: int) -> Column:
    return F.shiftright(mask, bit).bitwiseAND(F.lit(1)) == 1


def gate_non_negative(x: Column, most: float | None = None) -> Column:
    """x, or an error where it is negative, not a number or above most."""
    bad = (x < 0) | F.isnan(x) if most is None else (x < 0) | F.isnan(x) | (x > most)
    return F.when(bad, F.raise_error(F.lit("value out of range")).cast("double")).otherwise(x)


def travel_hours(friction_a: Column, friction_b: Column, length_m: Column) -> Column:
    """Minutes a metre on both cells, averaged, over a length."""
    return (friction_a + friction_b) / 2 * length_m / 60


def status_key(status: Column) -> Column:
    """The message of a city's reach status."""
    known = ("ok", "root", "no_larger_reachable", "merged_at_resolution", "transport_missing", "disputed")
    return reduce(lambda acc, s: acc.when(status == s, f"reach.{s}"), known, F.when(status.isNull(), "reach.unknown")).otherwise("reach.unknown")


def format_share(share: Column) -> Column:
    """A percentage with one decimal; small shares as an upper bound."""
    return F.when(share.isNull(), None).when((share > 0) & (share < 0.001), "<0.1%").otherwise(F.format_string("%.1f%%", share * 100))


def display_name(zh: Column, en: Column, locale: str) -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(zh), filled(en)) if locale == "zh" else filled(en)
