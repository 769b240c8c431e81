"""Colours as column functions: luminance, contrast, CIELAB, CIEDE2000 and how colour-blind people see them.

A colour is a struct of three sRGB channels from 0 to 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the sRGB to XYZ conversion under D65, and of its white.
_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
_WHITE = (0.95047, 1.0, 1.08883)
#: Fixed values of published simulations in linear light.
SIMULATIONS = {
    "protan": ((0.152286, 1.052583, -0.204868), (0.114503, 0.786281, 0.099216), (-0.003882, -0.048116, 1.051998)),
    "deutan": ((0.367322, 0.860646, -0.227968), (0.280085, 0.672501, 0.047413), (-0.01182, 0.04294, 0.968881)),
    "tritan": ((1.255528, -0.076749, -0.178779), (-0.078411, 0.930809, 0.147602), (0.004733, 0.691367, 0.3039)),
}
CHANNELS = ("r", "g", "b")


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """A colour from channels of 0 to 255."""
    return F.struct(*((c.cast("double") / 255).alias(n) for n, c in zip(CHANNELS, (red, green, blue))))


def from_hex(text: Column) -> Column:
    """A colour from #rrggbb; anything else is an error."""
    digits = F.regexp_extract(F.lower(text), "^#?([0-9a-f]{6})$", 1)
    sound = F.when(F.length(digits) == 6, digits).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), F.coalesce(text, F.lit("null")))).cast("string"))
    return rgb(*(F.conv(F.substring(sound, k, 2), 16, 10).cast("int") for k in (1, 3, 5)))


def linear(value: Column) -> Column:
    return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def encoded(value: Column) -> Column:
    return F.when(value <= 0.0031308, value * 12.92).otherwise(1.055 * F.pow(value, F.lit(1 / 2.4)) - 0.055)


def _mixed(weights: tuple[float, float, float], colour: Column) -> Column:
    return reduce(lambda a, b: a + b, (w * linear(colour[c]) for w, c in zip(weights, CHANNELS)))


def luminance(colour: Column) -> Column:
    return _mixed(_XYZ[1], colour)


def contrast(a: Column, b: Column) -> Column:
    """From 1, for equal luminance, to 21."""
    x, y = luminance(a) + 0.05, luminance(b) + 0.05
    return F.greatest(x, y) / F.least(x, y)


def light(colour: Column) -> Column:
    """A colour's channels in linear light."""
    return F.struct(*(linear(colour[c]).alias(c) for c in CHANNELS))


def seen_light(of: Column, kind: str) -> Column:
    """Linear light as people with protan, deutan or tritan vision see it."""
    mixed = (reduce(lambda x, y: x + y, (w * of[c] for w, c in zip(row, CHANNELS))) for row in SIMULATIONS[kind])
    return F.struct(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), m)).alias(c) for c, m in zip(CHANNELS, mixed)))


def with_lab(rows: DataFrame, of: str, name: str) -> DataFrame:
    """rows with the CIELAB struct (l, a, b) of a column of linear light, its quantities one after the other."""
    f = lambda v: F.when(F.col(v) > 0.008856, F.cbrt(v)).otherwise(7.787 * F.col(v) + 16 / 116)
    xyz = {f"_{n}": reduce(lambda x, y: x + y, (w * F.col(of)[c] for w, c in zip(row, CHANNELS))) / white for n, row, white in zip("xyz", _XYZ, _WHITE)}
    out = rows.withColumns(xyz).withColumns({f"_f{n}": f(f"_{n}") for n in "xyz"})
    lab = F.struct((116 * F.col("_fy") - 16).alias("l"), (500 * (F.col("_fx") - F.col("_fy"))).alias("a"), (200 * (F.col("_fy") - F.col("_fz"))).alias("b"))
    return out.withColumn(name, lab).drop(*xyz, "_fx", "_fy", "_fz")


def lch(at: Column) -> Column:
    """CIELCh of a CIELAB struct as a struct l, c, h, the hue in degrees from 0."""
    return F.struct(at["l"].alias("l"), F.hypot(at["a"], at["b"]).alias("c"), F.pmod(F.degrees(F.atan2(at["b"], at["a"])) + 360, F.lit(360.0)).alias("h"))


def over(front: Column, back: Column, opacity: float) -> Column:
    """One colour over another, mixed in linear light."""
    return F.struct(*(encoded(linear(front[c]) * opacity + linear(back[c]) * (1 - opacity)).alias(c) for c in CHANNELS))


def seen_by(colour: Column, kind: str) -> Column:
    """A colour as people with protan, deutan or tritan vision see it."""
    seen = seen_light(light(colour), kind)
    return F.struct(*(encoded(seen[c]).alias(c) for c in CHANNELS))


def with_difference(pairs: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """pairs with the CIEDE2000 difference of two columns of CIELAB structs.

    Its quantities are columns one after the other, so that none is written out twice in the plan.
    """
    far = 25.0**7
    seventh = lambda c: F.sqrt(F.pow(F.col(c), F.lit(7)) / (F.pow(F.col(c), F.lit(7)) + far))
    side = lambda k: F.col((first, second)[k])
    turn = lambda degrees: F.cos(F.radians(degrees))
    steps = [
        {"_c": (F.hypot(side(0)["a"], side(0)["b"]) + F.hypot(side(1)["a"], side(1)["b"])) / 2},
        {"_g": 1 + 0.5 * (1 - seventh("_c"))},
        {f"_a{k}": F.col("_g") * side(k)["a"] for k in (0, 1)},
        {f"_c{k}": F.hypot(F.col(f"_a{k}"), side(k)["b"]) for k in (0, 1)} | {f"_h{k}": F.pmod(F.degrees(F.atan2(side(k)["b"], F.col(f"_a{k}"))) + 360, F.lit(360.0)) for k in (0, 1)},
        {"_grey": F.col("_c0") * F.col("_c1") == 0, "_apart": F.col("_h1") - F.col("_h0"), "_both": F.col("_h1") + F.col("_h0")},
        {
            "_dh": F.when(F.col("_grey"), 0.0).when(F.col("_apart") > 180, F.col("_apart") - 360).when(F.col("_apart") < -180, F.col("_apart") + 360).otherwise(F.col("_apart")),
            "_h": F.when(F.col("_grey"), F.col("_both")).when(F.abs("_apart") <= 180, F.col("_both") / 2).when(F.col("_both") < 360, F.col("_both") / 2 + 180).otherwise(F.col("_both") / 2 - 180),
            "_l": (side(0)["l"] + side(1)["l"]) / 2 - 50,
            "_m": (F.col("_c0") + F.col("_c1")) / 2,
        },
        {"_t": 1 - 0.17 * turn(F.col("_h") - 30) + 0.24 * turn(2 * F.col("_h")) + 0.32 * turn(3 * F.col("_h") + 6) - 0.2 * turn(4 * F.col("_h") - 63)},
        {
            "_el": (side(1)["l"] - side(0)["l"]) / (1 + 0.015 * F.col("_l") * F.col("_l") / F.sqrt(20 + F.col("_l") * F.col("_l"))),
            "_ec": (F.col("_c1") - F.col("_c0")) / (1 + 0.045 * F.col("_m")),
            "_eh": 2 * F.sqrt(F.col("_c0") * F.col("_c1")) * F.sin(F.radians(F.col("_dh") / 2)) / (1 + 0.015 * F.col("_m") * F.col("_t")),
            "_turned": -2 * seventh("_m") * F.sin(F.radians(60 * F.exp(-F.pow((F.col("_h") - 275) / 25, F.lit(2))))),
        },
        {name: F.sqrt(F.greatest(F.lit(0.0), F.col("_el") * F.col("_el") + F.col("_ec") * F.col("_ec") + F.col("_eh") * F.col("_eh") + F.col("_turned") * F.col("_ec") * F.col("_eh")))},
    ]
    out = pairs
    for step in steps:
        out = out.withColumns(step)
    return out.drop(*(k for step in steps[:-1] for k in step))


def hue_apart(a: Column, b: Column) -> Column:
    """Degrees between two hues, 180 at most."""
    apart = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(apart, 360 - apart)
