"""Lengths, colours and part names of vector and package formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions import text as T

#: What a length of each unit is multiplied by, then divided by.
UNITS = {"": (1.0, 1.0), "px": (1.0, 1.0), "pt": (1.0, 0.75), "mm": (72.0, 25.4), "cm": (72.0, 2.54), "in": (72.0, 1.0), "pc": (12.0, 1.0)}
#: Colours known by name.
COLOURS = {
    "black": (0.0, 0.0, 0.0), "white": (1.0, 1.0, 1.0), "red": (1.0, 0.0, 0.0), "green": (0.0, 0.50196078, 0.0), "lime": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0), "yellow": (1.0, 1.0, 0.0), "cyan": (0.0, 1.0, 1.0), "aqua": (0.0, 1.0, 1.0),
    "magenta": (1.0, 0.0, 1.0), "fuchsia": (1.0, 0.0, 1.0), "gray": (0.50196078, 0.50196078, 0.50196078), "grey": (0.50196078, 0.50196078, 0.50196078), "silver": (0.7529412, 0.7529412, 0.7529412), "maroon": (0.50196078, 0.0, 0.0),
    "olive": (0.50196078, 0.50196078, 0.0), "navy": (0.0, 0.0, 0.50196078), "purple": (0.50196078, 0.0, 0.50196078), "teal": (0.0, 0.50196078, 0.50196078), "orange": (1.0, 0.6470588, 0.0),
}
#: Fixed value: a short hexadecimal digit's divisor.
SHORT = 17.0


def length_units(text: Column) -> Column:
    """'2.5 cm' in user units; null for percentages, unknown units and what is no number."""
    text = T.strip(text)
    number = F.regexp_extract(text, "^[-+.0-9]*", 0)
    unit = F.lower(T.strip(F.substr(text, F.length(number) + 1)))
    out = F.lit(None).cast("double")
    for name, (times, by) in UNITS.items():
        out = F.when(unit == name, number.try_cast("double") * times / by).otherwise(out)
    return out


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def colour(text: Column) -> Column:
    """'#f80', '#ff8800', 'rgb(100%, 50%, 0)' or a name as (r, g, b); null where nothing is painted or the colour unknown.

    A short digit is divided by 17 and not, as elsewhere, by 15.
    """
    text = F.lower(T.strip(text))
    digit = lambda at, n: F.conv(F.substr(text, F.lit(at), F.lit(n)), 16, 10).cast("double")
    inner = F.regexp_extract(text, r"^rgb\((.*)\)$", 1)
    parts = F.transform(F.filter(F.split(F.replace(inner, F.lit("%"), F.lit("")), r"[,\s]+"), lambda p: p != ""), lambda p: p.try_cast("double"))
    scale = F.when(inner.contains("%"), 100.0).otherwise(255.0)
    part = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(parts, F.lit(i)) / scale))
    out = F.when(text.rlike("^#[0-9a-f]{3}$"), _rgb(*[digit(i, 1) / SHORT for i in (2, 3, 4)])).when(text.rlike("^#[0-9a-f]{6}$"), _rgb(*[digit(i, 2) / 255.0 for i in (2, 4, 6)]))
    out = out.when((F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull()), _rgb(part(0), part(1), part(2)))
    for name, channels in COLOURS.items():
        out = out.when(text == name, _rgb(*[F.lit(c) for c in channels]))
    return out


def part_name(owner: Column, target: Column) -> Column:
    """A target's path from the owner's folder, or from the root after a slash, without empty, '.' and '..' steps."""
    target = T.strip(target)
    path = F.when(F.startswith(target, F.lit("/")) | (owner == ""), target).otherwise(F.concat(owner, F.lit("/"), target))

    def step(kept: Column, name: Column) -> Column:
        return F.when(name.isin("", "."), kept).when(name == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, name))

    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
