"""Matrices (a, b, c, d, e, f), boxes (x0, y0, x1, y1) and colours as structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def then(m: Column, n: Column) -> Column:
    """Apply m, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"), (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"), (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def invert(m: Column) -> Column:
    """Null where m is singular."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    return F.when(
        det != 0,
        F.struct(
            (m["d"] / det).alias("a"), (-m["b"] / det).alias("b"), (-m["c"] / det).alias("c"), (m["a"] / det).alias("d"),
            ((m["c"] * m["f"] - m["d"] * m["e"]) / det).alias("e"), ((m["b"] * m["e"] - m["a"] * m["f"]) / det).alias("f"),
        ),
    )


def intersect(a: Column, b: Column) -> Column:
    """Null where the boxes do not overlap."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def quarter_turns(degrees: Column) -> Column:
    """0, 90, 180 or 270; null for other angles."""
    turn = F.pmod(degrees, F.lit(360))
    return F.when(turn % 90 == 0, turn)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(*[F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), x + k)).alias(n) for x, n in ((c, "r"), (m, "g"), (y, "b"))])


def blend(mode: str, b: Column, s: Column) -> Column:
    """One channel of backdrop b and source s, by a separable mode."""
    soft = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    hard = F.when(s <= 0.5, 2 * b * s).otherwise(b + (2 * s - 1) - b * (2 * s - 1))
    return {
        "normal": s, "multiply": b * s, "screen": b + s - b * s, "darken": F.least(b, s), "lighten": F.greatest(b, s), "difference": F.abs(b - s), "exclusion": b + s - 2 * b * s, "hard_light": hard,
        "overlay": F.when(b <= 0.5, 2 * b * s).otherwise(s + (2 * b - 1) - s * (2 * b - 1)),
        "dodge": F.when(b == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), b / (1 - s))),
        "burn": F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - b) / s)),
        "soft_light": F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (soft - b)),
    }[mode]
