"""Permission names, bits and decisions of protected documents, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions import text as T

#: The bits of a /P value that a caller may grant, and the value that grants everything.
GRANTABLE = {"print": 4, "modify": 8, "copy": 16, "annotate": 32}
EVERYTHING = 0xFFFFFFFC
#: The bit of a grant that each operation needs.
NEEDED = {"print": 1 << 3, "copy": 1 << 5, "annotate": 1 << 6, "redact": 1 << 4, "edit": 1 << 4, "fill": 1 << 9}


def _names(mask: Column, held: bool) -> Column:
    names = [F.when((mask.bitwiseAND(F.lit(bit)) != 0) == held, F.lit(name)) for name, bit in GRANTABLE.items()]
    return F.array_compact(F.array(*names))


def grants(spec: Column) -> Column:
    """'print,copy' to (mask, error): any case and white space; 'none' grants nothing; an unknown or empty name is refused."""
    spec = F.lower(T.strip(F.coalesce(spec, F.lit(""))))
    names = F.transform(F.split(spec, ","), T.strip)
    strange = F.get(F.filter(names, lambda n: ~n.isin(*GRANTABLE)), F.lit(0))
    error = (
        F.when(spec == "", "empty permission spec (expected e.g. `print,copy` or `none`)").when(spec == "none", F.lit(None))
        .when(strange.isNotNull(), F.concat(F.lit("unknown permission `"), strange, F.lit(f"` (valid: {', '.join(GRANTABLE)})")))
    )
    mask = reduce(lambda a, b: a + b, [F.when(F.array_contains(names, n), b).otherwise(0) for n, b in GRANTABLE.items()]).cast("long")
    return F.struct(F.when(error.isNull(), mask).alias("mask"), error.alias("error"))


def p_value(mask: Column) -> Column:
    """The /P value, unsigned, that grants mask and all that cannot be denied."""
    every = sum(GRANTABLE.values())
    return F.lit(EVERYTHING - every).cast("long").bitwiseOR(mask.bitwiseAND(F.lit(every)))


def granted(mask: Column) -> Column:
    return _names(mask, True)


def denied(p: Column) -> Column:
    """The grantable names that a /P value withholds."""
    return _names(p, False)


def restrict(a: Column, b: Column) -> Column:
    """What both grants allow."""
    return a.bitwiseAND(b)


def _holds(bits: Column, operation: Column) -> Column:
    need = F.create_map(*[F.lit(x) for pair in NEEDED.items() for x in pair])
    return bits.bitwiseAND(F.element_at(need, operation).cast("long")) != 0


def may(bits: Column, operation: Column, owner: Column) -> Column:
    """Whether a grant's bits or being the owner allow an operation; null for an unknown one."""
    return F.when(_holds(bits, operation).isNotNull(), _holds(bits, operation) | F.coalesce(owner, F.lit(False)))


def decision(bits: Column, operation: Column, owner: Column, wish: Column) -> Column:
    """'honour' or 'override': only an owner whom the bits deny may override, and does unless they wish otherwise."""
    return F.when(_holds(bits, operation) | ~F.coalesce(owner, F.lit(False)), "honour").otherwise(F.coalesce(wish, F.lit("override")))
