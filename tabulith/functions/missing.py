"""Missing-value rules of the formats on decoded numbers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code of "." in each Stata integer type; .a to .z follow.
STATA_DOT = {"byte": 101, "int": 32741, "long": 2147483621}


def stata_value(c: Column, kind: str) -> Column:
    return F.when(c < STATA_DOT[kind], c)


def stata_tag(c: Column, kind: str) -> Column:
    """.a to .z, null for values and for "."."""
    k = c.cast("long") - STATA_DOT[kind]
    return F.when((k >= 1) & (k <= 26), F.concat(F.lit("."), F.char((k + 96).cast("int"))))


def spss_is_missing(c: Column, discrete: list[float] = (), between: tuple[float, float] | None = None) -> Column:
    out = F.lit(False)
    if discrete:
        out = out | c.isin(*discrete)
    if between:
        out = out | c.between(*between)
    return out


def spss_value(c: Column, discrete: list[float] = (), between: tuple[float, float] | None = None) -> Column:
    return F.when(~spss_is_missing(c, discrete, between), c)


def spss_tag(c: Column, discrete: list[float] = (), between: tuple[float, float] | None = None, labels: dict[float, str] | None = None) -> Column:
    """The label of a declared missing value, else its text if it is a single one, MISSING in a range."""
    out = F.lit(None).cast("string")
    if between:
        out = F.when(c.between(*between), F.lit("MISSING")).otherwise(out)
    for v in discrete:
        out = F.when(c == v, F.lit(f"{v:.15g}")).otherwise(out)
    for v, word in sorted((labels or {}).items()):
        out = F.when((c == v) & spss_is_missing(c, discrete, between), F.lit(word)).otherwise(out)
    return out


def blank_as_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)
