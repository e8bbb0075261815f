"""Informative nulls: what kind of missing a null was, beside, inside or merged into its column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def informative_nulls(df: DataFrame, tags: dict[str, Column], mode: str = "separate", suffix: str = "_null") -> DataFrame:
    """tags: the indicator expression of each column. Modes: separate (a column after it), struct, merged."""
    out = []
    for c in df.columns:
        if c not in tags:
            out.append(F.col(c))
        elif mode == "separate":
            if c + suffix in df.columns:
                raise ValueError(f"indicator {c + suffix} is a column of the frame")
            out += [F.col(c), tags[c].alias(c + suffix)]
        elif mode == "struct":
            out.append(F.struct(F.col(c), tags[c].alias("null_indicator")).alias(c))
        elif mode == "merged":
            out.append(F.coalesce(F.col(c).cast("string"), tags[c]).alias(c))
        else:
            raise ValueError(f"unknown mode {mode}")
    return df.select(*out)
