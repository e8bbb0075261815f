"""Type narrowing of a whole table: one aggregation decides, one projection casts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds by target type.
STANDARD = (("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647))
STATA = (("tinyint", -127, 100), ("smallint", -32767, 32740), ("int", -2147483647, 2147483620))
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


@dataclass
class CompressOptions:
    cols: list[str] | None = None
    compress_numeric: bool = True
    check_string: bool = True
    check_string_only: bool = False
    cast_all_null_to_boolean: bool = True
    check_date_time: bool = True
    no_boolean: bool = False
    stata_bounds: bool = False


def compress(df: DataFrame, options: CompressOptions | None = None) -> DataFrame:
    o = options or CompressOptions()
    names = [c for c in (o.cols or df.columns) if c in df.columns]
    aggs, casts = [F.count("*").alias("rows")], {}
    for i, name in enumerate(names):
        c, t = F.col(f"`{name}`"), df.schema[name].dataType
        v = c
        aggs.append(F.count(c).alias(f"n{i}"))
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            aggs.append(F.bool_and(c == c.cast("date").cast(t)).alias(f"day{i}"))
        if isinstance(t, T.StringType):
            s = F.trim(c)
            aggs.append(F.bool_and((s == "") | F.lower(s).rlike(NUMBER) | c.isNull()).alias(f"num{i}"))
            v = F.when(F.lower(s).rlike(NUMBER), s).try_cast("double")
            aggs.append(F.count(v).alias(f"m{i}"))
        if isinstance(t, (T.NumericType, T.StringType)):
            if isinstance(t, (T.FloatType, T.DoubleType, T.StringType)):
                aggs.append(F.bool_and(v % 1 == 0).alias(f"whole{i}"))
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    got = df.agg(*aggs).first()
    for i, name in enumerate(names):
        c, t, n = F.col(f"`{name}`"), df.schema[name].dataType, got[f"n{i}"]
        if o.check_date_time and isinstance(t, (T.TimestampType, T.TimestampNTZType)) and got[f"day{i}"] is not False:
            casts[name] = c = c.cast("date")
        number = isinstance(t, T.NumericType)
        if o.check_string and isinstance(t, T.StringType) and got["rows"] and got[f"num{i}"] is not False and n:
            casts[name] = c = F.when(F.trim(c) != "", F.trim(c)).try_cast("double")
            number, n = True, got[f"m{i}"]
        if o.check_string_only:
            continue
        if o.cast_all_null_to_boolean and got["rows"] and not n:
            casts[name] = F.lit(None).cast("boolean")
        elif o.compress_numeric and number and n:
            if isinstance(t, (T.FloatType, T.DoubleType, T.StringType)) and got[f"whole{i}"] is not True:
                casts[name] = c.cast("double")
                continue
            lo, hi = got[f"lo{i}"], got[f"hi{i}"]
            if not o.no_boolean and lo >= 0 and hi <= 1:
                casts[name] = c.cast("boolean")
            else:
                to = next((k for k, a, z in (STATA if o.stata_bounds else STANDARD) if a <= lo and hi <= z), None)
                casts[name] = c.cast(to or ("bigint" if isinstance(t, T.LongType) and not o.stata_bounds else "double"))
    return df.select(*(casts[c].alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns))
