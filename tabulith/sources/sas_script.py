"""SAS output: a CSV file and the program that reads it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.temporal import SAS_DAYS


def sas_names(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        name = re.sub(r"[^A-Za-z0-9_]", "_", name)[:32] or "_"
        name = ("_" + name)[:32] if name[0].isdigit() else name
        made, k = name, 1
        while made.lower() in {x.lower() for x in out}:
            made, k = f"{name[: 31 - len(str(k))]}_{k}", k + 1
        out.append(made)
    return out


def sas_csv(df: DataFrame) -> DataFrame:
    """Dates as days and datetimes as seconds since 1960, booleans as 0 and 1, under valid names."""
    out = []
    for f, name in zip(df.schema.fields, sas_names(df.columns), strict=True):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.datediff(c, F.lit("1970-01-01").cast("date")) + SAS_DAYS
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.timestamp_diff("SECOND", F.lit("1960-01-01 00:00:00").cast(f.dataType), c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(name))
    return df.select(*out)


def sas_program(df: DataFrame, csv_path: str, labels: dict[str, str] | None = None, value_labels: dict[str, dict] | None = None, dataset: str = "data") -> str:
    """PROC FORMAT for value labels, then the DATA step with lengths, formats, labels and input."""
    names = dict(zip(df.columns, sas_names(df.columns), strict=True))
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    widths = df.agg(*(F.max(F.octet_length(f"`{c}`")).alias(f"w{i}") for i, c in enumerate(text))).first() if text else []
    out = []
    if value_labels:
        out.append("proc format;")
        for c, words in sorted(value_labels.items()):
            mark = "$" if c in text else ""
            out.append(f"  value {mark}{names[c][:30]}_f " + " ".join(f"{quoted(k) if mark else k}={quoted(w)}" for k, w in sorted(words.items())) + ";")
        out.append("run;")
    out += [f"data {dataset};", f"  infile {quoted(csv_path)} dsd firstobs=2 truncover lrecl=1048576;"]
    for i, c in enumerate(text):
        out.append(f"  length {names[c]} ${max(1, widths[i] or 1)};")
    for f in df.schema.fields:
        kind = "yymmdd10." if isinstance(f.dataType, T.DateType) else "datetime20." if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else None
        if f.name in (value_labels or {}):
            kind = f"{'$' if f.name in text else ''}{names[f.name][:30]}_f."
        if kind:
            out.append(f"  format {names[f.name]} {kind};")
        if (labels or {}).get(f.name):
            out.append(f"  label {names[f.name]}={quoted(labels[f.name])};")
    out.append("  input " + " ".join(names[c] + (" $" if c in text else "") for c in df.columns) + ";")
    return "\n".join([*out, "run;", ""])


def quoted(s) -> str:
    return "'" + str(s).replace("'", "''") + "'"
