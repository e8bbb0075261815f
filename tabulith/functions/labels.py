"""Value labels as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label sets beyond this are joined, not written into the plan.
MOST_LITERALS = 1000


def number_text(c: Column) -> Column:
    """Whole numbers without decimals; others as Spark writes them."""
    d = c.cast("double")
    return F.when((d % 1 == 0) & (F.abs(d) < 9e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def decode_label(c: Column, labels: dict, text: bool = False) -> Column:
    """The label, else the value's own text; null stays null."""
    own = c if text else number_text(c)
    if not labels:
        return own
    kind = "string" if text else "double"
    pairs = [F.lit(x).cast(kind) if i % 2 == 0 else F.lit(x) for kv in sorted(labels.items()) for i, x in enumerate(kv)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c.cast(kind)), own)


def decode_labels(df: DataFrame, sets: dict[str, dict]) -> DataFrame:
    """Replaces the named columns by their labels; large sets go through a join."""
    for name, labels in sets.items():
        text = df.schema[name].dataType.simpleString() == "string"
        if len(labels) <= MOST_LITERALS:
            df = df.withColumn(name, decode_label(F.col(name), labels, text))
            continue
        kind = "string" if text else "double"
        table = df.sparkSession.createDataFrame(sorted(labels.items()), f"__key {kind}, __label string")
        own = F.col(name) if text else number_text(F.col(name))
        names = df.columns
        df = df.join(table, df[name].cast(kind) == table["__key"], "left").withColumn(name, F.coalesce("__label", own)).select(*names)
    return df
