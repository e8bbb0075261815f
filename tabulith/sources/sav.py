"""SPSS system files as a Spark data source, and the sink that writes them.

Partitions of a plain file are ranges of cases. Compressed files have no index by case, so one
task reads them in order, a bounded batch at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulith.formats import spss as S
from tabulith.formats.text import labelled, plain
from tabulith.sources import sink
from tabulith.sources.base import Options, RecordReader, Rows, load, opened, tag_field

TYPES = {"string": T.StringType(), "number": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "time": T.LongType()}


class SavSource(DataSource):
    __doc__ = Options.__doc__

    @classmethod
    def name(cls) -> str:
        return "sav"

    def _plan(self) -> tuple[Options, S.Dictionary, list[S.Variable]]:
        o = Options(self.options)
        with opened(o.path) as f:
            d = S.read_dictionary(f)
            if d.rows < 0 and d.compression == 0 and d.cells:
                d.rows = (f.size() - d.data_at) // (8 * d.cells)
        return o, d, o.pick(d.variables, S.SpssError)

    def schema(self) -> T.StructType:
        o, d, wanted = self._plan()
        tagged = lambda v: o.has_tag(v.name, bool(v.discrete or v.span))
        o.check_tags((v.name for v in d.variables), (v.name for v in wanted if tagged(v)), S.SpssError)
        fields = []
        for v in wanted:
            words = {str(k): w for k, w in v.labels.items()}
            meta = {"label": v.label, "format": str(v.print_format)} | ({"value_labels": json.dumps(words)} if words and not o.labels else {})
            fields.append(T.StructField(v.name, T.StringType() if o.labels and v.labels else TYPES[v.kind], True, meta))
            if tagged(v):
                fields.append(tag_field(v.name, o.suffix))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SavReader(*self._plan())


class SavReader(RecordReader):
    def __init__(self, o: Options, d: S.Dictionary, wanted: list[S.Variable]):
        super().__init__(o, wanted)
        self.d = d

    def partitions(self) -> list[InputPartition]:
        d, o = self.d, self.o
        if d.compression or d.rows < 0:
            return [Rows(o.offset, None if o.limit is None else o.offset + o.limit)]
        return o.split(*o.window(d.rows), d.cells * 8)

    def blocks(self, part: Rows) -> Iterator[np.ndarray]:
        with opened(self.o.path) as f:
            yield from S.cases(f, self.d, part.start, part.stop, self.o.rows_at_once(self.d.cells * 8))

    def arrays(self, v: S.Variable, rows: np.ndarray) -> Iterator[tuple[str, pa.Array]]:
        x, ok, declared = S.decode(self.d, v, rows)
        if v.width:
            gone = declared if not self.o.empty else ~ok
            words = pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), x)
            if self.o.labels and v.labels:
                words = said(words, v.labels)
            yield v.name, words
        elif self.o.labels and v.labels:
            yield v.name, labelled(x, ok, v.labels)
        else:
            yield v.name, temporal_array(x, ok, v.kind)
        if self.o.has_tag(v.name, bool(v.discrete or v.span)):
            if v.width:
                yield v.name + self.o.suffix, pc.if_else(pa.array(declared), said(x, v.labels), pa.scalar(None, pa.string()))
            else:
                keys, back = np.unique(np.where(declared, x, 0.0), return_inverse=True)
                words = pa.array([v.labels.get(k) or (plain(k) if k in v.discrete else "MISSING") for k in keys.tolist()], pa.string())
                yield v.name + self.o.suffix, words.take(pa.array(back.ravel(), mask=~declared))


def said(words: pa.Array, labels: dict[str, str]) -> pa.Array:
    """Labels of texts, else the texts themselves."""
    if not labels:
        return words
    at = pc.index_in(words, value_set=pa.array(list(labels), pa.string()))
    return pc.coalesce(pa.array(list(labels.values()), pa.string()).take(at), words)


def temporal_array(x: np.ndarray, ok: np.ndarray, kind: str) -> pa.Array:
    if kind == "number":
        return pa.array(x, mask=~ok)
    ok = ok & (np.abs(x) < 9e12)
    whole = np.trunc(np.where(ok, x, 0)).astype(np.int64)
    if kind == "time":
        return pa.array(whole * 1_000_000, pa.int64(), mask=~ok)
    seconds = whole - S.EPOCH
    if kind == "datetime":
        return pa.array(seconds * 1_000_000, pa.timestamp("us"), mask=~ok)
    days = np.sign(seconds) * (np.abs(seconds) // 86_400)  # toward zero
    ok = ok & (days >= -719162) & (days <= 2932896)  # beyond the calendar there is no date
    return pa.array(np.where(ok, days, 0).astype(np.int32), pa.int32(), mask=~ok).cast(pa.date32())


def scan_sav(spark: SparkSession, path: str, **options) -> DataFrame:
    return load(spark, SavSource, path, options)


# ---- sink -----------------------------------------------------------------------------------


def write_sav(df: DataFrame, path: str, value_labels: dict[str, dict[float, str]] | None = None, variable_labels: dict[str, str] | None = None, order_by: list[str] | None = None) -> list[S.Variable]:
    """Writes one plain .sav file; widths come from one aggregation over the frame.

    Text is Windows-1252 where all of it can be, else UTF-8. Labels in the schema's metadata win over those given.
    """
    value_labels, variable_labels = sink.labels_of(df, value_labels, variable_labels)
    if order_by:
        df = df.orderBy(*order_by)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.lit(0).alias("none")]
    for k, c in enumerate(strings):
        aggs += [F.max(F.octet_length(f"`{c}`")).alias(f"w{k}"), F.max(F.length(f"`{c}`")).alias(f"n{k}"), F.max(F.col(f"`{c}`").rlike(S.NOT_WESTERN)).alias(f"u{k}")]
    got = df.agg(*aggs).first()
    words = [*df.columns, *variable_labels.values(), *(w for s in value_labels.values() for w in s.values())]
    utf8 = any(got[f"u{k}"] for k in range(len(strings))) or any(w != w.encode("cp1252", "ignore").decode("cp1252") for w in words)
    variables, columns, cell = [], [], 0
    for f, short in zip(df.schema.fields, S.short_names(df.columns), strict=True):
        c, t, width, shown = F.col(f"`{f.name}`"), f.dataType, 0, 5 << 16 | 8 << 8 | 2
        if len(f.name.encode()) > 64:
            raise S.SpssError(f"{f.name}: names have 64 bytes at most")
        if isinstance(t, T.StringType):
            width = max(1, got[f"{'w' if utf8 else 'n'}{strings.index(f.name)}"] or 1)
            if width > 255:
                raise S.SpssError(f"{f.name}: strings of more than 255 bytes are not written")
            if f.name in value_labels:
                raise S.SpssError(f"{f.name}: value labels are written for numbers only")
            shown = 1 << 16 | width << 8
        elif isinstance(t, T.DateType):
            c, shown = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double") * 86_400 + S.EPOCH, 20 << 16 | 11 << 8
        elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
            c, shown = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast(t), c).cast("double") + S.EPOCH, 22 << 16 | 20 << 8
        elif isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            c = c.cast("double")
        else:
            raise S.SpssError(f"{f.name}: unsupported type {t.simpleString()}")
        v = S.Variable(short.encode(), width, cell, shown, f.name, variable_labels.get(f.name, ""), max(1, -(-width // 8)), labels=value_labels.get(f.name, {}))
        variables.append(v)
        columns.append(c.alias(f.name))
        cell += v.cells

    folder = sink.parts_folder(path)
    try:
        parts = sink.write_parts(df.select(*columns), folder, 1, lambda b, first: (S.encode(variables, b.columns, utf8),))
        head = S.head(variables, sum(p.rows for p in parts), utf8)
        sink.assemble(df.sparkSession, path, folder, parts, [head, b""], [8 * cell], [None])
    finally:
        sink.drop_folder(folder)
    return variables
