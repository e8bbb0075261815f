"""Stata files as a Spark data source, and the sinks that write them.

A scan's partitions are ranges of records; each task seeks to its range, decodes the columns that
filters look at, and the others for the records that pass. The sink encodes records in tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulith.formats import stata as S
from tabulith.formats.text import as_text, blank_as_null, labelled
from tabulith.sources import sink
from tabulith.sources.base import Options, RecordReader, Rows, load, opened, tag_field

TYPES = {S.BYTE: T.ByteType(), S.INT: T.ShortType(), S.LONG: T.IntegerType(), S.FLOAT: T.FloatType(), S.DOUBLE: T.DoubleType()}
DAY_MS = 86_400_000


def temporal(v: S.Variable) -> str | None:
    """datetime, time, or the period a date counts (d w m q h y), for numbers whose display format says so."""
    f = v.format.strip().lower().replace("-", "")
    if v.type not in S.KIND or not f.startswith("%"):
        return None
    f = f[2:] if f.startswith("%t") else f[1:]
    if f[:1] == "c":
        if v.type in (S.BYTE, S.INT):
            return None
        return "time" if len(f) > 1 and not any(c in f[1:] for c in "cynd") else "datetime"
    return f[:1] if f[:1] and f[0] in "dwmqhy" else None


def spark_type(d: S.Dictionary, v: S.Variable, labels: bool) -> T.DataType:
    kind = temporal(v)
    if labels and d.label_sets.get(v.label_set):
        return T.StringType()
    if kind:
        return {"datetime": T.TimestampNTZType(), "time": T.LongType()}.get(kind, T.DateType())
    return TYPES.get(v.type, T.StringType())


class DtaSource(DataSource):
    __doc__ = Options.__doc__

    @classmethod
    def name(cls) -> str:
        return "dta"

    def _plan(self) -> tuple[Options, S.Dictionary, list[S.Variable]]:
        o = Options(self.options)
        with opened(o.path) as f:
            d = S.read_dictionary(f)
        return o, d, o.pick(d.variables, S.StataError)

    def schema(self) -> T.StructType:
        o, d, wanted = self._plan()
        tagged = lambda v: o.has_tag(v.name, v.type in S.KIND)
        o.check_tags((v.name for v in d.variables), (v.name for v in wanted if tagged(v)), S.StataError)
        fields = []
        for v in wanted:
            words = d.label_sets.get(v.label_set, {})
            meta = {"label": v.label, "format": v.format} | ({"value_labels": json.dumps(words)} if words and not o.labels else {})
            fields.append(T.StructField(v.name, spark_type(d, v, o.labels), True, meta))
            if tagged(v):
                fields.append(tag_field(v.name, o.suffix))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DtaReader(*self._plan())


class DtaReader(RecordReader):
    def __init__(self, o: Options, d: S.Dictionary, wanted: list[S.Variable]):
        super().__init__(o, wanted)
        self.d, self.strls = d, {}

    def partitions(self) -> list[InputPartition]:
        d, long = self.d, sum(v.type == S.STRL for v in self.wanted)
        text = (d.labels_at - d.strls_at) // max(1, d.rows) if long else 0
        return self.o.split(*self.o.window(d.rows), d.width + text)

    def blocks(self, part: Rows) -> Iterator[np.ndarray]:
        d, batch = self.d, self.o.rows_at_once(self.d.width)
        places = [S.cell(d, v.name)[1] for v in self.wanted if v.type == S.STRL]
        with opened(self.o.path) as f:
            for at in range(part.start, part.stop, batch):
                n = min(batch, part.stop - at)
                f.seek(d.data_at + at * d.width)
                raw = f.read(n * d.width)
                if len(raw) < n * d.width:
                    raise S.StataError("the file ends inside its records")
                rows = np.frombuffer(raw, np.uint8).reshape(n, d.width)
                if places:
                    keys = {bytes(k) for p in places for k in np.unique(S.keys_of(rows, p).view("S8"))}
                    keys = {k.ljust(8, b"\0") for k in keys} - {b"\0" * 8}
                    self.strls = S.read_strls(f, d, keys)
                    if missing := keys - self.strls.keys():
                        raise S.StataError(f"{len(missing)} references to long strings that are not there")
                yield rows

    def arrays(self, v: S.Variable, rows: np.ndarray) -> Iterator[tuple[str, pa.Array]]:
        d, o = self.d, self.o
        if v.type == S.STRL:
            keys = S.keys_of(rows, S.cell(d, v.name)[1])
            raw = pa.array([self.strls.get(bytes(k)) or b"" for k in keys], pa.binary())
            words = as_text(raw, "utf-8" if d.release >= 118 else "cp1252")
            yield v.name, blank(words) if o.empty else words
            return
        x, ok, tag = S.decode(d, rows, v.name)
        if tag is None:
            yield v.name, blank_as_null(x) if o.empty else x
            return
        words = d.label_sets.get(v.label_set, {})
        if o.labels and words:
            yield v.name, labelled(x, ok, words)
        else:
            yield v.name, temporal_array(x, ok, temporal(v), o.compat)
        if o.has_tag(v.name, True):
            base = S.LIMIT[S.LONG][1]
            say = {"." + chr(96 + k): words.get(base + k, "." + chr(96 + k)) for k in range(1, 27)}
            keys, back = np.unique(np.where(ok, "", tag.astype("U2")), return_inverse=True)
            yield v.name + o.suffix, pa.array([say.get(str(k)) for k in keys], pa.string()).take(pa.array(back.ravel()))


def blank(words: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(pc.equal(pc.utf8_trim(words, " \0"), ""), pa.scalar(None, pa.string()), words)


def temporal_array(x: np.ndarray, ok: np.ndarray, kind: str | None, compat: bool = False) -> pa.Array:
    """The first day of each period, datetimes, or microseconds of the day; null beyond the calendar.

    compat: every period counts days, as some readers have it.
    """
    if kind is None:
        return pa.array(x, mask=~ok)
    ok = ok & (np.abs(x.astype(float)) < 9e15)
    n = np.where(ok, x, 0).astype(np.int64)
    if kind == "time":
        return pa.array(n % DAY_MS * 1000, pa.int64(), mask=~ok)
    if kind == "datetime":
        return pa.array((n - S.EPOCH_DAYS * DAY_MS) * 1000, pa.timestamp("us"), mask=~ok)
    if kind == "d" or compat:
        days = n - S.EPOCH_DAYS
    else:
        n = np.clip(n, -200_000, 1_000_000)
        months = {"w": n // 52 * 12, "m": n, "q": 3 * n, "h": 6 * n, "y": 12 * (n - 1960)}[kind] - 120
        days = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + (n % 52 * 7 if kind == "w" else 0)
    ok = ok & (days >= -719162) & (days <= 2932896)
    return pa.array(np.where(ok, days, 0).astype(np.int32), pa.int32(), mask=~ok).cast(pa.date32())


def scan_dta(spark: SparkSession, path: str, **options) -> DataFrame:
    return load(spark, DtaSource, path, options)


# ---- sinks ----------------------------------------------------------------------------------


def storage(f: T.StructField, names: list[str], i: int, lo, hi, long: bool, label_set: str, label: str) -> tuple[S.Variable, F.Column]:
    """How a column is stored, by its type and by the least and largest value or the bytes of its texts."""
    c, t, fmt = F.col(f"`{f.name}`"), f.dataType, "%9.0g"
    if isinstance(t, T.BooleanType):
        kind, c = S.BYTE, c.cast("int")
    elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        kind = next((k for k in (S.BYTE, S.INT, S.LONG) if S.LEAST[k] <= (lo or 0) and (hi or 0) <= S.LIMIT[k][0]), S.DOUBLE)
        c = c.cast("double") if kind == S.DOUBLE else c.cast("int")
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        kind = S.FLOAT if isinstance(t, T.FloatType) else S.DOUBLE
    elif isinstance(t, T.DateType):
        kind, fmt, c = S.LONG, "%td", F.datediff(c, F.lit("1960-01-01").cast("date"))
    elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        kind, fmt, c = S.DOUBLE, "%tc", F.timestamp_diff("MILLISECOND", F.lit("1960-01-01 00:00:00").cast(t), c).cast("double")
    elif isinstance(t, T.DayTimeIntervalType):
        kind, fmt, c = S.DOUBLE, "%tcHH:MM:SS", (F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + c) / 1000).cast("double")
    elif isinstance(t, T.StringType):
        size = max(1, hi or 1)
        kind = S.STRL if long or size > 2045 else size
        fmt = "%9s" if kind == S.STRL else f"%{size}s"
    else:
        raise S.StataError(f"{f.name}: unsupported type {t.simpleString()}")
    return S.Variable(names[i], kind, fmt, label, label_set), c.alias(names[i])


def write_dta(df: DataFrame, path: str, value_labels: dict[str, dict[int, str]] | None = None, variable_labels: dict[str, str] | None = None, order_by: list[str] | None = None, data_label: str = "", tags: dict[str, str] | None = None, formats: dict[str, str] | None = None) -> list[S.Variable]:
    """Writes one .dta file; storage types come from one aggregation over the frame.

    tags: for a numeric column the text column that says which of .a to .z its nulls are; it is not
    written itself. formats: display formats other than those that follow from the type.

    Texts over 2,045 bytes, with a NUL, or with a blank at the end make their column one of long
    strings. Labels in the schema's metadata win over those given. Numbers that do not fit are an error.
    """
    value_labels, variable_labels = sink.labels_of(df, value_labels, variable_labels)
    if order_by:
        df = df.orderBy(*order_by)
    tags, whole = tags or {}, df
    df = df.drop(*tags.values())
    names = S.stata_names(df.columns)
    aggs = [F.lit(0).alias("none")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        elif isinstance(f.dataType, T.StringType):
            aggs += [F.max(F.octet_length(c)).alias(f"hi{i}"), F.max(c.contains("\0") | c.endswith(" ")).alias(f"long{i}")]
    got = df.agg(*aggs).first().asDict()
    made = [
        storage(f, names, i, got.get(f"lo{i}"), got.get(f"hi{i}"), bool(got.get(f"long{i}")), names[i] if f.name in value_labels else "", variable_labels.get(f.name, ""))
        for i, f in enumerate(df.schema.fields)
    ]
    variables = [v for v, _ in made]
    for f, v in zip(df.columns, variables, strict=True):
        v.format = (formats or {}).get(f, v.format)
    tagged = [df.columns.index(c) for c in tags]
    extra = [F.col(f"`{c}`").alias(f"tag {k}") for k, c in enumerate(tags.values())]
    n = len(variables)
    sets = {n: {int(k): w for k, w in value_labels[f].items()} for n, f in zip(names, df.columns, strict=True) if f in value_labels}
    folder = sink.parts_folder(path)
    try:
        rows = whole.select(*(c for _, c in made), *extra)
        parts = sink.write_parts(rows, folder, 2, lambda b, first: S.encode(variables, b.columns[:n], first, dict(zip(tagged, b.columns[n:], strict=True))))
        rows, long = sum(p.rows for p in parts), sum(p.sizes[1] for p in parts)
        between = list(S.frame(variables, rows, sets, data_label, long))
        moves = [lambda raw, base: S.moved(raw, variables, base), S.moved_entries] if long else [None, None]
        sink.assemble(df.sparkSession, path, folder, parts, between, [sum(v.width for v in variables), 0], moves)
    finally:
        sink.drop_folder(folder)
    return variables


def write_batches(path: str, variables: list[S.Variable], batches: Iterable[pa.RecordBatch], rows: int | None = None, label_sets: dict[str, dict[int, str]] | None = None) -> int:
    """Writes Arrow batches that one process has, in turn, and returns the number of rows.

    With `rows` the head is written once and another number of rows is an error; without, the head is
    written again at the end. Storage types are given, so long strings are not taken.
    """
    from tabulith.sources.base import filesystem

    if any(v.type == S.STRL for v in variables):
        raise S.StataError("long strings are not written in batches")
    system, inner = filesystem(path)
    made = 0
    with (open(inner, "w+b") if rows is None else system.open_output_stream(inner)) as out:
        out.write(S.frame(variables, rows or 0, label_sets)[0])
        for b in batches:
            out.write(S.encode(variables, b.columns)[0])
            made += b.num_rows
            if rows is not None and made > rows:
                raise S.StataError(f"more than the {rows} rows that were declared")
        if rows is not None and made != rows:
            raise S.StataError(f"{made} rows written, {rows} declared")
        head, middle, tail = S.frame(variables, made, label_sets)
        out.write(middle + tail)
        if rows is None:
            out.seek(0)
            out.write(head)
    return made


def batch_schema(schema: T.StructType, widths: dict[str, int] | None = None, variable_labels: dict[str, str] | None = None) -> list[S.Variable]:
    """Storage types of a schema alone: integers by their type (the largest values of a type do not fit it), texts by `widths`."""
    names, out = S.stata_names(schema.names), []
    kinds = {T.ByteType: S.INT, T.BooleanType: S.BYTE, T.ShortType: S.LONG, T.IntegerType: S.DOUBLE, T.LongType: S.DOUBLE, T.FloatType: S.FLOAT, T.DoubleType: S.DOUBLE}
    for f, name in zip(schema.fields, names, strict=True):
        label = (variable_labels or {}).get(f.name, "")
        if isinstance(f.dataType, T.StringType):
            width = (widths or {}).get(f.name)
            if not width or width > 2045:
                raise S.StataError(f"{f.name}: give a width of at most 2,045 bytes; long strings are not written in batches")
            out.append(S.Variable(name, width, f"%{width}s", label))
        elif type(f.dataType) in kinds:
            out.append(S.Variable(name, kinds[type(f.dataType)], "%9.0g", label))
        else:
            raise S.StataError(f"{f.name}: unsupported type {f.dataType.simpleString()}")
    return out
