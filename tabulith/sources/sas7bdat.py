"""SAS data files as a Spark data source, and a sink that writes them.

The driver reads the dictionary and, for plain files, the head of each page, so partitions are
ranges of records. A compressed file's pages are read by tasks alone, in ranges of pages, unless
an offset or a limit makes the driver count its records first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulith.formats import sas as S
from tabulith.formats import sas_write as W
from tabulith.formats.text import blank_as_null, fixed
from tabulith.functions.temporal import DAY, SAS_DAYS, SAS_LEAST, SAS_MICROS, SAS_MOST, sas_kind
from tabulith.sources import sink
from tabulith.sources.base import Options, RecordReader, load, opened, tag_field

TYPES = {"date": T.DateType(), "datetime": T.TimestampNTZType(), "time": T.LongType(), None: T.DoubleType()}


def kind(c: S.Column) -> str | None:
    return sas_kind(c.format) if c.numeric else None


class SasSource(DataSource):
    __doc__ = Options.__doc__

    @classmethod
    def name(cls) -> str:
        return "sas7bdat"

    def _plan(self) -> tuple[Options, S.Dictionary, list[S.Column]]:
        o = Options(self.options)
        with opened(o.path) as f:
            d = S.read_dictionary(f)
        return o, d, o.pick(d.columns, S.SasError)

    def schema(self) -> T.StructType:
        o, d, wanted = self._plan()
        o.check_tags((c.name for c in d.columns), (c.name for c in wanted if o.has_tag(c.name, c.numeric)), S.SasError)
        fields = []
        for c in wanted:
            fields.append(T.StructField(c.name, TYPES[kind(c)] if c.numeric else T.StringType(), True, {"label": c.label, "format": c.format}))
            if o.has_tag(c.name, c.numeric):
                fields.append(tag_field(c.name, o.suffix))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SasReader(*self._plan())


class Pages(InputPartition):
    def __init__(self, first: int, last: int, skip: int = 0, take: int | None = None):
        self.first, self.last, self.skip, self.take = first, last, skip, take


class Records(InputPartition):
    """Records of a plain file with the pages that hold them: what the driver learns when it plans
    reaches tasks through partitions alone."""

    def __init__(self, start: int, stop: int, runs: list[S.Run]):
        self.start, self.stop = start, stop
        self.runs = [r for r in runs if r.row < stop and r.row + r.each * r.pages > start]


class SasReader(RecordReader):
    def __init__(self, o: Options, d: S.Dictionary, wanted: list[S.Column]):
        super().__init__(o, wanted)
        self.d = d

    def partitions(self) -> list[InputPartition]:
        d, o = self.d, self.o
        counted = o.offset or o.limit is not None
        if not d.compression or counted:
            with opened(o.path) as f:
                S.index(f, d)
        if not d.compression:
            have = sum(r.each * r.pages for r in d.runs)
            return [Records(p.start, p.stop, d.runs) for p in o.split(*o.window(min(d.rows, have)), d.row_length)]
        if not counted:
            parts = max(1, min(o.pieces(d.pages * d.page), d.pages))
            return [Pages(d.pages * k // parts, d.pages * (k + 1) // parts) for k in range(parts)]
        start, stop = o.window(min(d.rows, sum(r.each * r.pages for r in d.runs)))
        rows = o.split(start, stop, d.row_length)
        return [self.pages_of(p.start, p.stop) for p in rows]

    def pages_of(self, start: int, stop: int) -> Pages:
        """The pages that hold records start..stop."""
        first = last = skip = None
        for r in self.d.runs:
            if first is None and start < r.row + r.each * r.pages:
                first = r.page + (start - r.row) // r.each
                skip = (start - r.row) % r.each
            if stop > r.row:
                last = r.page + min(r.pages, -(-(stop - r.row) // r.each))
        return Pages(first or 0, last or 0, skip or 0, stop - start) if start < stop else Pages(0, 0)

    def blocks(self, part) -> Iterator[np.ndarray]:
        d, batch = self.d, self.o.rows_at_once(self.d.row_length)
        with opened(self.o.path) as f:
            if isinstance(part, Pages):
                yield from S.packed_records(f, d, part.first, part.last, part.skip, part.take, batch)
            else:
                for rows in S.plain_records(f, d, part.runs, part.start, part.stop, batch):
                    for k in range(0, len(rows), batch):
                        yield rows[k : k + batch]

    def arrays(self, c: S.Column, rows: np.ndarray) -> Iterator[tuple[str, pa.Array]]:
        if not c.numeric:
            words = fixed(rows[:, c.offset : c.offset + c.length], self.d.encoding, "trim_cut")
            yield c.name, blank_as_null(words) if self.o.empty else words
            return
        x, ok, bits = S.numbers(rows, c, self.d.order)
        yield c.name, temporal_array(x, ok, kind(c))
        if self.o.has_tag(c.name, True):
            yield c.name + self.o.suffix, pa.array(S.tags(bits, ok), pa.string())


def temporal_array(x: np.ndarray, ok: np.ndarray, what: str | None) -> pa.Array:
    """Numbers, or days, microseconds and times of day by the rules of functions.temporal."""
    if what is None:
        return pa.array(x, mask=~ok)
    x = np.where(ok, x, 0.0)
    if what == "date":
        days = np.trunc(np.clip(x, -2.0**31, 2.0**31 - 1)) - SAS_DAYS
        days = np.where((days >= SAS_LEAST) & (days <= SAS_MOST), days, np.trunc(x / DAY) - SAS_DAYS)
        ok = ok & (days >= -719162) & (days <= 2932896)  # beyond the calendar there is no date
        return pa.array(np.where(ok, days, 0).astype(np.int32), pa.int32(), mask=~ok).cast(pa.date32())
    micros = np.trunc((x - SAS_DAYS * DAY if what == "datetime" else x) * 1e6)
    ok = ok & (np.abs(micros) < SAS_MICROS)
    return pa.array(np.where(ok, micros, 0).astype(np.int64), pa.timestamp("us") if what == "datetime" else pa.int64(), mask=~ok)


def scan_sas(spark: SparkSession, path: str, **options) -> DataFrame:
    return load(spark, SasSource, path, options)


# ---- sink -----------------------------------------------------------------------------------


def write_sas7bdat(df: DataFrame, path: str, layout: W.Layout | None = None, order_by: list[str] | None = None, variable_labels: dict[str, str] | None = None, tags: dict[str, str] | None = None) -> list[S.Column]:
    """Writes one .sas7bdat file in the layout given; widths of texts come from one aggregation.

    Numbers become doubles, dates days and datetimes seconds since 1960. Null is ".", or what the
    column's text column in `tags` says (.A to .Z or ._), which is not written itself.
    """
    y = layout or W.Layout()
    if order_by:
        df = df.orderBy(*order_by)
    _, variable_labels = sink.labels_of(df, None, variable_labels)
    tags, whole = tags or {}, df
    df = df.drop(*tags.values())
    extra = [F.col(f"`{c}`").alias(f"tag {k}") for k, c in enumerate(tags.values())]
    words = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    widths = dict(zip(words, df.agg(*(F.max(F.octet_length(f"`{c}`")) for c in words)).first(), strict=True)) if words else {}
    columns, made = [], []
    for f in df.schema.fields:
        c, t, shown = F.col(f"`{f.name}`"), f.dataType, ""
        if isinstance(t, T.DateType):
            c, shown = F.datediff(c, F.lit("1960-01-01").cast("date")), "DATE9."
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c, shown = F.timestamp_diff("MICROSECOND", F.lit("1960-01-01 00:00:00").cast(t), c) / 1_000_000, "DATETIME22.3"
        elif not isinstance(t, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            raise S.SasError(f"{f.name}: unsupported type {t.simpleString()}")
        text = isinstance(t, T.StringType)
        if text and (widths[f.name] or 0) > 32_767:
            raise S.SasError(f"{f.name}: texts have 32,767 bytes at most")
        columns.append(S.Column(f.name, 0, max(1, widths[f.name] or 1) if text else 8, not text, shown, variable_labels.get(f.name, "")))
        made.append(c.alias(f.name) if text else c.cast("double").alias(f.name))
    size = W.place(columns)

    def encode(b: pa.RecordBatch, first: int) -> tuple[bytes]:
        rows, n = np.zeros((b.num_rows, size), np.uint8), len(columns)
        said = dict(zip(tags, b.columns[n:], strict=True))
        for c, a in zip(columns, b.columns[:n], strict=True):
            at = slice(c.offset, c.offset + c.length)
            if c.numeric:
                x = a.fill_null(0).to_numpy(zero_copy_only=False)
                gone = W.missing_of(said[c.name].to_pylist()) if c.name in said else W.missing()
                x = np.where(a.is_valid().to_numpy(zero_copy_only=False), x, gone)
                rows[:, at] = W.number_bytes(x, c.length, y.order)
            else:
                raw = [(w or "").encode() for w in a.to_pylist()]
                if max(map(len, raw), default=0) > c.length:
                    raise S.SasError(f"{c.name}: a text is longer than it was when widths were taken")
                rows[:, at] = np.array([w.ljust(c.length) for w in raw], f"S{c.length}").view(np.uint8).reshape(-1, c.length)
        return (b"".join(W.record_pages(rows, y)),)

    folder = sink.parts_folder(path)
    try:
        parts = sink.write_parts(whole.select(*made, *extra), folder, 1, encode)
        rows, pages = sum(p.rows for p in parts), sum(p.sizes[0] for p in parts) // y.page
        head, after = W.file_head(columns, rows, size, pages, y)
        sink.assemble(df.sparkSession, path, folder, parts, [head, after], [y.page], [None])
    finally:
        sink.drop_folder(folder)
    return columns
