"""The scan, its eager builder, batches, schema and metadata."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulith.formats import sas, spss, stata
from tabulith.sources import dta, sas7bdat, sav
from tabulith.sources.base import opened

# File extensions by format.
EXTENSIONS = {"sas7bdat": "sas", "sas7bcat": "sas", "dta": "stata", "sav": "spss", "zsav": "spss"}
SCANS = {"sas": sas7bdat.scan_sas, "stata": dta.scan_dta, "spss": sav.scan_sav}


def detect(path: str) -> str | None:
    return EXTENSIONS.get(os.path.splitext(path)[1][1:].lower())


def format_of(path: str, format: str | None = None) -> str:
    kind = format or detect(path)
    if kind not in SCANS:
        raise ValueError("unknown file extension" if kind is None else f"unknown format {kind}")
    return kind


def scan(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Options: columns, offset, limit, partitions, batch_rows, empty_as_null, labels, indicators (suffix),
    indicator_columns, indicator_mode (separate, struct or merged), compat, and filters: a list of (column,
    operator, value) that the reader tests, with operators = < <= > >= in, starts with, is null, is not null."""
    return SCANS[format_of(path, format)](spark, path, **options)


def pruned(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], format: str | None = None, **options) -> DataFrame:
    """plan(scan) with only those columns read that the optimised plan refers to, and with the simple
    conditions of its filters tested while reading.

    Spark does not tell Python sources which columns it needs, so the plan is made once over the
    whole scan, its references and filters are taken, and it is made again over a scan with these.
    """
    whole = scan(spark, path, format, **options)
    optimised = plan(whole)._jdf.queryExecution().optimizedPlan()
    used: set[str] = {a.name() for a in each(optimised.output())}
    scans, tests = 0, []

    def visit(node, above: list) -> None:
        nonlocal scans, tests
        used.update(a.name() for a in each(node.references()))
        kind, children = node.nodeName(), list(each(node.children()))
        if not children:
            scans, tests = scans + 1, above
        for child in children:
            visit(child, [*above, *conjuncts(node.condition())] if kind == "Filter" else above if kind == "Project" else [])

    visit(optimised, [])
    fields = [f for f in whole.schema.fields if not f.metadata.get("indicator_of")]
    used |= {f.metadata["indicator_of"] for f in whole.schema.fields if f.metadata.get("indicator_of") and f.name in used}
    columns = [f.name for f in fields if f.name in used] or [fields[0].name]
    filters = [t for t in tests if t[0] in columns] if scans == 1 else []  # one frame read in two ways has no common filter
    return plan(scan(spark, path, format, **{**options, "columns": columns, "filters": [*options.get("filters", []), *filters]}))


def each(items) -> Iterator:
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def conjuncts(e) -> list[tuple]:
    """The parts of a condition that the reader can test; Spark tests the whole condition all the same."""
    kind = e.nodeName()
    if kind == "And":
        return conjuncts(e.left()) + conjuncts(e.right())
    signs = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    if kind in ("IsNull", "IsNotNull") and e.child().nodeName() == "AttributeReference":
        return [(e.child().name(), "is null" if kind == "IsNull" else "is not null", None)]
    if kind in signs:
        sides, sign = [e.left(), e.right()], signs[kind]
        if sides[0].nodeName() == "Literal":
            sides, sign = sides[::-1], turned.get(sign, sign)
        if sides[0].nodeName() == "AttributeReference" and sides[1].nodeName() == "Literal":
            value = literal(sides[1])
            return [] if value is None else [(sides[0].name(), sign, value)]
    return []


def literal(e):
    """The value of a literal as the reader takes it, None if it does not."""
    kind, text = e.dataType().simpleString(), e.toString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(text)
    if kind in ("float", "double"):
        x = float(text)
        return x if math.isfinite(x) else None
    return text if kind in ("string", "date", "timestamp_ntz") else None


class ReadBuilder:
    """read(path).columns(...).offset(n).limit(n).cast({...}).finish()"""

    def __init__(self, spark: SparkSession, path: str, format: str | None = None):
        self.spark, self.path, self.format, self.options, self.casts = spark, path, format, {}, {}

    def _set(self, **given) -> ReadBuilder:
        self.options |= given
        return self

    def columns(self, names: list[str]) -> ReadBuilder:
        return self._set(columns=names)

    def offset(self, n: int) -> ReadBuilder:
        return self._set(offset=n)

    def limit(self, n: int) -> ReadBuilder:
        return self._set(limit=n)

    def filters(self, tests: list[tuple]) -> ReadBuilder:
        return self._set(filters=tests)

    def threads(self, n: int) -> ReadBuilder:
        return self._set(partitions=n)

    def sequential(self) -> ReadBuilder:
        return self._set(partitions=1)

    def batch_rows(self, n: int) -> ReadBuilder:
        return self._set(batch_rows=n)

    def empty_as_null(self, on: bool) -> ReadBuilder:
        return self._set(empty_as_null=on)

    def labels(self, on: bool = True) -> ReadBuilder:
        return self._set(labels=on)

    def informative_nulls(self, mode: str = "separate", columns: list[str] | None = None, suffix: str = "_null") -> ReadBuilder:
        return self._set(indicators=suffix, indicator_mode=mode, indicator_columns=columns)

    def cast(self, types: dict[str, str]) -> ReadBuilder:
        self.casts = types
        return self

    def finish(self) -> DataFrame:
        return cast_known(scan(self.spark, self.path, self.format, **self.options), self.casts)

    def finish_profiled(self) -> tuple[DataFrame, dict[str, float]]:
        """The frame, with the milliseconds to plan it and to read all of it once."""
        at = time.perf_counter()
        df = self.finish()
        planned = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        done = time.perf_counter()
        return df, {"plan_ms": 1000 * (planned - at), "read_ms": 1000 * (done - planned), "total_ms": 1000 * (done - at)}


def cast_known(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts the columns that exist; other names are ignored."""
    return df.withColumns({c: df[c].cast(t) for c, t in types.items() if c in df.columns}) if types else df


def schema(spark: SparkSession, path: str, format: str | None = None, **options) -> T.StructType:
    """From the file's dictionary alone."""
    return scan(spark, path, format, **options).schema


def recut(parts: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the parts in batches of `size`, with only the last one smaller."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    held, n = [], 0
    for b in parts:
        at = 0
        while at < b.num_rows:
            held.append(b.slice(at, size - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == size:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def batches(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of `size` rows, of which only the last has fewer, in the order of the partitions, one partition
    held at a time. Neither Spark's own batches nor the ends of partitions end a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(it, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    made = df.mapInArrow(run, "batch binary").toLocalIterator()
    yield from recut((b for row in made for b in pa.ipc.open_stream(bytes(row["batch"]))), size)


def batch_iter(spark: SparkSession, path: str, format: str | None = None, columns: list[str] | None = None, n_rows: int | None = None, batch_size: int = 8192, **options) -> Iterator[pa.RecordBatch]:
    """Batches of a file, in its order."""
    return batches(scan(spark, path, format, columns=columns or None, limit=n_rows, batch_rows=batch_size, **options), batch_size)


def to_arrow(df: DataFrame) -> pa.RecordBatchReader:
    """The frame as an Arrow stream, which hands its batches on through the C stream interface."""
    first = batches(df, 65_536)
    head = next(first, None)
    shape = head.schema if head is not None else df.limit(0).toArrow().schema
    return pa.RecordBatchReader.from_batches(shape, (b for part in ([head] if head is not None else [], first) for b in part))


def dump_parquet(spark: SparkSession, path: str, target: str, columns: int | None = None, rows: int | None = None) -> None:
    """The first columns and rows of a file as parquet."""
    names = schema(spark, path).names[:columns] if columns else None
    scan(spark, path, columns=names, limit=rows).write.mode("overwrite").parquet(target)


def raw_column(path: str, column: str, start: int = 0, count: int = 10, format: str | None = None) -> list[str]:
    """The bytes of a column in `count` records, as hexadecimal text."""
    reader = {"sas": sas7bdat.SasSource, "stata": dta.DtaSource, "spss": sav.SavSource}[format_of(path, format)](
        {"path": path, "columns": column, "offset": str(start), "limit": str(count), "partitions": "1"}
    ).reader(None)
    (v,) = reader.wanted
    if isinstance(v, sas.Column):
        spans = [(v.offset, v.length)]
    else:
        spans = v.pieces if isinstance(v, spss.Variable) else [(stata.cell(reader.d, column)[1], v.width)]
    return [b"".join(r[a : a + n].tobytes() for a, n in spans).hex() for p in reader.partitions() for rows in reader.blocks(p) for r in rows]


def metadata_json(path: str, format: str | None = None) -> str:
    kind = format_of(path, format)
    with opened(path) as f:
        if kind == "sas":
            return json.dumps(sas_metadata(sas.read_dictionary(f)))
        if kind == "spss":
            return json.dumps(spss_metadata(spss.read_dictionary(f)))
        return json.dumps(stata_metadata(stata.read_dictionary(f)))


def sas_metadata(d: sas.Dictionary) -> dict:
    return {
        "compression": {"": "None", "rle": "Rle", "rdc": "Rdc"}[d.compression], "row_count": d.rows, "row_length": d.row_length, "column_count": len(d.columns),
        "table_name": d.name or None, "file_type": d.file_type or None, "sas_release": d.release or None, "sas_server_type": d.server or None, "os_name": d.os or None,
        "creator_proc": d.creator or None, "encoding_byte": d.encoding_byte, "file_encoding": d.encoding.upper(), "page_size": d.page, "page_count": d.pages, "header_length": d.header,
        "columns": [{"name": c.name, "label": c.label or None, "format": c.format or None, "type": "Numeric" if c.numeric else "Character", "offset": c.offset, "length": c.length} for c in d.columns],
    }


def spss_metadata(d: spss.Dictionary) -> dict:
    shown = lambda v: v.print_format >> 16 & 255
    classes = {"date": "Date", "datetime": "DateTime", "time": "Time"}
    return {
        "row_count": d.rows if d.rows >= 0 else None, "file_label": d.label or None, "compression": ("None", "RLE", "ZLIB")[d.compression], "version": 3 if d.compression == 2 else 2,
        "data_offset": d.data_at, "encoding": d.encoding, "byte_order": "LSF" if d.order == "<" else "MSF",
        "variables": [
            {
                "name": v.name, "short_name": v.short.decode(d.encoding, "replace"), "type": "Str" if v.width else "Numeric", "string_len": v.width, "format_type": shown(v),
                "format_class": classes.get(v.kind), "label": v.label or None, "value_label": f"labels{i}" if v.labels else None,
                "value_labels": {(k if v.width else stata_key(k)): w for k, w in v.labels.items()} or None, "missing_range": v.span is not None,
                "missing_doubles": ([*(v.span or ()), *v.discrete] if not v.width else []), "missing_strings": v.discrete if v.width else [],
            }
            for i, v in enumerate(d.variables)
        ],
    }


def stata_key(k: float) -> str:
    return str(int(k)) if k == int(k) else str(k)


def stata_metadata(d: stata.Dictionary) -> dict:
    kinds = {stata.BYTE: "byte", stata.INT: "int", stata.LONG: "long", stata.FLOAT: "float", stata.DOUBLE: "double", stata.STRL: "strL"}

    def key(k: int) -> str:
        base = stata.LIMIT[stata.LONG][1]
        return "MISSING" if k == base else f"MISSING_{chr(96 + k - base)}" if base < k <= base + 26 else str(k)

    return {
        "version": d.release, "byte_order": "LSF" if d.order == "<" else "MSF", "row_count": d.rows, "data_label": d.label or None, "timestamp": d.timestamp or None,
        "data_offset": d.data_at, "strls_offset": d.strls_at, "value_labels_offset": d.labels_at, "encoding": "utf-8" if d.release >= 118 else "cp1252",
        "variables": [
            {
                "name": v.name, "type": kinds.get(v.type, f"str{v.type}"), "format": v.format, "label": v.label or None, "value_label_name": v.label_set or None,
                "value_labels": {key(k): w for k, w in d.label_sets[v.label_set].items()} if v.label_set in d.label_sets else None,
            }
            for v in d.variables
        ],
    }
