"""What the file sources share: options, splits by bytes, filters on decoded columns, shared folders."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import datasource as ds

#: Bytes of records that one task reads unless `partitions` is given, and the least worth a task.
SPLIT_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Bytes of records decoded at once at most.
BATCH_BYTES = 64 << 20


def opened(path: str):
    from pyarrow import fs

    system, inner = filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        return pa.OSFile(inner)
    return system.open_input_file(inner)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, in tests below a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="tabulith-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, inner = filesystem(path)
    system.create_dir(inner)
    return path


class Rows(ds.InputPartition):
    def __init__(self, start: int, stop: int | None):
        self.start, self.stop = start, stop


class Options:
    """path, columns (comma-separated), offset, limit, partitions, parallelism, batch_rows, empty_as_null,
    labels, indicators (suffix), indicator_columns (comma-separated; all that can have one if absent), compat,
    filters (JSON: a list of [column, operator, value], all of which must hold)."""

    def __init__(self, given):
        flag = lambda k, default: str(given.get(k, default)).lower() == "true"
        names = lambda k: [c for c in given.get(k, "").split(",") if c] if k in given else None
        self.path = given["path"]
        self.columns = names("columns") or None
        self.offset = max(0, int(given.get("offset", 0)))
        self.limit = max(0, int(given["limit"])) if "limit" in given else None
        self.partitions = max(1, int(given["partitions"])) if "partitions" in given else None
        self.parallelism = max(1, int(given.get("parallelism", 8)))
        self.batch = max(1, int(given.get("batch_rows", 100_000)))
        self.empty, self.labels, self.compat = flag("empty_as_null", "true"), flag("labels", "false"), flag("compat", "false")
        self.filters = [tuple(f) for f in json.loads(given.get("filters", "[]"))]
        self.suffix, self.tagged = given.get("indicators"), names("indicator_columns")

    def pick(self, variables: list, error: type[Exception]) -> list:
        """The wanted variables in the order asked for."""
        by = {v.name: v for v in variables}
        for c in self.columns or ():
            if c not in by:
                raise error(f"unknown column {c}")
        return [by[c] for c in self.columns] if self.columns else list(variables)

    def has_tag(self, name: str, eligible: bool) -> bool:
        return bool(self.suffix) and eligible and (self.tagged is None or name in self.tagged)

    def check_tags(self, names: Iterable[str], tagged: Iterable[str], error: type[Exception]) -> None:
        clash = {t + self.suffix for t in tagged} & set(names) if self.suffix else set()
        if clash:
            raise error(f"indicator {min(clash)} is a column of the file")

    def window(self, rows: int) -> tuple[int, int]:
        start = min(self.offset, rows)
        return start, rows if self.limit is None else min(rows, start + self.limit)

    def pieces(self, size: int) -> int:
        """Tasks for so many bytes: whole splits, and in small files as many as there are cores."""
        return self.partitions or max(1, -(-size // SPLIT_BYTES), min(self.parallelism, size // LEAST_BYTES))

    def split(self, start: int, stop: int, width: int) -> list[ds.InputPartition]:
        n = stop - start
        parts = max(1, min(self.pieces(n * width), n))
        return [Rows(start + n * k // parts, start + n * (k + 1) // parts) for k in range(parts)]

    def rows_at_once(self, width: int) -> int:
        return max(1, min(self.batch, BATCH_BYTES // max(1, width)))


# ---- filters --------------------------------------------------------------------------------
#
# Spark's own hook for Python sources (pushFilters) is not used: in 4.1 what one query pushes stays in
# the source, so a second query over the same frame would be answered with the first one's filters.

COMPARE = {"=": pc.equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}
TESTS = {"is null": pc.is_null, "is not null": pc.is_valid}
OPERATORS = frozenset([*COMPARE, *TESTS, "in", "starts with"])


def holds(x: pa.Array, op: str, value) -> pa.Array:
    """Whether each value passes; unknown counts as no. Dates and datetimes are compared with ISO text."""
    if op in TESTS:
        return TESTS[op](x)
    if op == "starts with":
        return pc.fill_null(pc.starts_with(x, value), False)
    if pa.types.is_integer(x.type):
        x = x.cast(pa.int64())
    like = lambda v: pa.scalar(v) if isinstance(v, (int, float)) else pa.scalar(v).cast(x.type)
    if op == "in":
        found = [pc.fill_null(pc.equal(x, like(v)), False) for v in value if v is not None]
        return pc.or_(*found) if len(found) == 2 else _any(found, len(x))
    return pc.fill_null(COMPARE[op](x, like(value)), False)


def _any(masks: list, n: int) -> pa.Array:
    out = pa.array(np.zeros(n, bool))
    for m in masks:
        out = pc.or_(out, m)
    return out


class RecordReader(ds.DataSourceReader):
    """Reads blocks of records, decodes the filtered columns first and the others for what passes.

    A format gives blocks(partition), which yields byte rows, and arrays(variable, rows), which
    yields (name, array) of the variable and of its indicator if it has one.
    """

    def __init__(self, options: Options, wanted: list):
        self.o, self.wanted = options, wanted
        self.by_name = {v.name: v for v in wanted}
        for column, op, _ in options.filters:
            if column not in self.by_name or op not in OPERATORS:
                raise ValueError(f"cannot filter {column} by {op}")

    def blocks(self, part) -> Iterator[np.ndarray]:
        raise NotImplementedError

    def arrays(self, variable, rows) -> Iterator[tuple[str, pa.Array]]:
        raise NotImplementedError

    def read(self, part) -> Iterator[pa.RecordBatch]:
        for rows in self.blocks(part):
            if not len(rows):
                continue
            known, keep = {}, None
            for column, op, value in self.o.filters:
                if column not in known:
                    known[column] = list(self.arrays(self.by_name[column], rows))
                ok = holds(known[column][0][1], op, value)
                keep = ok if keep is None else pc.and_(keep, ok)
            if keep is not None:
                at = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                if len(at) < len(rows):
                    rows = rows[at]
                    known = {c: [(n, a.take(pa.array(at))) for n, a in got] for c, got in known.items()}
            got = [x for v in self.wanted for x in (known.get(v.name) or self.arrays(v, rows))]
            if got:
                yield pa.RecordBatch.from_arrays([a for _, a in got], names=[n for n, _ in got])
            else:  # no column wanted: the number of rows is all there is
                yield pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))


def load(spark: SparkSession, source: type[ds.DataSource], path: str, options: dict) -> DataFrame:
    """The frame of a source; lists become comma-separated options, filters JSON."""
    spark.dataSource.register(source)
    options = dict(options)
    if options.get("filters"):
        options["filters"] = json.dumps([list(f) for f in options["filters"]], default=lambda v: v.isoformat())
    mode = options.pop("indicator_mode", None) or "separate"
    reader = spark.read.format(source.name()).option("parallelism", spark.sparkContext.defaultParallelism)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v)
    return merged(reader.option("path", path).load(), options.get("indicators"), mode)


def merged(df: DataFrame, suffix: str | None, mode: str) -> DataFrame:
    """The columns and their indicators as they are, as structs, or as one text column."""
    if mode not in ("separate", "struct", "merged"):
        raise ValueError(f"unknown mode {mode}")
    if not suffix or mode == "separate":
        return df
    tags = {f.name for f in df.schema.fields if f.metadata.get("indicator_of")}
    own = {f.metadata["indicator_of"]: f.name for f in df.schema.fields if f.name in tags}
    out = []
    for c in df.columns:
        if c in own and mode == "struct":
            out.append(F.struct(F.col(f"`{c}`"), F.col(f"`{own[c]}`").alias("null_indicator")).alias(c))
        elif c in own:
            out.append(F.coalesce(F.col(f"`{c}`").cast("string"), F.col(f"`{own[c]}`")).alias(c))
        elif c not in tags:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def tag_field(name: str, suffix: str) -> T.StructField:
    return T.StructField(name + suffix, T.StringType(), True, {"indicator_of": name})
