"""Files made of parts that tasks write: no record passes the driver where the file system can be written in place.

Each task writes its sections to files of its own in a folder beside the target and reports how
many rows and bytes they have; an attempt that is lost or repeated leaves files that nobody names.
Since head and sections follow from these reports, a file holds exactly the rows that were written.
On a file system with random writes, tasks then copy their sections to their places; elsewhere the
driver streams them one after the other.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulith.sources.base import filesystem

PIECE = 8 << 20


@dataclass
class Part:
    name: str
    rows: int
    sizes: list[int]  # of each section


#: Encodes a batch, given how many rows of the part came before, into one piece a section.
Encode = Callable[[pa.RecordBatch, int], tuple[bytes, ...]]
#: Corrects a section's bytes for the rows before its part; called with whole records or entries.
Move = Callable[[bytes, int], bytes]


def write_parts(df: DataFrame, folder: str, sections: int, encode: Encode) -> list[Part]:
    """The parts of df in the order of its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        system, inner = filesystem(folder)
        outs = [system.open_output_stream(f"{inner}/{name}.{k}") for k in range(sections)]
        rows, sizes = 0, [0] * sections
        for b in batches:
            for k, piece in enumerate(encode(b, rows)):
                outs[k].write(piece)
                sizes[k] += len(piece)
            rows += b.num_rows
        for out in outs:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([name]), pa.array([rows]), pa.array([sizes], pa.list_(pa.int64()))], names=["part", "name", "rows", "sizes"])

    got = df.mapInArrow(run, "part long, name string, rows long, sizes array<long>").collect()  # one row a task
    return [Part(r["name"], r["rows"], list(r["sizes"])) for r in sorted(got)]


def pieces(stream, size: int, unit: int) -> Iterator[bytes]:
    step = max(unit, PIECE // max(1, unit) * unit)
    for at in range(0, size, step):
        yield stream.read(min(step, size - at))


def assemble(spark: SparkSession, path: str, folder: str, parts: list[Part], between: list[bytes], units: list[int], moves: list[Move | None]) -> None:
    """between[0], section 0 of all parts, between[1], section 1 ..., between[-1].

    units: bytes of a record of a section; a section of entries of any length has 0 and is moved whole.
    """
    from pyarrow import fs

    system, inner = filesystem(path)
    sections = len(between) - 1
    base = [0]
    for p in parts:
        base.append(base[-1] + p.rows)
    if not isinstance(system, fs.LocalFileSystem):
        with system.open_output_stream(inner) as out:
            for k in range(sections):
                out.write(between[k])
                for p, first in zip(parts, base, strict=False):
                    _copy(folder, p.name, k, p.sizes[k], units[k], moves[k], first, out.write)
            out.write(between[-1])
        return
    making, at, work = f"{inner}.{uuid.uuid4().hex[:8]}.tmp", 0, []
    with open(making, "wb") as out:
        for k in range(sections):
            out.seek(at)
            out.write(between[k])
            at += len(between[k])
            for p, first in zip(parts, base, strict=False):
                if p.sizes[k]:
                    work.append((p.name, k, p.sizes[k], first, at))
                at += p.sizes[k]
        out.seek(at)
        out.write(between[-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            for r in b.to_pylist():
                with open(making, "r+b") as out:
                    out.seek(r["at"])
                    _copy(folder, r["name"], r["k"], r["size"], units[r["k"]], moves[r["k"]], r["first"], out.write)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    if work:
        rows = spark.createDataFrame(work, "name string, k int, size long, first long, at long")
        rows.repartition(min(len(work), 10_000)).mapInArrow(place, "done long").collect()
    os.replace(making, inner)


def _copy(folder: str, name: str, k: int, size: int, unit: int, move: Move | None, first: int, write) -> None:
    system, inner = filesystem(folder)
    with system.open_input_stream(f"{inner}/{name}.{k}") as stream:
        for piece in pieces(stream, size, unit or size or 1):
            write(move(piece, first) if move and first else piece)


def parts_folder(path: str) -> str:
    folder = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    system, inner = filesystem(folder)
    system.create_dir(inner)
    return folder


def drop_folder(folder: str) -> None:
    system, inner = filesystem(folder)
    system.delete_dir(inner)


def labels_of(df: DataFrame, value_labels: dict | None, variable_labels: dict | None) -> tuple[dict, dict]:
    """The labels to write: those in the frame's schema win over those given beside it."""
    import json

    words, names = dict(value_labels or {}), dict(variable_labels or {})
    for f in df.schema.fields:
        if f.metadata.get("label"):
            names[f.name] = f.metadata["label"]
        own = f.metadata.get("value_labels")
        own = json.loads(own) if isinstance(own, str) else own
        if own:
            words[f.name] = {number(k): w for k, w in own.items()}
    return words, names


def number(key):
    """JSON has text keys only."""
    try:
        x = float(key)
    except ValueError:
        return key
    return int(x) if x == int(x) else x
