"""A folder of files of one format, as one batch table or as a stream of files that arrive.

Files are ordered by the time of their last change and their name; an offset is the last of those
read, so state does not grow with the number of files. A file must appear whole, by a rename, and
later than those before it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tabulith.sources import dta, sas7bdat, sav
from tabulith.sources.base import filesystem

SOURCES = {"dta": dta.DtaSource, "sav": sav.SavSource, "zsav": sav.SavSource, "sas7bdat": sas7bdat.SasSource}
WRITERS = {"dta": dta.write_dta, "sav": sav.write_sav, "sas7bdat": sas7bdat.write_sas7bdat}


class OfFile(InputPartition):
    def __init__(self, path: str, part: InputPartition):
        self.path, self.part = path, part


class Folder:
    """The files of a folder that have the format's extension."""

    def __init__(self, options):
        self.options = {k: v for k, v in options.items() if k not in ("path", "format")}
        self.path, self.format = options["path"].rstrip("/"), options["format"]

    def files(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        system, inner = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(inner))
        return sorted((f.mtime_ns, f.base_name) for f in found if f.is_file and f.extension.lower() == self.format)

    def reader(self, path: str) -> DataSourceReader:
        return self.source(path).reader(None)

    def source(self, path: str) -> DataSource:
        return SOURCES[self.format]({**self.options, "path": path})

    def parts(self, names: list[str]) -> list[OfFile]:
        return [OfFile(path, p) for path in (f"{self.path}/{n}" for n in names) for p in self.reader(path).partitions()]

    def rows(self, part: OfFile) -> Iterator[pa.RecordBatch]:
        return self.reader(part.path).read(part.part)


class FolderSource(DataSource):
    """Options: path, format (dta, sav, zsav or sas7bdat), max_files (of a micro-batch), and those of a scan."""

    @classmethod
    def name(cls) -> str:
        return "statfolder"

    def schema(self) -> T.StructType:
        f = Folder(self.options)
        names = f.files()
        if not names:
            raise ValueError(f"no .{f.format} file in {f.path}")
        return f.source(f"{f.path}/{names[0][1]}").schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return FolderStream(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.folder = Folder(options)

    def partitions(self) -> list[InputPartition]:
        return self.folder.parts([n for _, n in self.folder.files()])

    def read(self, part: OfFile) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(part)


class FolderStream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self, start: dict | None = None, limit=None) -> dict:  # noqa: N802
        last = self.folder.files()[-1:]
        return {"time": last[0][0], "name": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["time"], start["name"]), (end["time"], end["name"])
        return self.folder.parts([f[1] for f in self.folder.files() if after < f <= upto])

    def read(self, part: OfFile) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(part)


def _options(reader, spark: SparkSession, path: str, format: str, options: dict):
    spark.dataSource.register(FolderSource)
    for k, v in {**options, "path": path, "format": format}.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v)
    return reader


def scan_folder(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    """All files of a folder as one table; they have the first one's columns."""
    return _options(spark.read.format("statfolder"), spark, path, format, options).load()


def stream_folder(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    """The files of a folder as they come, each once."""
    return _options(spark.readStream.format("statfolder"), spark, path, format, options).load()


def write_folder(df: DataFrame, path: str, format: str, checkpoint: str, **trigger):
    """Starts a query that writes each micro-batch as one file; a batch that is run again replaces its file."""
    write = WRITERS[format]
    system, inner = filesystem(path)
    system.create_dir(inner)

    def batch(rows: DataFrame, number: int) -> None:
        write(rows, f"{path}/batch-{number:09d}.{format}")

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
