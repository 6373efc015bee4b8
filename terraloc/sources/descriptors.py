"""Descriptor files as a sink of the DataFrame writer: spark.dataSource.register(DescriptorSink), df.write.format("descriptors")."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from terraloc.sources.files import RECORD, descriptor_file

MOST = 0xFFFF


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class DescriptorSink(DataSource):
    """Columns name, timestamp, x, y, z, roll, pitch, yaw, data; option suffix. A task's rows become one file, or more of up to 65,535 rows."""

    @classmethod
    def name(cls) -> str:
        return "descriptors"

    def writer(self, schema, overwrite: bool) -> DescriptorWriter:
        missing = [c for c in RECORD.names if c not in schema.names]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        return DescriptorWriter(self.options["path"], self.options.get("suffix", ""))


class DescriptorWriter(DataSourceWriter):
    """Tasks write under names of their own, which only commit gives their final ones, so a task lost or tried twice leaves no file."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.job = path, suffix, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        names, rows = [], []

        def flush():
            names.append(f"_{self.job}-{uuid.uuid4().hex}.tmp")
            with system.open_output_stream(posixpath.join(folder, names[-1])) as out:
                out.write(descriptor_file(rows, self.suffix))
            rows.clear()

        for row in iterator:
            # Packed numbers: a task holds a file's rows, as its header counts them.
            rows.append(row.asDict() | {"data": np.asarray(row["data"], "<f4")})
            if len(rows) == MOST:
                flush()
        if rows:
            flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._folder()
        for i, name in enumerate(n for m in messages if m for n in m.names):
            system.move(posixpath.join(folder, name), posixpath.join(folder, f"part-{i:05d}-{self.job}.desc"))

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = self._folder()
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)
