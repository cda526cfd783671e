"""Samples of audio files as a Spark data source: ``spark.read.format("recordings").load(folder)``.

Options: ``path`` (a folder or a file), ``chunk`` (frames of a row, 65 536 by default), ``bytes`` (of a file for
one partition, 32 MB by default), ``channels`` (comma-separated indexes; all by default) and ``backends`` (further formats as
``module:class``, comma-separated). A file larger than ``bytes`` is read by several partitions, each of which seeks to its
frames. The source reads with the backends that were registered when it was; a folder without readable files gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import backends

SCHEMA = "path string, rate int, channel int, start long, x array<double>"


@dataclass
class Stretch(InputPartition):
    """The ``part``-th of ``parts`` stretches of a file."""

    path: str
    part: int
    parts: int


def files_in(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder that some backend reads, by path, folders inside it left out."""
    from pyarrow import fs

    system, inner = backends.location(folder)
    own = system.get_file_info(inner)
    found = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    scheme = folder[: folder.index(":")] + "://" if ":" in folder.split("/")[0] else ""
    known = tuple(backends.suffixes())
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(known))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, known: dict[str, backends.AudioBackend]):
        self.known = known | backends.named(options.get("backends", ""))
        self.path, self.chunk = options["path"], int(options.get("chunk", 65_536))
        self.bytes = int(options.get("bytes", 32 << 20))
        self.channels = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None
        if self.chunk < 1 or self.bytes < 1:
            raise ValueError("chunk and bytes must be positive")

    def partitions(self) -> list[Stretch]:
        backends.adopt(self.known)
        return [Stretch(p, k, n) for p, size in files_in(self.path) for n in [max(1, -(-size // self.bytes))] for k in range(n)]

    def read(self, partition: Stretch | None):
        import pyarrow as pa

        if partition is None:  # there are no partitions
            return
        backends.adopt(self.known)
        own = backends.info(partition.path)
        at, end = (own.frames * k // partition.parts for k in (partition.part, partition.part + 1))
        wanted = range(own.channels) if self.channels is None else self.channels
        if any(c not in range(own.channels) for c in wanted):
            raise ValueError(f"{partition.path!r} has {own.channels} channels")
        for x in backends.stream(partition.path, at, end, self.chunk):
            n = len(wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n), pa.array([own.rate] * n, pa.int32()), pa.array(list(wanted), pa.int32()), pa.array([at] * n, pa.int64()), pa.array([x[:, c] for c in wanted], pa.list_(pa.float64()))],
                names=["path", "rate", "channel", "start", "x"],
            )
            at += len(x)


class Recordings(DataSource):
    #: Backends of the process that registered the source.
    known: dict[str, backends.AudioBackend] = {}

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self.known)


def register(spark: SparkSession) -> None:
    """Registers the source with the backends known now; to be called again when there are further ones."""

    class Known(Recordings):
        known = backends.known()

    spark.dataSource.register(Known)
