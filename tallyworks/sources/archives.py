"""Members of ZIP archives as rows, each read by its own range: no task sees more of an archive than its members.

The directories at the archives' ends are read where the job is planned; a partition is a run of wanted members of one
archive. Members come in parts of bounded size, so memory doesn't grow with an archive, and hardly with a member.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SHAPE = "archive string, member string, part int, content binary, error string"
#: Bytes of a part of a member, and packed bytes of a partition, about.
PART_BYTES, TASK_BYTES = 4 << 20, 32 << 20
STORED, DEFLATED, DEFLATE64 = 0, 8, 9
LOCAL_HEADER = struct.Struct("<4s5H3I2H")


@dataclass
class Members(InputPartition):
    """Wanted members of one archive: (name, offset of its header, packed size, size, checksum, method)."""

    archive: str
    members: list[tuple[str, int, int, int, int, int]]


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)
    return where.open_input_file(name)


def _listed(path: str) -> list[str]:
    """Archives of a path: a file, or the .zip files of a folder, by name."""
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = where.get_file_info(fs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".zip"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], re.compile(options.get("pattern", ".*"))
        self.part, self.task = int(options.get("partbytes", PART_BYTES)), int(options.get("taskbytes", TASK_BYTES))
        self.keep_errors = options.get("mode", "fail") == "keep"

    def partitions(self) -> list[Members]:
        out = []
        for archive in _listed(self.path):
            with _opened(archive) as file, zipfile.ZipFile(file) as z:
                wanted = [(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in z.infolist() if self.pattern.fullmatch(i.filename)]
            run: list = []
            for m in sorted(wanted, key=lambda m: m[1]):
                if run and sum(x[2] for x in run) + m[2] > self.task:
                    out.append(Members(archive, run))
                    run = []
                run.append(m)
            if run:
                out.append(Members(archive, run))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.members:
            return
        with _opened(partition.archive) as file:
            for member in partition.members:
                name, method = member[0], member[5]
                if method not in (STORED, DEFLATED):
                    what = f"{partition.archive}: {name} is packed by method {method}{' (Deflate64)' if method == DEFLATE64 else ''}, which can't be read"
                    if not self.keep_errors:
                        raise ValueError(what)
                    yield partition.archive, name, 0, None, what
                    continue
                for k, content in enumerate(self._parts(file, partition.archive, *member)):
                    yield partition.archive, name, k, content, None

    def _parts(self, file, archive: str, name: str, offset: int, packed: int, size: int, crc: int, method: int) -> Iterator[bytes]:
        """The member's bytes in parts; its length and checksum must be those of the directory."""
        file.seek(offset)
        header = LOCAL_HEADER.unpack(file.read(LOCAL_HEADER.size))
        if header[0] != b"PK\x03\x04":
            raise ValueError(f"{archive}: no member at {offset}")
        file.seek(offset + LOCAL_HEADER.size + header[-2] + header[-1])
        unpack = zlib.decompressobj(-15) if method == DEFLATED else None
        left, seen, n, held = packed, 0, 0, b""
        while left or held:
            if not held and left:
                held = file.read(min(left, self.part))
                if not held:
                    break
                left -= len(held)
            content = unpack.decompress(held, self.part) if unpack else held
            held = unpack.unconsumed_tail if unpack else b""
            seen, n = zlib.crc32(content, seen), n + len(content)
            if content:
                yield content
        while unpack and (content := unpack.decompress(unpack.unconsumed_tail, self.part)):
            seen, n = zlib.crc32(content, seen), n + len(content)
            yield content
        if n != size or seen != crc:
            raise ValueError(f"{archive}: {name} is damaged: {n} of {size} bytes")
        if not size:
            yield b""


class ZipMembers(DataSource):
    """``spark.read.format("zipmembers")``: options path, pattern (of whole names), partBytes, taskBytes and mode.

    In mode ``fail`` a member packed in a way that can't be read, as Deflate64 is, is an error; in mode ``keep`` it is a
    row without content whose ``error`` says so. Damaged members are errors in both. An empty member has one empty part.
    """

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def zip_members(spark: SparkSession, path: str, pattern: str = ".*", **options: str | int) -> DataFrame:
    """(archive, member, part, content, error) of the members of an archive, or of a folder's archives, that match."""
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zipmembers").option("path", path).option("pattern", pattern)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
