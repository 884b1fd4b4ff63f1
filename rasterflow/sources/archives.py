"""A source of archive members: ZIP archives below a folder, listed from their directories by ranged reads.

    archives.register(spark)
    spark.read.format("archive_members").option("path", "file:///packs").load()

A row per member, in the order of the archive's directory; a partition reads the directories of a few archives and no
member's content. An archive that can't be read is a row without member and with error; an empty one has a row
without either, so no archive is lost. Names are kept as they are written, unsafe ones too: judging them is the reader's business.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterflow.sources.files import store_of

#: Archives that a partition lists one after the other, at most, and bytes of a piece of a member.
TOGETHER, PIECE = 16, 4 << 20
MEMBERS = "archive string, position int, member string, size long, packed_size long, crc32 long, is_folder boolean, encrypted boolean, error string"


@dataclass
class Archives(InputPartition):
    paths: list[str]


class Ranges(io.RawIOBase):
    """A file of a store as archive readers want it: a place before its start is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("a place before the file's start")
        return self.file.seek(place)

    def readinto(self, room) -> int:
        part = self.file.read(len(room))
        room[: len(part)] = part
        return len(part)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(store, path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(Ranges(store.open_input_file(path)), 1 << 16))


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        store, root = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path.removeprefix(root).lstrip("/") for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        return [Archives(names[k : k + TOGETHER]) for k in range(0, len(names), TOGETHER)]

    def read(self, partition: Archives):
        store, root = store_of(self.folder)
        for name in getattr(partition, "paths", ()):  # a folder without archives has one partition without any
            try:
                with opened(store, f"{root}/{name}") as zipped:
                    members = zipped.infolist()
            except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError) as e:
                yield (name, None, None, None, None, None, None, None, str(e) or type(e).__name__)
                continue
            if not members:
                yield (name, None, None, None, None, None, None, None, None)
            for k, m in enumerate(members):
                yield (name, k, m.orig_filename, m.file_size, m.compress_size, m.CRC, m.is_dir(), bool(m.flag_bits & 1), None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveMembers)


def members(spark: SparkSession, folder: str) -> DataFrame:
    """The members of the archives below folder."""
    register(spark)
    return spark.read.format("archive_members").option("path", folder).load()


def pieces(archives: DataFrame, folder: str) -> DataFrame:
    """Contents of archives (a column archive) below folder: rows (archive, target, piece, content) of a few megabytes each, a file's in order and
    after each other; target: the member's path without . and .. steps. Of members of one path the last counts, as when
    they are unpacked one over the other. A member that doesn't unpack to its checksum is an error."""

    def rows(name):
        store, root = store_of(folder.rstrip("/"))
        with opened(store, f"{root}/{name}") as zipped:
            last = {posixpath.normpath(m.orig_filename.replace("\\", "/")): m for m in zipped.infolist() if not m.is_dir()}
            for target, m in last.items():
                with zipped.open(m) as content:
                    k = 0
                    while (part := content.read(PIECE)) or not k:
                        yield name, target, k, part
                        k += 1

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                part, size = [], 0
                for row in rows(name):
                    part.append(row)
                    size += len(row[3])
                    if size >= PIECE or len(part) >= 1024:
                        yield _piece_rows(part)
                        part, size = [], 0
                if part:
                    yield _piece_rows(part)

    return archives.select("archive").mapInArrow(run, "archive string, target string, piece int, content binary")


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "target", "piece", "content"])
