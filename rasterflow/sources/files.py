"""A sink of files: rows (name, content) become files below a folder, each task's when the task has written all of them.

    files.register(spark)
    rows.write.format("files_by_name").option("path", "file:///out").mode("append").save()

Rows of one name that follow each other are one file, in their order; names may have folders in them. A task writes into
a folder of its own and moves its files at its end, so a task that fails leaves none. What a task has moved is listed in a
file of its own; if the job fails, the driver takes these lists one after the other and removes what they name, and leaves a mark
(``_staged-.../aborted``) by which tasks that still run take back what they have moved. What killed tasks had staged stays in that folder.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed value: the mark that spreadsheet programs know UTF-8 by.
MARK = "﻿"


@dataclass
class Moved(WriterCommitMessage):
    """The list of a task's files."""

    listed: str
    files: int


def store_of(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(folder, safe="/:@%")) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class FilesByName(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files_by_name"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are added: mode('append')")
        if {"name", "content"} - set(schema.names):
            raise ValueError("rows need name and content")
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), f"_staged-{uuid.uuid4().hex}"

    def write(self, rows) -> Moved:
        store, root = store_of(self.folder)
        own = f"{root}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names, out, last = [], None, None
        try:
            for row in rows:
                if not row["name"] or ".." in row["name"].split("/") or row["name"].startswith("/"):
                    raise ValueError(f"not a name below the folder: {row['name']!r}")
                if row["name"] != last:
                    if out is not None:
                        out.close()
                    last = row["name"]
                    names.append(last)
                    out = store.open_output_stream(f"{own}/{len(names)}")
                content = row["content"]
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            if out is not None:
                out.close()
        except BaseException:
            store.delete_dir(own)
            raise
        if len(set(names)) < len(names):
            store.delete_dir(own)
            raise ValueError("rows of one name must follow each other")
        # the list is there before the first file moves, so that nothing moved is ever unlisted
        with store.open_output_stream(f"{own}/list") as listed:
            listed.write(json.dumps(names).encode())
        for k, name in enumerate(names, 1):
            if "/" in name:
                store.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            store.move(f"{own}/{k}", f"{root}/{name}")
            if self._aborted(store, root):
                self._remove(store, root, names[:k])
                raise RuntimeError("the job has failed")
        return Moved(f"{own}/list", len(names))

    def commit(self, messages) -> None:
        store, root = store_of(self.folder)
        store.delete_dir(f"{root}/{self.job}")

    def _aborted(self, store, root: str) -> bool:
        return store.get_file_info(f"{root}/{self.job}/aborted").is_file

    def _remove(self, store, root: str, names: list[str]) -> None:
        for name in names:
            if store.get_file_info(f"{root}/{name}").is_file:
                with contextlib.suppress(FileNotFoundError):  # another has removed it
                    store.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = store_of(self.folder)
        store.create_dir(f"{root}/{self.job}", recursive=True)
        with store.open_output_stream(f"{root}/{self.job}/aborted"):
            pass
        for task in store.get_file_info(fs.FileSelector(f"{root}/{self.job}")):
            if task.type == fs.FileType.Directory:
                with contextlib.suppress(OSError):  # it still runs, and sees the mark
                    with store.open_input_file(f"{task.path}/list") as listed:
                        names = json.loads(listed.read())
                    self._remove(store, root, names)
                with contextlib.suppress(OSError):
                    store.delete_dir(task.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesByName)


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows (name, content) as files below folder."""
    register(rows.sparkSession)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("files_by_name").option("path", folder).mode("append").save()


def _quoted(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_reports(rows: DataFrame, folder: str, root: str, order: str, name: str) -> None:
    """One report for each root, a column of names of folders below folder: the mark, the header, then the rows in order, as comma-separated values.

    A root's rows are sorted in the task that writes them, which keeps one at a time; the driver sees none."""
    columns = [c for c in rows.columns if c != root]
    line = F.concat(F.concat_ws(",", *[_quoted(F.col(f"`{c}`")) for c in columns]), F.lit("\r\n"))
    head = MARK + ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in columns) + "\r\n"
    first = F.lag(F.lit(1)).over(Window.partitionBy(root).orderBy(order)).isNull()
    lines = rows.withColumn("content", F.when(first, F.concat(F.lit(head), line)).otherwise(line))
    place = F.concat(F.when(F.col(root) == "", "").otherwise(F.concat(F.col(root), F.lit("/"))), F.lit(name))
    ordered = lines.select(place.alias("name"), F.col(order).alias("place"), "content").repartition("name").sortWithinPartitions("name", "place")
    write_files(ordered, folder)
