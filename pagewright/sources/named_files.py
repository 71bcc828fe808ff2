"""A sink of files under their own names: ``name, content`` rows, each one file, all of a job or none.

Tasks write below a hidden folder of the job, each attempt in its own, and move what is whole to the job's common one. The
job's commit gives that its final name; an aborted job's folder is deleted. Paths are of stores that pyarrow knows, so
executors write them themselves.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a URI or local path, and the path within."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    store, inner = stores.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return store, inner.rstrip("/")


def checked(name: str | None) -> str:
    """A relative name that stays below its folder."""
    parts = (name or "").split("/")
    if not name or any(part in ("", ".", "..") for part in parts) or "\\" in name or parts[0].startswith(".job-"):
        raise ValueError(f"not a name below the folder: {name!r}")
    return name


def folder_of(store: stores.FileSystem, base: str, name: str) -> None:
    """The folders of a name below ``base``, level by level: a base that was deleted, as an aborted job's, isn't made again."""
    for part in posixpath.dirname(name).split("/"):
        if part:
            base = f"{base}/{part}"
            store.create_dir(base, recursive=False)


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.job = path.rstrip("/"), replace, uuid.uuid4().hex
        store, _, job = self._places()
        for part in ("attempts", "whole"):
            store.create_dir(f"{job}/{part}", recursive=True)

    def _places(self) -> tuple[stores.FileSystem, str, str]:
        store, inner = store_of(self.path)
        return store, inner, f"{posixpath.dirname(inner)}/.job-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        store, _, job = self._places()
        attempt, names = f"{job}/attempts/{TaskContext.get().taskAttemptId()}", []
        store.create_dir(attempt, recursive=False)
        for row in iterator:
            name = checked(row.name)
            folder_of(store, attempt, name)
            with store.open_output_stream(f"{attempt}/{name}") as out:
                out.write(bytes(row.content or b""))
            names.append(name)
        for name in names:
            folder_of(store, f"{job}/whole", name)
            store.move(f"{attempt}/{name}", f"{job}/whole/{name}")
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One rename where the folder is new or replaced. Beside files that stay, each new file is moved, replacing its namesake."""
        store, target, job = self._places()
        whole = f"{job}/whole"
        there = store.get_file_info(target).type != stores.FileType.NotFound
        if there and not self.replace:
            for info in store.get_file_info(stores.FileSelector(whole, recursive=True)):
                if info.type == stores.FileType.File:
                    final = f"{target}/{info.path[len(whole) + 1 :]}"
                    store.create_dir(posixpath.dirname(final), recursive=True)
                    store.move(info.path, final)
        else:
            if there:
                store.move(target, f"{job}/before")
            try:
                store.move(whole, target)
            except Exception:
                if there:
                    store.move(f"{job}/before", target)
                raise
        store.delete_dir(job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, job = self._places()
        for left in range(20, -1, -1):  # tasks that still run may add files while the folder goes
            if store.get_file_info(job).type == stores.FileType.NotFound:
                return
            try:
                store.delete_dir(job)
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


class NamedFiles(DataSource):
    """``named_files``: ``df.write.format("named_files").mode("overwrite" or "append").save(folder)``, of ``name string, content binary``.

    Names are relative and unique within a job; a name that leaves the folder fails it. Overwrite replaces the folder by a
    rename after the old one was renamed away, so no mixture of both is ever there; append replaces files of the same name.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
