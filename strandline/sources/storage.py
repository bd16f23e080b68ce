"""Files on this machine or on any file system that pyarrow knows (``hdfs://``, ``s3://``, ``gs://``), by path or address."""

from __future__ import annotations

import fnmatch
import glob
import os
import re
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def local(path: str) -> str | None:
    """The path on this machine, or None if it is elsewhere."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if _ADDRESS.match(path) else path


def _elsewhere(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def reading(path: str) -> BinaryIO:
    """A file opened for reading from any position."""
    at = local(path)
    if at is not None:
        return open(at, "rb")
    system, inner = _elsewhere(path)
    return system.open_input_file(inner)


def writing(path: str) -> BinaryIO:
    at = local(path)
    if at is not None:
        return open(at, "wb")
    system, inner = _elsewhere(path)
    return system.open_output_stream(inner, compression=None)  # a name may end in .gz


def exists(path: str) -> bool:
    at = local(path)
    if at is not None:
        return os.path.exists(at)
    system, inner = _elsewhere(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def is_folder(path: str) -> bool:
    at = local(path)
    if at is not None:
        return os.path.isdir(at)
    system, inner = _elsewhere(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def size(path: str) -> int:
    at = local(path)
    if at is not None:
        return os.path.getsize(at)
    system, inner = _elsewhere(path)
    return system.get_file_info(inner).size


def make_folder(path: str) -> None:
    at = local(path)
    if at is not None:
        os.makedirs(at, exist_ok=True)
    else:
        system, inner = _elsewhere(path)
        system.create_dir(inner, recursive=True)


def rename(old: str, new: str) -> None:
    at, to = local(old), local(new)
    if at is not None:
        os.replace(at, to)
    else:
        system, inner = _elsewhere(old)
        system.move(inner, _elsewhere(new)[1])


def remove(path: str) -> None:
    at = local(path)
    if at is not None:
        os.remove(at)
    else:
        system, inner = _elsewhere(path)
        system.delete_file(inner)


def listed(path: str, endings: tuple[str, ...] = ("",)) -> list[str]:
    """The files of a folder that have one of the endings, those of a pattern (``*`` in the last name), or the path itself."""
    at = local(path)
    if at is not None:
        if os.path.isdir(at):
            return sorted(p for p in glob.glob(os.path.join(at, "*")) if p.endswith(endings) and not os.path.basename(p).startswith((".", "_")))
        return sorted(glob.glob(at)) or [at]
    system, inner = _elsewhere(path)
    prefix = path[: len(path) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else ""
    head, _, last = inner.rstrip("/").rpartition("/")
    if "*" in last:
        found = [i.path for i in system.get_file_info(fs.FileSelector(head)) if fnmatch.fnmatch(i.base_name, last)]
    elif is_folder(path):
        found = [i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.path.endswith(endings) and not i.base_name.startswith((".", "_"))]
    else:
        return [path]
    return sorted(prefix + p for p in found)


class _Part(WriterCommitMessage):
    def __init__(self, at: str, name: str) -> None:
        self.at, self.name = at, name


class PartsWriter(DataSourceArrowWriter):
    """One file per task in a folder. An attempt writes a hidden file of its own; the commit of the job names the finished ones,
    an abort removes them. ``encode`` writes the batches of a task to an open file."""

    ending = ""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options = options
        self.path = options["path"].rstrip("/")
        if overwrite and is_folder(self.path):
            for name in listed(self.path, (self.ending,)):
                remove(name)
        make_folder(self.path)

    def encode(self, batches, out: BinaryIO) -> None:
        raise NotImplementedError

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():05d}{self.ending}"
        at = f"{self.path}/.{name}.{ctx.taskAttemptId()}"
        with writing(at) as out:
            self.encode(iterator, out)
        return _Part(at, f"{self.path}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None:
                rename(m.at, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and exists(m.at):
                remove(m.at)
