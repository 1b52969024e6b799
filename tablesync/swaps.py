"""Replacing folders of a Parquet table so that a crash between any two steps is mended by calling again.

New folders are written aside, in a hidden folder of the table. What is to become of them, and which folders go,
is then written down as one small file; from there on the swap happens, now or at the next call. Steps are renames
and deletions that may be repeated. One writer at a time; a reader in between may see folders old and new, so
``mend`` before reading after a crash. This is a list of moves, not a table format: once it is done nothing of it stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

JOURNALS, ASIDE = "_swaps", "_aside-"


class Folder:
    """Hadoop file operations under one path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._jvm = spark._jvm

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        path = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._at(new).getParent())
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} was not renamed to {new} in {self.root}")

    def write(self, name: str, text: str) -> None:
        """All of it or nothing: written under another name first."""
        out = self._fs.create(self._at(f"{name}.tmp"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(f"{name}.tmp", name)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def aside() -> str:
    """Name of a new hidden folder for what will be swapped in; it is removed with the swap."""
    return f"{ASIDE}{uuid.uuid4().hex}"


def publish(folder: Folder, staging: str, put: Iterable[str], drop: Iterable[str]) -> None:
    """Put each folder ``staging/name`` in place of ``name`` and drop others."""
    folder.write(f"{JOURNALS}/{staging}.json", json.dumps({"staging": staging, "put": list(put), "drop": list(drop)}))
    mend(folder)


def mend(folder: Folder) -> None:
    """Finish what earlier calls have written down, and remove what they have left aside."""
    for name in folder.names(JOURNALS):
        if name.endswith(".json"):
            _apply(folder, json.loads(folder.read(f"{JOURNALS}/{name}")))
            folder.delete(f"{JOURNALS}/{name}")
    for name in folder.names():
        if name.startswith(ASIDE):
            folder.delete(name)


def _apply(folder: Folder, moves: Mapping) -> None:
    for name in moves["put"]:
        new = f"{moves['staging']}/{name}"
        # Once moved it is gone from there, and what stands in place is the new one.
        if folder.exists(new):
            folder.delete(name)
            folder.rename(new, name)
    for name in moves["drop"]:
        folder.delete(name)
