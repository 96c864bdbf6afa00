"""A table's manifest: one small file per commit that names the folders which count.

Folders are written first, under names nobody else uses, and count from the
commit that names them. Version n + 1 is put in place by one step that fails if
another writer was first; the loser reads the new version, makes its change
again on top of that and retries. The pointer is the highest version present,
and only the last ``KEPT`` versions stay, so opening a table costs a short
listing and one file, whatever its number of batches.

The step is a hard link on a local file system and a rename elsewhere, so the
store must refuse to rename onto a file that exists, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

State = dict
KEPT, ATTEMPTS = 20, 200


class Manifest:
    """Versions ``000000000001.json`` and on below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.folder = self._path(self.root)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _versions(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, version: int):
        return self._path(f"{self.root}/{version:012d}.json")

    def read(self) -> tuple[int, State]:
        """(version, state) of the last commit; version 0 and an empty state before the first."""
        for _ in range(ATTEMPTS):
            versions = self._versions()
            if not versions:
                return 0, {}
            try:
                stream = self.files.open(self._file(versions[-1]))
            except Py4JJavaError:
                continue  # so many commits since the listing that this version went
            try:
                return versions[-1], json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        raise RuntimeError(f"no readable version below {self.root}")

    def commit(self, change: Callable[[State], State]) -> State:
        """Replace the state by ``change`` of it; ``change`` runs again if another writer was first."""
        for _ in range(ATTEMPTS):
            version, state = self.read()
            state = change(state)
            draft = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}")
            stream = self.files.create(draft, False)
            stream.write(bytearray(json.dumps(state).encode()))
            stream.close()
            won = self._publish(draft, self._file(version + 1))
            self.files.delete(draft, False)
            if won:
                for old in self._versions()[:-KEPT]:
                    self.files.delete(self._file(old), False)
                return state
        raise RuntimeError(f"{ATTEMPTS} commits below {self.root} were overtaken")

    def _publish(self, draft, target) -> bool:
        """Put a whole file in place, unless there is one."""
        if self.files.getUri().getScheme() != "file":
            return self.files.rename(draft, target)
        here, there = (self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (draft, target))
        try:
            self.jvm.java.nio.file.Files.createLink(there, here)
        except Py4JJavaError:
            if self.files.exists(target):
                return False
            raise
        return True
